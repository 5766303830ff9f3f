"""The session settings that the library counts on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configured(spark: SparkSession) -> SparkSession:
    """`spark` with the settings above; all of them can be set at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_own_folder: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, which all executors share.

    Only a session in local mode may do without that setting: its executors are threads of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        root = _own_folder[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
