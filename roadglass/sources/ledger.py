"""Tables that change in steps which hold or do not hold as a whole, on any file system that Spark writes to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Parts of one level that are merged into one of the next.
FAN = 16


def _place(spark: SparkSession, path: str):
    """Path and file system, as Spark itself opens them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _place(spark, path)
    return fs.exists(p)


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has come to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder, if it is there."""
    p, fs = _place(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing if there is none."""
    p, fs = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.mkdirs(p)


def move(spark: SparkSession, source: str, to: str) -> None:
    """Rename a folder: no data is copied."""
    p, fs = _place(spark, source)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot move {source} to {to}")


class Ledger:
    """Numbered entries in a folder, each written whole or not at all; a number is given once.

    An entry is written under a name of its own and renamed to its number; the rename fails if the number is taken. So of
    two jobs that go for the same step one fails, and a job that dies before the rename has changed nothing."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        make(spark, at)

    def last(self) -> int:
        """The largest number, -1 without entries."""
        return max((int(n) for n in names(self.spark, self.at) if n.isdigit()), default=-1)

    def read(self, number: int) -> dict | None:
        p, fs = _place(self.spark, f"{self.at}/{number:09d}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> None:
        """Add an entry; raises FileExistsError if the number is taken."""
        jvm, (draft, fs) = self.spark._jvm, _place(self.spark, f"{self.at}/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(json.dumps(entry).encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.at}/{number:09d}"), options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.at}/{number:09d}")):
                raise FileExistsError(f"entry {number} of {self.at} is taken") from e
            raise


def put_part(part: DataFrame, at: str, number: int, merge: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
    """Add the changes of one step to a table that is kept in levels.

    Step `number` writes its own rows only. When `fan` parts of a level are full they are merged into one of the next, so
    over many steps each row is written again about log(steps) / log(fan) times, and a step costs the same whatever was
    written before. `merge` must give the same for rows that are there twice: a step that runs again replaces its part,
    and parts go only after what they were merged into is whole."""
    spark, level = part.sparkSession, 0
    schema = part.schema
    if not is_whole(spark, f"{at}/level=1/part={number // fan:09d}"):
        part.write.mode("overwrite").parquet(f"{at}/level=0/part={number:09d}")
    while (number + 1) % fan == 0:
        own = [f"{at}/level={level}/part={k:09d}" for k in range(number - fan + 1, number + 1)]
        merged = f"{at}/level={level + 1}/part={number // fan:09d}"
        if not is_whole(spark, merged) and not is_whole(spark, f"{at}/level={level + 2}/part={number // fan // fan:09d}"):
            merge(spark.read.schema(schema).parquet(*[p for p in own if exists(spark, p)])).select(*schema.names).write.mode("overwrite").parquet(merged)
        for p in own:
            remove(spark, p)
        number, level = number // fan, level + 1


def read_parts(spark: SparkSession, at: str, schema: StructType | str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table that `put_part` keeps: its parts of all levels, merged."""
    found = [f"{at}/{level}/{part}" for level in names(spark, at) for part in names(spark, f"{at}/{level}") if is_whole(spark, f"{at}/{level}/{part}")]
    return merge(spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema))
