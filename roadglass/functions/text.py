"""Screening, routing and embedding of texts, and page cursors, as column expressions."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, functions as F

#: What marks a question that must not be answered.
UNSAFE = (
    r"(?i)(ignore (all |any )?(previous|prior|above) (instructions|rules)|system prompt|you are now|developer mode|"
    r"disregard .*instructions|reveal .*(secret|key|password)|drop table|delete from|;\s*--|other tenant|all tenants)"
)
MAX_QUESTION = 500

#: Fixed value: a 17-character vehicle number inside a text.
VIN_MENTION = r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b"

#: Words that route a question, in order.
GREETING = r"^\W*(hi|hello|hey|help|what can you do)\W*$"
ORDER_WORDS = r"work order|schedule|book|fix"
SAVING_WORDS = r"sav|cost|money|\$|dollar|roi"
ALERT_WORDS = r"alert|critical|urgent|now"
ADVICE_WORDS = r"how|what|why|fix|cause|mean"
RISK_WORDS = r"risk|break"

DIMENSIONS = 256


def refusal(question: Column) -> Column:
    """'unsafe', 'too long' or null if the question may go on."""
    return F.when(question.rlike(UNSAFE), "unsafe").when(F.char_length(question) > MAX_QUESTION, "too long")


def mentions(text: Column) -> Column:
    """Vehicle numbers in a text, upper case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(VIN_MENTION), F.lit(0)), F.upper)


def intent(question: Column) -> Column:
    """What a question asks for; the first rule that holds decides."""
    q, some = F.lower(question), F.size(mentions(question)) > 0
    return (
        F.when(~some & q.rlike(GREETING), "help")
        .when(some & q.rlike(ORDER_WORDS), "work_order")
        .when(some, "vehicle")
        .when(q.rlike(SAVING_WORDS), "savings")
        .when(q.rlike(ALERT_WORDS), "alerts")
        .when(q.rlike(ADVICE_WORDS) & ~q.rlike(RISK_WORDS), "knowledge")
        .otherwise("top_risk")
    )


def grams(text: Column) -> Column:
    """Tokens and pairs of neighbouring tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, pairs)


def embed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, bucket, weight): the non-zero entries of a unit-length signed-hash vector of each text.

    Bucket and sign come from the md5 of a gram: its first byte, and the top bit of its eighth. The vector stays in
    sparse rows, so long texts and hot grams need no gathering; vectors meet in joins on the bucket."""
    g = df.select(F.col(id_col), F.explode(grams(F.col(text_col))).alias("gram")).withColumn("h", F.md5("gram"))
    bucket = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    sign = F.when(F.conv(F.substring("h", 15, 2), 16, 10).cast("int") >= 128, 1).otherwise(-1)
    sums = g.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).alias("s"))
    norms = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return sums.filter("s <> 0").join(norms, id_col).select(id_col, "bucket", F.round(F.col("s") / F.col("norm"), 5).alias("weight"))


def cursor(key: Column) -> Column:
    """An opaque page cursor: url-safe base64 of the key as JSON."""
    return F.translate(F.base64(F.encode(F.to_json(F.struct(key.alias("k"))), "utf-8")), "+/", "-_")


def cursor_key(text: Column) -> Column:
    """The key of a cursor; null for an empty one or one that can't be read."""
    plain = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    return F.get_json_object(plain.cast("string"), "$.k")


def read_cursor(text: str | None) -> str | None:
    """The key of a cursor that a caller hands in: none for none or an empty one; ValueError for one that can't be read."""
    if not text:
        return None
    try:
        return str(json.loads(base64.urlsafe_b64decode(text.encode("ascii")))["k"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"not a cursor: {text[:80]!r}") from e
