"""Telemetry text and control messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.scalars import strip

# The telemetry block. Required values are non-empty except subtype.
_BLOCK = (
    r"\[meta@[^ ]+ "
    + " ".join(f'{k}="[^"]{"*" if k == "subtype" else "+"}"' for k in S.TELEMETRY_REQUIRED[1:])
    + "".join(f'(?: {k}="[^"]+")?' for k in S.TELEMETRY_OPTIONAL)
    + r"\]"
)
_PAIR = r'([a-z_]+)="([^"]*)"'


def read_telemetry_text(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines of text files as ``value``; a directory can also be read as a stream (S3)."""
    reader = spark.readStream if stream else spark.read
    return reader.options(**options).text(path)


def read_telemetry_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options) -> DataFrame:
    """Lines from a Kafka topic; ``arrival_us`` is the broker time (S3).

    Needs the Spark Kafka package on the class path.
    """
    reader = (spark.readStream if stream else spark.read).format("kafka")
    raw = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(
        F.col("value").cast("string").alias("value"), F.unix_micros("timestamp").alias("arrival_us")
    )


def read_control(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Control messages as JSON lines of ``capture_id, arrival_us, seq_no, payload``."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.control_schema()).json(path)


def parse_telemetry(lines: DataFrame, value: str = "value") -> DataFrame:
    """Columns of every telemetry line and how it was read.

    ``status`` is strict (the whole block matches), lenient (cut off, but both rssi and heap
    are there) or reject. The strict pattern runs once to find the block; its pairs, or those
    of the whole line in the lenient case, become one map that all columns read. Of repeated
    keys the last wins. What a strict line omits is empty; in a cut line missing text is empty
    and a missing number is "0".
    """
    text = strip(F.col(value))
    # One-element generators keep later filters above the regular expressions, so that each
    # line is matched once.
    found = lines.select("*", F.explode(F.array(F.regexp_extract(text, _BLOCK, 0))).alias("_block"))
    found = found.withColumn("_strict", F.col("_block") != "")
    source = F.when(F.col("_strict"), F.col("_block")).otherwise(text)
    pairs = F.map_from_arrays(
        F.regexp_extract_all(source, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(source, F.lit(_PAIR), F.lit(2))
    )
    pen = F.regexp_extract(source, r"\[meta@(\S+)", 1)
    found = found.select("*", F.inline(F.array(F.struct(pairs.alias("_kv"), pen.alias("_pen")))))
    kv = F.col("_kv")
    lenient = F.map_contains_key(kv, F.lit("rssi")) & F.map_contains_key(kv, F.lit("heap"))
    status = F.when(F.col("_strict"), "strict").when(lenient, "lenient").otherwise("reject")

    def pick(key: str) -> Column:
        missing = F.lit("") if key in S.TELEMETRY_TEXT_KEYS else F.when(F.col("_strict"), "").otherwise("0")
        return F.when(F.col("status") != "reject", F.coalesce(F.element_at(kv, key), missing))

    pen = F.when(F.col("status") != "reject", F.when(F.col("_pen") != "", F.col("_pen")).otherwise(pick("pen")))
    keys = [k for k in (*S.TELEMETRY_REQUIRED, *S.TELEMETRY_OPTIONAL) if k != "pen"]
    return found.withColumn("status", status).withColumns({
        "truncated": F.col("status") == "lenient",
        "pen": pen,
        **{S.TELEMETRY_RENAMES.get(k, k): pick(k) for k in keys},
    }).drop("_block", "_strict", "_kv", "_pen")


def accepted_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("status <> 'reject'")


def reject_lines(parsed: DataFrame, value: str = "value") -> DataFrame:
    """Lines that could not be read, for the quarantine table."""
    keep = [c for c in ("capture_id", "pkt_id", "arrival_us") if c in parsed.columns]
    return parsed.where("status = 'reject'").select(
        *keep, F.col(value).alias("raw"),
        F.when(F.col(value).contains("[meta@"), "cut before heap").otherwise("no telemetry block").alias("reason"),
    )
