"""Registered round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import adapter
from airlens import schema as S
from airlens.operators import labels, quality, windows
from airlens.plans.oracle import FEATURES
from airlens.plans.queries import labelled_packets, packets, windows_of
from airlens.plans.registry import query
from airlens.session import shared_dir
from airlens.sources import captures, telemetry


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def raw_text(p: DataFrame, *more: str) -> DataFrame:
    """Packets as the text columns of a capture file, and ``more``; ``pen`` keeps the capture number."""
    time = F.date_format(F.timestamp_micros("gen_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    given = {"pen": "capture_id", "uptime": "uptime_ms"}
    have = set(p.columns)
    cols = []
    for c in S.RAW_PACKET_COLUMNS:
        source = given.get(c, c)
        value = time if c == "timestamp" else F.col(source).cast("string") if source in have else F.lit(None).cast("string")
        cols.append(value.alias(c))
    return p.select(*cols, *more)


@query("read_packets", f"select capture_id::varchar as capture, window_us, {FEATURES}, gw_mac_flip, label, attack_type from windows")
def _(spark, d):
    path = folder(spark)
    p = adapter.packets_of(spark.read.parquet(f"{d}/events.parquet")).withColumn("capture", F.col("capture_id").cast("string"))
    # A folder for each capture, in it files for stretches of whole windows; names repeat from folder to folder.
    ordered = p.repartition("capture", F.floor(F.col("gen_us") / (S.WINDOW_US * 10_000))).sortWithinPartitions("capture", "gen_us", "pkt_id")
    raw_text(ordered, "capture").write.partitionBy("capture").option("header", True).csv(path)
    typed = captures.drop_bad_time(captures.to_typed(captures.read_packets(spark, path)))
    typed = typed.withColumn("capture", F.regexp_extract("capture_id", r"^capture=(.*)/[^/]+$", 1))
    return windows.aggregate_windows(typed, key="capture", row_no="row_no")


@query("write_packets", "select capture_id, pkt_id, aligned_us, label, attack_type from labelled")
def _(spark, d):
    path = folder(spark)
    captures.write_packets(labelled_packets(spark, d).select("capture_id", "pkt_id", "aligned_us", "label", "attack_type"), path)
    return spark.read.parquet(path)


@query("write_read_windows", f"select capture_id::varchar as capture_id, window_us, {FEATURES}, label, attack_type from windows")
def _(spark, d):
    path = folder(spark)
    captures.write_windows(windows_of(spark, d), path)
    return captures.read_windows(spark, path).select("capture_id", "window_us", *S.WINDOW_FEATURES, "label", "attack_type")


@query("write_report", "select capture_id, count(*) as n, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg from windows group by 1")
def _(spark, d):
    path = folder(spark)
    captures.write_report(quality.class_counts(windows_of(spark, d), "capture_id"), path)
    return spark.read.schema("capture_id int, n long, n_pos long, n_neg long").json(path)


@query("read_telemetry_text", "select case when pkt_id % 10 in (3, 5) then 'lenient' when pkt_id % 10 = 4 then 'reject' else 'strict' end as status, count(*) as n from packets group by 1")
def _(spark, d):
    path = folder(spark)
    adapter.lines_of(packets(spark, d)).select("value").write.text(path)
    return telemetry.parse_telemetry(telemetry.read_telemetry_text(spark, path)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("read_control", "select capture_id::varchar as capture_id, start_us, coalesce(end_us, -1) as end_us, attack_type, state from spans")
def _(spark, d):
    path = folder(spark)
    adapter.control_of(packets(spark, d)).withColumn("capture_id", F.col("capture_id").cast("string")).write.json(path)
    spans = labels.control_to_spans(telemetry.read_control(spark, path))
    return spans.select("capture_id", "start_us", F.coalesce("end_us", F.lit(-1)).alias("end_us"), "attack_type", "state")
