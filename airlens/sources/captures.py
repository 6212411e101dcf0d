"""Capture, window and report files; device state."""

from __future__ import annotations

import csv
import itertools
import logging
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.scalars import (
    clean_window_rf, fill_features, normalize_label, parse_time_us, strip, to_float, with_attack_type,
)
from airlens.operators.scan import cell_of

# Time of one capture in one packet file.
FILE_US = 3_600_000_000

log = logging.getLogger(__name__)


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header line, in all folders below, found in one pass; one line a file is shuffled."""
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value"
    ).where("at = 0")
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, line in lines.groupBy("path").agg(F.min_by("value", "n")).orderBy("path").toLocalIterator():
        header = tuple(c.strip() for c in next(csv.reader([line])))
        if "timestamp" not in header:
            log.warning("skipped %s: no timestamp column", path)
            continue
        groups.setdefault(header, []).append(path)
    return groups


def _root(paths: Sequence[str]) -> str:
    """The folder all given paths lie in, without its scheme; file names and wildcards don't count."""
    folders = []
    for path in paths:
        parts = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/").split("/")
        cut = next((i for i, p in enumerate(parts) if re.search(r"[*?\[{]", p)), len(parts))
        folders.append(parts[:cut - 1] if cut == len(parts) and re.search(r"\.\w+$", parts[-1]) else parts[:cut])
    shared = [p[0] for p in itertools.takewhile(lambda p: len(set(p)) == 1, zip(*folders))]
    return "/".join(shared)


def read_packets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw capture files as text columns plus ``capture_id`` and ``row_no``.

    The file is the unit: ``capture_id`` is its path below the folder that all ``paths`` lie
    in, without ``.csv``. Files may have different headers; each header is read with its own
    schema and the parts are joined by column name. A file without ``timestamp`` is skipped
    and noted. ``row_no`` grows with the position in the file: the start of the split in
    bytes plus the row's number in its task, which never passes the start of the next split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    below = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(_root(paths)) + "/+", "")
    out: DataFrame | None = None
    for header, group in _headers(spark, paths).items():
        fields = ", ".join(f"`{c}` string" for c in header)
        part = spark.read.option("header", True).schema(fields).csv(group)
        in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        part = part.select(
            F.regexp_replace(below, r"\.csv(\.\w+)?$", "").alias("capture_id"),
            (F.col("_metadata.file_block_start") + in_task).alias("row_no"), "*",
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no capture file with a timestamp column in {paths}")
    return out


def to_typed(raw: DataFrame) -> DataFrame:
    """Text columns to numbers and ``gen_us``; columns an old capture lacks stay null.

    The time is ISO text, or epoch seconds as serial captures write them.
    """
    have = set(raw.columns)
    optional = {"win_pkts", "win_dens", "pred_attack", "pred_raw", "calib_thr", "gw_flip"}
    seconds = F.col("timestamp").try_cast("double")
    columns = {"gen_us": F.coalesce(parse_time_us(F.col("timestamp")), F.round(seconds * 1e6).cast("bigint"))}
    for name, kind in S.packet_fields().items():
        if name not in have:
            columns[name] = F.lit(None).cast(kind)
        elif kind.simpleString() == "double":
            value = to_float(F.col(name))
            columns[name] = F.when(strip(F.col(name)) != "", value) if name in optional else value
    columns["rssi_missing"] = F.coalesce(strip(F.col("rssi")) == "", F.lit(True)) if "rssi" in have else F.lit(True)
    return raw.withColumns(columns).drop("timestamp")


def drop_bad_time(typed: DataFrame) -> DataFrame:
    """Only rows with a readable time."""
    return typed.where(F.col("gen_us").isNotNull())


def bad_time_counts(typed: DataFrame, key: str = "capture_id") -> DataFrame:
    """Rows with and without a readable time, per capture."""
    return typed.groupBy(key).agg(
        F.count("gen_us").alias("kept"), F.count(F.when(F.col("gen_us").isNull(), 1)).alias("dropped")
    )


def read_windows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Window files, filled, coerced and cleaned."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return prepare_windows(reader.format(fmt).load(path))


def prepare_windows(df: DataFrame) -> DataFrame:
    if "label" not in df.columns:
        raise ValueError("the window set has no label column")
    if "window_us" not in df.columns and "window_start" in df.columns:
        df = df.withColumn("window_us", parse_time_us(F.col("window_start")))
    df = with_attack_type(fill_features(df)).withColumn("label", normalize_label(F.col("label")))
    return clean_window_rf(df)


def latest_capture(df: DataFrame, key: str = "capture_id") -> DataFrame:
    """Rows of the newest capture by name.

    The newest name is looked up first, so the filter on the partition column is a constant
    and prunes the other folders.
    """
    newest = df.agg(F.max(key).alias("k")).first()["k"]
    return df.where(F.col(key) == F.lit(newest))


def write_packets(df: DataFrame, path: str, mode: str = "append") -> None:
    """Labelled packets, one folder per capture.

    Rows are dealt out by capture and stretch of time first, so a capture has a file for each
    stretch and not one from every task.
    """
    time = next((c for c in ("gen_us", "aligned_us", "arrival_us") if c in df.columns), None)
    df = df.repartition("capture_id", *[cell_of(c, FILE_US) for c in (time,) if c])
    df.write.mode(mode).partitionBy("capture_id").parquet(path)


def write_windows(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Window rows in the fixed column order with an ISO start time."""
    start = F.date_format(F.timestamp_micros("window_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("window_start")
    out = df.select("capture_id", start, *S.WINDOW_FEATURES, *S.SIDECAR_FEATURES, "label", "attack_type")
    writer = out.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small report table as one JSON file."""
    df.repartition(1).write.mode(mode).json(path)


def device_fields(lines: DataFrame, device: str = "host_mac", order: Sequence[str] = ("arrival_us", "pkt_id")) -> DataFrame:
    """What is known of each device, every value with the place of the line that sent it.

    Two such tables of one device are merged by taking the larger struct of each field, in
    whatever order their lines came.
    """
    def latest(c: str, sent) -> Column:
        return F.max(F.when(sent, F.struct(*order, F.col(c).alias("value")))).alias(c)

    sent = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    source = [latest("source_ip", F.lit(True))] if "source_ip" in lines.columns else []
    return lines.groupBy(device).agg(*source, latest("ap_bssid", sent("ap_bssid")), latest("channel", sent("channel")), F.max(order[0]).alias("updated_us"))


def merge_device_fields(fields: DataFrame, device: str = "host_mac") -> DataFrame:
    return fields.groupBy(device).agg(*[F.max(c).alias(c) for c in fields.columns if c != device])


def device_values(fields: DataFrame, device: str = "host_mac") -> DataFrame:
    return fields.select(device, *[F.col(f"{c}.value").alias(c) for c in fields.columns if c not in (device, "updated_us")], "updated_us")


def device_state(lines: DataFrame, device: str = "host_mac", order: Sequence[str] = ("arrival_us", "pkt_id")) -> DataFrame:
    """Last address, access point and channel per device.

    Access point and channel keep the last value that was sent; the rest is from the last line.
    """
    return device_values(device_fields(lines, device, order), device)
