"""Registered streaming queries: each replays ``events`` as a stream and reads the result back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens import adapter
from airlens import schema as S
from airlens.operators import windows
from airlens.operators.stage import stage
from airlens.plans.oracle import CALIB_MS, FEATURES
from airlens.plans.queries import DEVICE_STATE_SQL, ELASTIC_SQL, addressed, alert_windows, packets, quiet_windows
from airlens.plans.registry import query
from airlens.session import shared_dir
from airlens.sources import telemetry
from airlens.streaming import jobs

FAR_US = adapter.BASE_US * 2


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a stream. The size per trigger bounds what one device can bring in a batch."""
    reader = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
    return reader.option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", str(2 << 30)).parquet(d)


def packet_stream(spark: SparkSession, d: str) -> DataFrame:
    return adapter.packets_of(event_stream(spark, d))


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A staged batch table read as a stream."""
    staged = stage(df)
    return spark.readStream.schema(df.schema).parquet(staged.inputFiles()[0].rsplit("/", 1)[0])


def replay_closed(stream: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "capture_id", time: str = "gen_us") -> DataFrame:
    """Run an append-mode query to its end and let the watermark pass every real window.

    A second source stays empty while the rows are read. Then it gets one far-future row and
    the query goes on from its checkpoint, which closes all open windows.
    """
    spark, out = stream.sparkSession, folder(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/closing")
    query = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{out}/closing")))
    jobs.start(query, jobs.to_table(f"{out}/data"), f"{out}/checkpoint").awaitTermination()
    given = {key: F.lit(-1), time: F.lit(FAR_US), "pkt_id": F.lit(0)}
    row = spark.range(1).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    row.write.mode("append").parquet(f"{out}/closing")
    jobs.start(query, jobs.to_table(f"{out}/data"), f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data").drop("batch")


def replay(stream: DataFrame, sink: Callable[[str], Callable], mode: str = "append") -> str:
    """Run a stream over what is there; returns the output folder."""
    spark = stream.sparkSession
    out = folder(spark)
    jobs.start(stream, sink(f"{out}/data"), f"{out}/checkpoint", mode).awaitTermination()
    return f"{out}/data"


def replayed(stream: DataFrame) -> DataFrame:
    path = replay(stream, jobs.to_table)
    return stream.sparkSession.read.parquet(path).drop("batch")


@query("stream_parse", """
select capture_id, pkt_id, case when pkt_id % 10 in (3, 5) then 'lenient' else 'strict' end as status, subtype, heap::varchar as heap from packets where pkt_id % 10 <> 4
union all select capture_id, pkt_id, 'quarantine', null, null from packets where pkt_id % 10 = 4""")
def _(spark, d):
    out = folder(spark)
    parsed = jobs.stream_parse(adapter.lines_of(packet_stream(spark, d)))
    jobs.start(parsed, jobs.parse_sink(f"{out}/ok", f"{out}/bad"), f"{out}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{out}/ok").select("capture_id", "pkt_id", "status", "subtype", "heap")
    none = F.lit(None).cast("string")
    bad = spark.read.parquet(f"{out}/bad").select(
        "capture_id", "pkt_id", F.lit("quarantine").alias("status"), none.alias("subtype"), none.alias("heap")
    )
    return good.unionByName(bad)


@query("stream_windows", f"select capture_id, window_us, {FEATURES}, gw_mac_flip, label, attack_type from windows")
def _(spark, d):
    return replay_closed(packet_stream(spark, d), jobs.stream_windows)


def in_rounds(spark: SparkSession, streams: list[tuple[DataFrame, str]], rounds: int, run: Callable[..., None]) -> None:
    """Tables as streams that get the rows of one number after the other: ``run`` takes up what is new in each round."""
    paths = [folder(spark) for _ in streams]
    for k in range(rounds):
        for (df, batch), path in zip(streams, paths, strict=True):
            df.where(F.col(batch) == k).drop(batch).write.mode("append").parquet(path)
        run(*[spark.readStream.schema(df.drop(batch).schema).parquet(path) for (df, batch), path in zip(streams, paths, strict=True)])


def disordered(spark: SparkSession, d: str) -> DataFrame:
    """Packets in three batches: every third capture comes a batch and a minute late, and each capture has one row an hour ahead."""
    p = packets(spark, d)
    fault = p.where("pkt_id % 1000 = 0").withColumn("gen_us", F.col("gen_us") + 3_600_000_000)
    late = F.col("capture_id") % 3 == 0
    third = F.pmod(F.floor(F.col("pkt_id") / 1000), F.lit(3))  # stretches of each capture come out of order
    both = p.unionByName(fault).withColumn("batch", third.cast("int"))
    return both.withColumns({
        "batch": F.when(late, F.least(F.col("batch") + 1, F.lit(2))).otherwise(F.col("batch")),
        "arrival_us": F.when(late, F.col("arrival_us") + 60_000_000).otherwise(F.col("arrival_us")),
    })


def disordered_windows(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    rows = stage(disordered(spark, d))
    out = folder(spark)
    in_rounds(spark, [(rows, "batch")], 3, lambda come: jobs.start(come, jobs.windows_sink(f"{out}/data"), f"{out}/checkpoint").awaitTermination())
    return f"{out}/data", rows.drop("batch")


@query("stream_windows_late", f"select capture_id, window_us, {FEATURES}, gw_mac_flip, label, attack_type from windows")
def _(spark, d):
    path, came = disordered_windows(spark, d)
    closed = spark.read.parquet(f"{path}/windows").drop("batch").unionByName(jobs.open_windows(spark, path, came))
    late = spark.read.schema(came.schema).parquet(f"{path}/late")
    sane = came.where("gen_us <= arrival_us + 5000000")
    return jobs.fold_late(closed, late, sane)


@query("stream_row_counts", "select capture_id, count(*) filter (pkt_id % 1000 = 0) as ahead from packets group by 1 having count(*) filter (pkt_id % 1000 = 0) > 0")
def _(spark, d):
    path, came = disordered_windows(spark, d)
    return jobs.row_counts(spark, path, came).where("ahead > 0").select("capture_id", "ahead")


def live_actions(spark: SparkSession, d: str, rounds: int = 3) -> DataFrame:
    """Packets to windows to alerts to actions, each a stream that reads what the one before has written.

    Packets come in ``rounds`` rounds; in each round every stream takes up what is new. At
    the end the windows still open are written as they stand, and the round is run once more.
    """
    p = stage(packets(spark, d))
    source, out = folder(spark), folder(spark)
    size = p.agg(F.max("pkt_id")).first()[0] + 1
    made = windows.aggregate_windows(p.limit(0)).schema

    def chain() -> None:
        w = spark.readStream.schema(made).parquet(f"{out}/t2/windows/batch=*")
        alerts = jobs.stream_calibration(jobs.stream_score(w), calib_ms=CALIB_MS)
        jobs.start(alerts, jobs.to_table(f"{out}/t5"), f"{out}/t5-checkpoint").awaitTermination()
        mac = F.concat(F.lit("02:00:00:00:00:"), (F.col("window_us") / 100000 % 40).cast("int").cast("string")).alias("src_mac")
        latched = spark.readStream.schema(alerts.schema).parquet(f"{out}/t5/batch=*").where("alert = 1").select("capture_id", "window_us", mac)
        jobs.start(jobs.stream_throttle(latched), jobs.to_table(f"{out}/t8"), f"{out}/t8-checkpoint").awaitTermination()

    for k in range(rounds):
        part = p.where((F.col("pkt_id") >= size * k // rounds) & (F.col("pkt_id") < size * (k + 1) // rounds))
        part.write.mode("append").parquet(source)
        jobs.start(spark.readStream.schema(p.schema).parquet(source), jobs.windows_sink(f"{out}/t2"), f"{out}/t2-checkpoint").awaitTermination()
        chain()
    jobs.write_batch(jobs.open_windows(spark, f"{out}/t2", p), f"{out}/t2/windows", rounds)
    chain()
    return spark.read.parquet(f"{out}/t8")


@query("stream_alerts", "select capture_id, action_us from actions")
def _(spark, d):
    return live_actions(spark, d).select("capture_id", "action_us")


@query("stream_clock", "select capture_id, pkt_id, boot_id::bigint as boot_id, min_offset_us, aligned_us from aligned")
def _(spark, d):
    slim = packet_stream(spark, d).select("capture_id", "pkt_id", "arrival_us", "uptime_ms")
    return replayed(jobs.stream_clock(slim)).select("capture_id", "pkt_id", "boot_id", "min_offset_us", "aligned_us")


@query("stream_label", "select capture_id, pkt_id, label, attack_type from labelled")
def _(spark, d):
    """Packets and control messages come in four rounds by their arrival, as two streams in one state."""
    p = stage(packets(spark, d).select("capture_id", "pkt_id", "arrival_us", "uptime_ms"))
    control = stage(adapter.control_of(packets(spark, d)))
    first, last = p.agg(F.min("arrival_us"), F.max("arrival_us")).first()
    part = F.floor((F.col("arrival_us") - first) * 4 / F.lit(last - first + 1)).cast("int")
    clocked, out = folder(spark), folder(spark)

    def run(come: DataFrame, told: DataFrame) -> None:
        clock = jobs.stream_clock(come)
        jobs.start(clock, jobs.to_table(f"{clocked}/data"), f"{clocked}/checkpoint").awaitTermination()
        timed = spark.readStream.schema(clock.schema).parquet(f"{clocked}/data/batch=*")
        jobs.start(jobs.stream_live_label(timed, told), jobs.to_table(f"{out}/data"), f"{out}/checkpoint").awaitTermination()

    # A message before the first packet or after the last is of the first or the last round.
    in_rounds(spark, [(p.withColumn("batch", part), "batch"), (control.withColumn("batch", F.least(F.greatest(part, F.lit(0)), F.lit(3))), "batch")], 4, run)
    return spark.read.parquet(f"{out}/data").select("capture_id", "pkt_id", "label", "attack_type")


@query("stream_label_batches", "select capture_id, pkt_id, label, attack_type from labelled")
def _(spark, d):
    """The form that labels each batch by the control table."""
    control = stage(adapter.control_of(packets(spark, d)))
    slim = packet_stream(spark, d).select("capture_id", "pkt_id", "arrival_us", "uptime_ms")
    path = replay(jobs.stream_clock(slim), lambda p: jobs.label_sink(lambda: control, p))
    return spark.read.parquet(path).select("capture_id", "pkt_id", "label", "attack_type")


@query("stream_calibration", "select capture_id, window_us, calib, calib_thr, candidate, alert from alerts")
def _(spark, d):
    w = jobs.stream_score(table_stream(spark, quiet_windows(spark, d)))
    out = replayed(jobs.stream_calibration(w, calib_ms=CALIB_MS))
    return out.select("capture_id", "window_us", "calib", "calib_thr", "candidate", "alert")


@query("stream_score", "select capture_id, window_us, score as raw_prob, pred as raw_pred from tree_scores where tree = 'deployed'")
def _(spark, d):
    scored = replay_closed(packet_stream(spark, d), lambda p: jobs.stream_score(jobs.stream_windows(p)))
    return scored.select("capture_id", "window_us", "raw_prob", "raw_pred")


_ELASTIC = "capture_id, start_us, end_us, total_packets, packet_density, beacon_packets, deauth_packets, probe_packets, auth_packets, deauth_targeted, seq_jump, rssi_mean, snr_mean"


@query("stream_elastic_windows", ELASTIC_SQL)
def _(spark, d):
    return replayed(jobs.stream_elastic_windows(packet_stream(spark, d))).select(*_ELASTIC.split(", "))


@query("stream_gateway", """
select capture_id, conn, pkt_id, coalesce(sum(f) over (partition by capture_id, conn order by arrival_us, pkt_id), 0)::bigint as flips from (
select *, case when m is not null and m <> last_value(m ignore nulls) over (partition by capture_id, conn order by arrival_us, pkt_id
 rows between unbounded preceding and 1 preceding) then 1 else 0 end as f from (
select *, pkt_id // 3000 as conn, case when gw_mac not in ('', '-', '00:00:00:00:00:00') then gw_mac end as m from packets))""")
def _(spark, d):
    p = packet_stream(spark, d).select("capture_id", "pkt_id", "arrival_us", "gw_mac", F.floor(F.col("pkt_id") / 3000).alias("conn"))
    return replayed(jobs.stream_gateway(p)).select("capture_id", "conn", "pkt_id", "flips")


@query("stream_throttle", "select capture_id, action_us from actions")
def _(spark, d):
    alerts = alert_windows(spark, d).where("alert = 1").select(
        "capture_id", "window_us", F.concat(F.lit("02:00:00:00:00:"), (F.col("window_us") / 100000 % 40).cast("int").cast("string")).alias("src_mac")
    )
    return replayed(jobs.stream_throttle(table_stream(spark, alerts))).select("capture_id", "action_us")


@query("stream_device_state", DEVICE_STATE_SQL)
def _(spark, d):
    lines = addressed(adapter.lines_of(packet_stream(spark, d)))
    path = replay(jobs.stream_parse(lines), lambda p: lambda df, n: jobs.device_state_sink(p)(telemetry.accepted_lines(df), n))
    return jobs.latest_device_state(spark, path)


@query("stream_counters", "select capture_id, label, count(*) as n from packets group by 1, 2")
def _(spark, d):
    path = replay(jobs.stream_counters(packet_stream(spark, d)), jobs.counters_sink, "update")
    return jobs.latest_counters(spark, path)
