"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from airlens import schema as S
from airlens.operators import labels
from airlens.operators.rules import score_tree
from airlens.operators.stage import stage, staging
from airlens.operators.windows import aggregate_windows, finish_windows, packet_measures, per_type_aggs, per_window_aggs, window_of
from airlens.session import remove
from airlens.sources import captures, telemetry
from airlens.streaming import state, store

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch; a batch that is run again replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Run ``sink`` on each micro-batch; with ``once`` stop after what is there now."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    return lambda df, batch_id: write_batch(df, path, batch_id)


# ---- T1 --------------------------------------------------------------------------------

def stream_parse(lines: DataFrame) -> DataFrame:
    """Stateless parse of a stream of lines."""
    return telemetry.parse_telemetry(lines)


def parse_sink(accepted: str, quarantine: str) -> Callable[[DataFrame, int], None]:
    """Accepted rows to one table, unreadable lines to another."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        write_batch(telemetry.accepted_lines(df), accepted, batch_id)
        write_batch(telemetry.reject_lines(df), quarantine, batch_id)
        df.unpersist()

    return sink


# ---- T2, T10, T11 ----------------------------------------------------------------------

def stream_windows(packets: DataFrame, width_us: int = S.WINDOW_US, key: str = "capture_id", row_no: str = "pkt_id", late: str = "10 seconds") -> DataFrame:
    """Feature windows live, each emitted once the watermark passes it.

    The same two passes as in batch, as chained event-time aggregations: state holds sums
    per open window and attack type, never packets. One watermark holds for all devices and
    drops what comes behind it, so this form is for sources known to be in order within
    ``late``; ``windows_sink`` takes lines in any order and from any clock.
    """
    width = f"{width_us} microseconds"
    p = packet_measures(packets, width_us, row_no).withColumn("gen_time", F.timestamp_micros("gen_us"))
    by_type = p.withWatermark("gen_time", late).groupBy(F.window("gen_time", width).alias("_w"), key, "attack_type").agg(*per_type_aggs())
    folded = by_type.groupBy(F.window(F.window_time("_w"), width).alias("_w2"), key).agg(*per_window_aggs())
    return finish_windows(folded.withColumn("window_us", F.unix_micros("_w2.start")), width_us, key)


def windows_sink(
    path: str, width_us: int = S.WINDOW_US, key: str = "capture_id", row_no: str = "pkt_id",
    wait_us: int = 10_000_000, ahead_us: int = 5_000_000,
) -> Callable[[DataFrame, int], None]:
    """Feature windows live, losing no row.

    A device's windows close when its own lines have arrived up to ``wait_us`` past their
    end, so neither another device nor a clock that runs ahead closes them. Tables below
    ``path``, one folder a batch:

    * ``windows``: what has closed, by the batch aggregation;
    * ``open``: packets of windows still open, which the next batch takes up;
    * ``late``: packets whose window had closed before; ``fold_late`` works them in;
    * ``ahead``: packets generated more than ``ahead_us`` after they arrived, a clock fault;
    * ``frontier``: how far each device has come.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        with staging(df.sparkSession):
            take(stage(df), batch_id)  # read several times below, so computed once

    def take(df: DataFrame, batch_id: int) -> None:
        spark, at = df.sparkSession, lambda name, n: f"{path}/{name}/batch={n}"
        ahead = F.coalesce(F.col("gen_us") > F.col("arrival_us") + ahead_us, F.lit(False))
        write_batch(df.where(ahead), f"{path}/ahead", batch_id)
        end = window_of(F.col("gen_us"), width_us) + width_us
        known = f"{key} {dict(df.dtypes)[key]}, frontier_us long"
        before = spark.read.schema(known).parquet(at("frontier", batch_id - 1)) if batch_id else spark.createDataFrame([], known)
        sane = df.where(~ahead).join(before, key, "left").withColumn("_late", F.coalesce(end <= F.col("frontier_us"), F.lit(False))).drop("frontier_us")
        write_batch(sane.where("_late").drop("_late"), f"{path}/late", batch_id)
        come = df.where(~ahead).groupBy(key).agg((F.max("arrival_us") - wait_us).alias("frontier_us"))
        write_batch(before.unionByName(come).groupBy(key).agg(F.max("frontier_us").alias("frontier_us")), f"{path}/frontier", batch_id)
        held = sane.where(~F.col("_late")).drop("_late")
        if batch_id:
            held = held.unionByName(spark.read.schema(df.schema).parquet(at("open", batch_id - 1)))
        now = spark.read.schema(known).parquet(at("frontier", batch_id))
        held = held.join(now, key, "left").withColumn("_closed", F.coalesce(end <= F.col("frontier_us"), F.lit(False))).drop("frontier_us")
        write_batch(held.where(~F.col("_closed")).drop("_closed"), f"{path}/open", batch_id)
        write_batch(aggregate_windows(held.where("_closed").drop("_closed"), width_us, key, row_no), f"{path}/windows", batch_id)
        if batch_id > 1:  # the batch before stays for one that is run again
            for name in ("open", "frontier"):
                remove(spark, at(name, batch_id - 2))

    return sink


def open_windows(spark: SparkSession, path: str, packets: DataFrame, width_us: int = S.WINDOW_US, key: str = "capture_id", row_no: str = "pkt_id") -> DataFrame:
    """The windows that were still open after the last batch, as they stand; ``packets`` gives the columns."""
    rows = spark.read.schema(f"{_fields(packets)}, batch long").parquet(f"{path}/open")
    newest = rows.agg(F.max("batch")).first()[0]
    return aggregate_windows(rows.where(F.col("batch") == F.lit(newest)).drop("batch"), width_us, key, row_no)


def fold_late(windows: DataFrame, late: DataFrame, packets: DataFrame, width_us: int = S.WINDOW_US, key: str = "capture_id", row_no: str = "pkt_id") -> DataFrame:
    """``windows`` with those that ``late`` packets belong to computed anew from ``packets``, the table of all that came."""
    place = window_of(F.col("gen_us"), width_us)
    concerned = late.select(key, place.alias("window_us")).distinct()
    rows = packets.withColumn("window_us", place).join(concerned, [key, "window_us"], "left_semi").drop("window_us")
    return windows.join(concerned, [key, "window_us"], "left_anti").unionByName(aggregate_windows(rows, width_us, key, row_no))


def row_counts(spark: SparkSession, path: str, packets: DataFrame, key: str = "capture_id") -> DataFrame:
    """Late rows and rows ahead of their arrival, per device."""
    read = lambda name: spark.read.schema(f"{_fields(packets)}, batch long").parquet(f"{path}/{name}").select(key, F.lit(name).alias("_kind"))
    of = lambda name: F.count(F.when(F.col("_kind") == name, 1)).alias(name)
    return read("late").unionByName(read("ahead")).groupBy(key).agg(of("late"), of("ahead"))


def stream_score(windows: DataFrame, tree: str = "deployed") -> DataFrame:
    """Raw decision of a fixed tree on each window (T10); feeds ``stream_calibration``."""
    return score_tree(windows, tree)


def stream_counters(labelled: DataFrame, key: str = "capture_id") -> DataFrame:
    """Running totals per device and label, for update mode."""
    return labelled.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))


def counters_sink(path: str, key: str = "capture_id") -> Callable[[DataFrame, int], None]:
    """Totals of the devices a batch brings replace the older ones in a keyed store; totals only grow."""
    combine = lambda rows: rows.groupBy(key, "label").agg(F.max("n").alias("n"))
    return lambda df, batch_id: store.merge(path, [key], df.select(key, "label", "n"), combine, batch_id)


def latest_counters(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path)


# ---- T3, T9 ----------------------------------------------------------------------------

def label_sink(read_control: Callable[[], DataFrame], path: str, key: str = "capture_id") -> Callable[[DataFrame, int], None]:
    """Label a batch from the control messages known when it runs.

    Control goes to its table first, so a batch sees every message that came before its
    packets. Rows already written are never changed by a later STOP.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        spans = labels.control_to_spans(read_control(), key)
        write_batch(labels.label_packets(df, spans, key), path, batch_id)

    return sink


def device_state_sink(path: str, device: str = "host_mac") -> Callable[[DataFrame, int], None]:
    """Merge a batch into the keyed store of devices (T9); only the buckets of its devices are written.

    Every field keeps the time it was sent, so a batch that comes late doesn't undo newer values.
    """
    def sink(df: DataFrame, batch_id: int) -> None:
        store.merge(path, [device], captures.device_fields(df, device), lambda rows: captures.merge_device_fields(rows, device), batch_id)

    return sink


def latest_device_state(spark: SparkSession, path: str, device: str = "host_mac") -> DataFrame:
    return captures.device_values(store.read(spark, path), device)


# ---- T4-T8 -----------------------------------------------------------------------------

def _keyed(df: DataFrame, key: str, step: Callable, schema: str, kept: str, idle_ms: int | None) -> DataFrame:
    """A state function by device. A device silent for ``idle_ms`` of processing time leaves the store; without it all stay."""
    def run(group, batches, held):
        if held.hasTimedOut:
            held.remove()
            return
        yield from step(group, batches, held)
        if idle_ms is not None and held.exists:
            held.setTimeoutDuration(idle_ms)

    timeout = NO_TIMEOUT if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(key).applyInPandasWithState(run, schema, kept, "append", timeout)


def stream_live_label(packets: DataFrame, control: DataFrame, key: str = "capture_id", idle_ms: int | None = None, keep_us: int | None = None) -> DataFrame:
    """J1 with packets and control messages as two streams in one state.

    Messages and packets of a capture are taken in order of arrival, messages first where
    both are equal. A packet gets the label that the messages so far give it, so a STOP that
    comes after it changes nothing. A capture keeps its closed rounds; with ``keep_us`` those
    that ended longer ago than that before its newest arrival are dropped.
    """
    fields = ["pkt_id", "arrival_us", "aligned_us"]
    told = labels.parse_control(control).where(F.col("status").isin("START", "STOP"))
    none = lambda kind: F.lit(None).cast(kind)
    events = packets.select(key, *fields, none("string").alias("status"), none("string").alias("kind")).unionByName(told.select(
        key, F.col("seq_no").cast("long").alias("pkt_id"), "arrival_us", none("long").alias("aligned_us"), "status", F.col("attack_type").alias("kind")
    ))
    schema = f"`{key}` {dict(packets.dtypes)[key]}, pkt_id long, arrival_us long, aligned_us long, label int, attack_type string"
    return _keyed(events, key, state.live_labels(key, keep_us), schema, state.LABEL_STATE, idle_ms)


def stream_clock(packets: DataFrame, key: str = "capture_id", idle_ms: int | None = None) -> DataFrame:
    """Boots and generation time live (T4)."""
    schema = f"{_fields(packets)}, boot_id long, min_offset_us long, aligned_us long"
    return _keyed(packets, key, state.clock(packets.columns, key), schema, state.CLOCK_STATE, idle_ms)


def stream_calibration(windows: DataFrame, key: str = "capture_id", idle_ms: int | None = None, **settings) -> DataFrame:
    """Calibrated, latched alerts live (T5); needs ``raw_pred``."""
    schema = f"{_fields(windows)}, calib string, calib_thr double, candidate int, alert int"
    return _keyed(windows, key, state.calibration(windows.columns, **settings), schema, state.CALIBRATION_STATE, idle_ms)


def stream_elastic_windows(packets: DataFrame, key: str = "capture_id", width_us: int = S.WINDOW_US, idle_ms: int | None = None) -> DataFrame:
    """Sensor-side windows live."""
    slim = packets.select(key, "gen_us", "pkt_id", "subtype", "rssi", "snr", "deauth_tgt", "seq_jump")
    kind = dict(slim.dtypes)[key]
    return _keyed(slim, key, state.elastic(key, width_us), f"`{key}` {kind}, {state.ELASTIC_OUTPUT}", state.ELASTIC_STATE, idle_ms)


def stream_gateway(packets: DataFrame, key: str = "capture_id", idle_ms: int | None = None) -> DataFrame:
    """Gateway changes live (T7); needs ``conn``, the connection number."""
    return _keyed(packets, key, state.gateway(packets.columns), f"{_fields(packets)}, flips long", state.GATEWAY_STATE, idle_ms)


def stream_throttle(alerts: DataFrame, key: str = "capture_id", gap_us: int = 2_000_000, limit: int = 16, idle_ms: int | None = None) -> DataFrame:
    """Throttled actions and listed addresses live."""
    kind = dict(alerts.dtypes)[key]
    schema = f"`{key}` {kind}, action_us long, src_mac string, newly_listed boolean"
    return _keyed(alerts, key, state.throttle(key, gap_us, limit), schema, state.THROTTLE_STATE, idle_ms)
