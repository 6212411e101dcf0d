"""Operators that follow the order of packets or windows.

All run through the cells of ``scan``: a capture is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.scan import (
    CELL, FIRST, HERE, Running, carry_window, cell_of, cell_window, change_count, join_carry,
    rolling_mean, running,
)
from airlens.operators.stage import stage

PACKET_CELL_US = 10_000_000
WINDOW_CELL_US = 3_600_000_000
SEQ_JUMP_LIMIT = 64
BOOT_DROP_US = 5_000_000


def inter_arrival(packets: DataFrame, time: str = "gen_us", order: str = "pkt_id", key: str = "capture_id", cell_rows: int = 1_000_000) -> DataFrame:
    """Microseconds since the frame received before; 0 for the first or a clock step back."""
    prev = F.col("_prev")
    out = running(packets, [key], [order], cell_of(order, cell_rows), [Running("_prev", "prev", F.col(time))])
    gap = F.when(prev.isNull() | (prev == 0) | (F.col(time) < prev), 0).otherwise(F.col(time) - prev)
    return out.withColumn("ipat", gap.cast("bigint")).drop("_prev")


def seq_jumps(packets: DataFrame, order: str = "pkt_id", key: str = "capture_id", cell_rows: int = 1_000_000) -> DataFrame:
    """Jump of the 12-bit sequence number against the last frame of 24 bytes or more."""
    numbered = F.when(F.col("frame_len") >= 24, F.col("seq").cast("bigint"))
    out = running(packets, [key], [order], cell_of(order, cell_rows), [Running("_prev", "prev", numbered)])
    step = F.pmod(F.col("seq").cast("bigint") - F.col("_prev"), F.lit(4096).cast("bigint"))
    jump = (F.col("frame_len") >= 24) & (step > SEQ_JUMP_LIMIT) & (step < 4096 - SEQ_JUMP_LIMIT)
    return out.withColumn("seq_jumped", F.coalesce(jump.cast("int"), F.lit(0))).drop("_prev")


def align_clock(
    packets: DataFrame,
    key: str = "capture_id",
    arrival: str = "arrival_us",
    row_no: str = "pkt_id",
    uptime_ms: str = "uptime_ms",
    cell_us: int = PACKET_CELL_US,
) -> DataFrame:
    """Boots and generation time of each line.

    A boot starts at the first line and where uptime falls by more than 5 s. The offset
    between the clocks is the least of ``arrival - uptime`` since the boot. One pass of
    cells carries the boot count, the last uptime and the least offset of the open boot.
    """
    keys, order = [key], [arrival, row_no]
    up_us = F.round(F.coalesce(F.col(uptime_ms).cast("double"), F.lit(0.0)) * 1000).cast("bigint")
    base = packets.withColumns({CELL: cell_of(arrival, cell_us), "_up": up_us}).withColumn(
        "_off", F.col(arrival) - F.col("_up")
    )
    w = cell_window(keys, order)
    upto = w.rowsBetween(FIRST, HERE)
    part = base.withColumns({"_prev": F.lag("_up").over(w), "_next": F.lead("_up").over(w)}).withColumn(
        "_boot", F.coalesce((F.col("_up") < F.col("_prev") - BOOT_DROP_US).cast("bigint"), F.lit(0))
    ).withColumn("_part", F.sum("_boot").over(upto))
    # A later boot has the smaller first field, so the least struct so far is the least offset of
    # the boot the row is in; one sort serves all windows.
    part = part.withColumn("_low", F.min(F.struct((-F.col("_part")).alias("p"), F.col("_off").alias("o"))).over(upto)["o"])

    cells = part.groupBy(key, CELL).agg(
        F.max("_part").alias("_n"),
        F.max(F.when(F.col("_prev").isNull(), F.col("_up"))).alias("_first"),
        F.max(F.when(F.col("_next").isNull(), F.col("_up"))).alias("_last"),
        F.max(F.when(F.col("_next").isNull(), F.col("_low"))).alias("_tail"),
    )
    along = Window.partitionBy(key).orderBy(CELL)
    edge = F.coalesce((F.col("_first") < F.lag("_last").over(along) - BOOT_DROP_US).cast("bigint"), F.lit(0))
    cells = cells.withColumn("_edge", edge).withColumn(
        "_boots", F.sum(F.col("_n") + F.col("_edge")).over(along.rowsBetween(FIRST, HERE))
    )
    same_boot = Window.partitionBy(key, "_boots").orderBy(CELL).rowsBetween(FIRST, HERE)
    cells = cells.withColumn("_open", F.min("_tail").over(same_boot))
    carry = cells.select(
        key, CELL, (F.col("_boots") - F.col("_n")).alias("_base"),
        F.when(F.col("_edge") == 0, F.lag("_open").over(along)).alias("_in"),
    )

    out = join_carry(part, carry, keys)
    least = F.when(F.col("_part") == 0, F.least("_low", "_in")).otherwise(F.col("_low"))
    return out.withColumns({
        "boot_id": F.col("_base") + F.col("_part") + 1,
        "min_offset_us": least,
        "aligned_us": least + F.col("_up"),
    }).drop(CELL, "_up", "_off", "_prev", "_next", "_boot", "_part", "_low", "_base", "_in")


def gateway_flips(
    packets: DataFrame,
    keys: tuple[str, ...] = ("capture_id",),
    order: tuple[str, ...] = ("arrival_us", "pkt_id"),
    mac: str = "gw_mac",
    cell_us: int = PACKET_CELL_US,
) -> DataFrame:
    """Running count of gateway MAC changes.

    ``keys`` should hold device and connection, so a new connection starts afresh.
    Unresolved and all-zero addresses are passed over.
    """
    known = F.when(~F.col(mac).isin("", "-", "00:00:00:00:00:00"), F.upper(mac))
    return change_count(
        packets, list(keys), list(order), cell_of(order[0], cell_us), known, lambda a, b: a != b, "flips"
    )


def thin(df: DataFrame, n: int, key: str = "capture_id", order: tuple[str, ...] = ("gen_us", "pkt_id"), cell_us: int = PACKET_CELL_US) -> DataFrame:
    """Every n-th packet of a device."""
    out = running(df, [key], list(order), cell_of(order[0], cell_us), [Running("_rn", "sum", F.lit(1))])
    return out.where(F.col("_rn") % n == 0).drop("_rn")


def first_attack(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    return windows.where("label = 1").groupBy(key).agg(F.min("window_us").alias("first_attack_us"))


def before_attack(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Normal windows ahead of the first attack of their capture."""
    return windows.join(first_attack(windows, key), key).where(
        "label = 0 and window_us < first_attack_us"
    )


def busy_peak(windows: DataFrame, key: str = "capture_id", cell_us: int = WINDOW_CELL_US, size: int = 20, least: int = 5) -> DataFrame:
    """Time of the densest stretch before the first attack, per capture."""
    early = stage(before_attack(windows, key).select(key, "window_us", "packet_density"))  # read for cells and for carries
    rolled = rolling_mean(
        early, [key], ["window_us"], cell_of("window_us", cell_us), "packet_density", size, least, "dens_roll"
    )
    at = F.when(F.col("dens_roll").isNotNull(), F.struct("dens_roll", -F.col("window_us")))
    return rolled.groupBy(key).agg(
        F.max_by("window_us", at).alias("peak_us"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") >= size).drop("_n")


def busy_windows(windows: DataFrame, key: str = "capture_id", around_us: int = 90_000_000, **kw) -> DataFrame:
    """Normal pre-attack windows within ``around_us`` of the density peak."""
    peaks = busy_peak(windows, key, **kw)
    return before_attack(windows, key).join(peaks, key).where(
        F.abs(F.col("window_us") - F.col("peak_us")) <= around_us
    )


def attack_spans(windows: DataFrame, key: str = "capture_id", cell_us: int = WINDOW_CELL_US) -> DataFrame:
    """Runs of attack windows as [start, end); end is the next normal window or the last row."""
    numbered = change_count(
        windows.select(key, "window_us", "label"), [key], ["window_us"], cell_of("window_us", cell_us),
        F.col("label"), lambda a, b: a != b, "_isle",
    )
    runs = numbered.groupBy(key, "_isle").agg(
        F.min("window_us").alias("start_us"), F.max("window_us").alias("_last"), F.max("label").alias("_label"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    follow = F.lead("start_us").over(Window.partitionBy(key).orderBy("_isle"))
    return runs.withColumn("end_us", F.coalesce(follow, F.col("_last"))).where("_label = 1").select(
        key, "start_us", "end_us", "n_windows"
    )


def chronological_prefix(windows: DataFrame, frac: float, key: str = "capture_id", cell_us: int = WINDOW_CELL_US) -> DataFrame:
    """Number the idle windows in time; the first ``frac`` calibrate."""
    idle = windows.where("attack_type = 'NONE'")
    ranked = running(idle, [key], ["window_us"], cell_of("window_us", cell_us), [Running("idle_no", "sum", F.lit(1))])
    sizes = idle.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(frac)))
    return ranked.join(sizes, key).withColumn("is_calib", F.col("idle_no") <= quota).drop("_n")


def attacker_list(actions: DataFrame, limit: int = 16, key: str = "capture_id", mac: str = "src_mac", time: str = "action_us") -> DataFrame:
    """The first ``limit`` distinct source addresses seen at an action."""
    seen = actions.where(F.col(mac).isNotNull()).groupBy(key, mac).agg(F.min(time).alias("first_us"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first_us", mac))
    return seen.withColumn("place", place).where(F.col("place") <= limit)


def elapsed_seconds(windows: DataFrame, key: str = "capture_id") -> DataFrame:
    """Seconds since the first window of the capture."""
    start = windows.groupBy(key).agg(F.min("window_us").alias("_t0"))
    return windows.join(start, key).withColumn(
        "elapsed_s", (F.col("window_us") - F.col("_t0")) / F.lit(1e6)
    ).drop("_t0")
