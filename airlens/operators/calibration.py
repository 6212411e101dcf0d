"""Site calibration and alert latching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.operators.ordered import WINDOW_CELL_US, chronological_prefix
from airlens.operators.quantiles import quantiles
from airlens.operators.scan import CELL, FIRST, HERE, carry_window, cell_of, cell_window, join_carry
from airlens.operators.stage import stage


def idle_baseline(windows: DataFrame, k: float = S.CALIB_K, frac: float = 0.3, key: str = "capture_id") -> DataFrame:
    """Idle statistics and the relative threshold ``max(k * p90, 1)`` per capture."""
    return baseline_of(ranked_idle(windows, frac, key), k, key)


def ranked_idle(windows: DataFrame, frac: float = 0.3, key: str = "capture_id") -> DataFrame:
    """Idle windows numbered in time, staged, since baselines read them several times."""
    return stage(chronological_prefix(windows.select(key, "window_us", "attack_type", "total_packets"), frac, key))


def baseline_of(ranked: DataFrame, k: float = S.CALIB_K, key: str = "capture_id") -> DataFrame:
    """The idle statistics of ``ranked_idle`` windows."""
    sizes = ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_idle"), F.avg("total_packets").alias("total_mean"),
        F.count(F.when(F.col("is_calib"), 1)).alias("n_calib"),
    )
    every = quantiles(ranked, [key], "total_packets", {"total_p90": 0.9})
    calib = quantiles(ranked.where("is_calib"), [key], "total_packets", {"calib_p50": 0.5, "calib_p90": 0.9})
    return sizes.join(every, key).join(calib, key).withColumn(
        "threshold", F.greatest(F.col("calib_p90") * F.lit(k), F.lit(1.0))
    )


def join_thresholds(windows: DataFrame, baseline: DataFrame, key: str = "capture_id") -> DataFrame:
    """Each capture's threshold on all its windows; captures without one get none."""
    return windows.join(baseline.select(key, "threshold"), key, "left")


def is_deauth_path() -> Column:
    return (F.col("deauth_packets") > 0.5) | (F.col("deauth_targeted") > 0.5)


def ring_baseline(
    windows: DataFrame,
    key: str = "capture_id",
    calib_ms: int = S.CALIB_MS,
    k: float = S.CALIB_K,
    ring: int = S.CALIB_RING,
    least: int = S.CALIB_MIN_SAMPLES,
) -> DataFrame:
    """When each sensor arms, its p90 and threshold, from its last quiet totals.

    A sensor arms on the first window that is ``calib_ms`` after its first one and has
    ``least`` quiet windows up to it. Both row-number filters keep at most ``ring`` rows per
    sensor in each task before the shuffle.
    """
    w = windows.select(key, "window_us", "total_packets", is_deauth_path().alias("_loud"))
    quiet = w.where(~F.col("_loud")).drop("_loud")
    start = w.groupBy(key).agg(F.min("window_us").alias("_t0"))
    timed = w.join(start, key).where(F.col("window_us") - F.col("_t0") >= calib_ms * 1000).groupBy(key).agg(
        F.min("window_us").alias("_a")
    )
    first = Window.partitionBy(key).orderBy("window_us")
    enough = quiet.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= least).groupBy(key).agg(
        F.max("window_us").alias("_b"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") == least)
    armed = timed.join(enough, key).select(key, F.greatest("_a", "_b").alias("armed_us"))
    latest = Window.partitionBy(key).orderBy(F.desc("window_us"))
    held = quiet.join(armed, key).where(F.col("window_us") <= F.col("armed_us")).withColumn(
        "_rn", F.row_number().over(latest)
    ).where(F.col("_rn") <= ring)
    total = F.col("total_packets").cast("float").cast("double")
    # The ring holds at most ``ring`` values, so the sorted list is small.
    return held.groupBy(key, "armed_us").agg(F.sort_array(F.collect_list(total)).alias("_s")).select(
        key, "armed_us", F.size("_s").alias("n_samples"),
        F.element_at("_s", F.floor((F.size("_s") - 1) * 9 / 10).cast("int") + 1).alias("p90"),
    ).withColumn("threshold", F.greatest(F.col("p90") * F.lit(k), F.lit(1.0)))


def streak_latch(
    df: DataFrame,
    candidate: Column,
    need: Column,
    key: str = "capture_id",
    order: tuple[str, ...] = ("window_us",),
    clear: int = S.CALIB_CLEAR_STREAK,
    cell: Column | None = None,
    name: str = "alert",
) -> DataFrame:
    """Latch after ``need`` candidates in a row, release after ``clear`` others in a row.

    ``need`` is read from the current row. Per cell the summary keeps its first run, its last
    run and its last set or clear event, which is enough to carry run length and latch on.
    """
    keys = [key]
    cell = cell_of(order[0], WINDOW_CELL_US) if cell is None else cell
    w = cell_window(keys, order)
    upto = w.rowsBetween(FIRST, HERE)
    c, i, run = F.col("_c"), F.col("_i"), F.col("_run")
    rows = df.withColumns({
        CELL: cell, "_c": candidate.cast("int"), "_need": F.greatest(need, F.lit(1)).cast("bigint"),
    }).withColumn("_i", F.row_number().over(w).cast("bigint"))
    other = F.when(c == 1, F.max(F.when(c == 0, i)).over(upto)).otherwise(F.max(F.when(c == 1, i)).over(upto))
    rows = rows.withColumn("_other", F.coalesce(other, F.lit(0))).withColumns({
        "_run": i - F.col("_other"), "_lead": F.col("_other") == 0,
    })

    def event(length: Column) -> Column:
        return F.when((c == 1) & (length >= F.col("_need")), 1).when((c == 0) & (length >= clear), 0)

    late = F.when(~F.col("_lead"), event(run))
    cells = rows.withColumn("_late", late).groupBy(key, CELL).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(c, i).alias("_c0"), F.max_by(c, i).alias("_c1"),
        F.max(F.when(F.col("_lead"), i)).alias("_len"), F.max_by(run, i).alias("_tail"),
        F.max(F.when(F.col("_lead") & (c == 1), i - F.col("_need"))).alias("_slack"),
        F.max_by("_late", F.when(F.col("_late").isNotNull(), i)).alias("_ev"),
    )
    along = Window.partitionBy(key).orderBy(CELL)
    joined = F.coalesce(F.lag("_c1").over(along) == F.col("_c0"), F.lit(False))
    cells = cells.withColumn("_joined", joined)
    whole = F.col("_joined") & (F.col("_len") == F.col("_n"))
    cells = cells.withColumn("_isle", F.sum((~whole).cast("int")).over(along.rowsBetween(FIRST, HERE)))
    isle = Window.partitionBy(key, "_isle").orderBy(CELL).rowsBetween(FIRST, HERE)
    cells = cells.withColumn("_total", F.sum("_tail").over(isle))
    cells = cells.withColumn("_k", F.when(F.col("_joined"), F.lag("_total").over(along)).otherwise(F.lit(0)))
    lead_event = F.when((F.col("_c0") == 1) & (F.col("_slack") + F.col("_k") >= 0), 1).when(
        (F.col("_c0") == 0) & (F.col("_len") + F.col("_k") >= clear), 0
    )
    cells = cells.withColumn("_ev", F.coalesce("_ev", lead_event))
    carry = cells.select(
        key, CELL, "_k", F.coalesce(F.last("_ev", ignorenulls=True).over(carry_window(keys)), F.lit(0)).alias("_in")
    )
    out = join_carry(rows, carry, keys)
    length = run + F.when(F.col("_lead"), F.col("_k")).otherwise(0)
    out = out.withColumn("_event", event(length)).withColumn(
        name, F.coalesce(F.last("_event", ignorenulls=True).over(upto), F.col("_in")).cast("int")
    )
    return out.drop(CELL, "_c", "_need", "_i", "_other", "_run", "_lead", "_k", "_in", "_event")


def calibrated_alerts(
    windows: DataFrame,
    raw: str = "raw_pred",
    key: str = "capture_id",
    enabled: bool = True,
    cell: Column | None = None,
    k: float = S.CALIB_K,
    calib_ms: int = S.CALIB_MS,
    streak: int = S.CALIB_STREAK,
    deauth_streak: int = S.CALIB_DEAUTH_STREAK,
    clear: int = S.CALIB_CLEAR_STREAK,
    ring: int = S.CALIB_RING,
    least: int = S.CALIB_MIN_SAMPLES,
) -> DataFrame:
    """Gate raw predictions by the sensor's own baseline, then latch.

    Adds ``calib`` (OFF, CALIB, ARMED), ``calib_thr``, ``candidate`` and ``alert``. While
    calibrating nothing is a candidate; the arming window itself is already judged. Once
    armed, the deauth path passes the raw prediction on and any other window must also
    exceed the threshold.
    """
    if not enabled:
        return windows.withColumns({
            "calib": F.lit("OFF"), "calib_thr": F.lit(1.0), "candidate": (F.col(raw) != 0).cast("int"),
            "alert": (F.col(raw) != 0).cast("int"),
        })
    windows = stage(windows)
    base = stage(ring_baseline(windows, key, calib_ms, k, ring, least)).select(key, "armed_us", "threshold")
    armed = F.coalesce(F.col("window_us") >= F.col("armed_us"), F.lit(False))
    w = windows.join(base, key, "left").withColumn("_armed", armed)
    thr = F.when(F.col("_armed"), F.col("threshold")).otherwise(1.0)
    passed = is_deauth_path() | (F.col("total_packets") > F.col("threshold"))
    w = w.withColumns({
        "calib": F.when(F.col("_armed"), "ARMED").otherwise("CALIB"),
        "calib_thr": thr,
        "candidate": F.coalesce((F.col("_armed") & (F.col(raw) != 0) & passed).cast("int"), F.lit(0)),
    })
    need = F.when(is_deauth_path(), deauth_streak).otherwise(streak)
    out = streak_latch(w, F.col("candidate"), need, key, clear=clear, cell=cell)
    return out.drop("armed_us", "threshold", "_armed")


def veto_report(alerts: DataFrame, raw: str = "raw_pred") -> DataFrame:
    """Windows the raw rule flagged and the gate held back, by state and type."""
    return alerts.where((F.col(raw) == 1) & (F.col("alert") == 0)).groupBy("calib", "attack_type").agg(
        F.count(F.lit(1)).alias("n_vetoed")
    )
