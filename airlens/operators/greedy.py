"""Greedy marks: a row is marked when it lies ``width`` or more after the last mark.

Used for sensor-side windows (A3) and for throttled actions (W13). Each mark depends on
the one before, yet the chain need not run through one task. A cell is first reduced to
a table "last mark before the cell -> last mark after it"; only rows within ``width`` of the
cell's start make a difference, so the table is short. The tables are chained, in blocks of
cells and then over blocks, and every cell is marked with its own known start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens import schema as S
from airlens.functions.scalars import running_variance, subtype_class
from airlens.operators.scan import CELL, cell_of

_ANY = -2  # the cell ends in the same mark whatever came before
_OLD = -1  # the last mark is at least ``width`` before the cell


def _last_marks(times: np.ndarray, width: int) -> np.ndarray:
    """Index of the last mark of the chain that starts at each index."""
    step = np.searchsorted(times, times + width)
    step = np.where(step == len(times), np.arange(len(times)), step)
    while True:
        wider = step[step]
        if np.array_equal(wider, step):
            return step
        step = wider


def _cell_table(width: int):
    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf.loc[~pdf["_lent"], "_t"].to_numpy())
        head = {c: pdf[c].iloc[0] for c in ("_k", CELL)}
        if not len(own):
            return pd.DataFrame({"_k": pd.Series(dtype=object), CELL: [], "_from": [], "_to": []})
        entry = np.concatenate([[_OLD], np.unique(pdf.loc[pdf["_lent"], "_t"].to_numpy())]).astype("int64")
        last = _last_marks(own, width)
        at = np.where(entry == _OLD, 0, np.searchsorted(own, entry + width))
        to = np.where(at < len(own), own[last[np.minimum(at, len(own) - 1)]], _OLD)
        if (to == to[0]).all() and to[0] != _OLD:
            entry, to = np.array([_ANY]), to[:1]
        return pd.DataFrame({**head, "_from": entry, "_to": to})

    return table


def _walk(tables: pd.DataFrame, at: int, width: int, cell_us: int) -> Iterator[tuple[int, int, int]]:
    """(cell, mark before, mark after) along the sorted tables of consecutive cells."""
    for cell, rows in tables.groupby(CELL, sort=True):
        source, target = rows["_from"].to_numpy(), rows["_to"].to_numpy()
        if source[0] == _ANY:
            after = target[0]
        else:
            key = at if at > cell * cell_us - width else _OLD
            after = target[source == key][0]
        before, at = at, int(at if after == _OLD else after)
        yield int(cell), int(before), at


def _block_table(width: int, cell_us: int):
    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf[CELL] == pdf[CELL].min()]
        starts = [_OLD] if first["_from"].iloc[0] == _ANY else first["_from"].tolist()
        ends = [list(_walk(pdf, s, width, cell_us))[-1][2] for s in starts]
        return pd.DataFrame({
            "_k": pdf["_k"].iloc[0], "_block": pdf["_block"].iloc[0], "_cell0": first[CELL].iloc[0],
            "_from": starts, "_to": ends, "_any": first["_from"].iloc[0] == _ANY,
        })

    return table


def _block_starts(width: int, cell_us: int):
    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = pdf.rename(columns={"_cell0": CELL})
        tables["_from"] = tables["_from"].where(~tables["_any"], _ANY)
        block = dict(zip(tables[CELL], tables["_block"]))
        rows = [(block[c], before) for c, before, _ in _walk(tables, _OLD, width, cell_us)]
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], "_block": [r[0] for r in rows], "_start": [r[1] for r in rows]})

    return starts


def _cell_starts(width: int, cell_us: int):
    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(c, before) for c, before, _ in _walk(pdf, int(pdf["_start"].iloc[0]), width, cell_us)]
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], CELL: [r[0] for r in rows], "_start": [r[1] for r in rows]})

    return starts


def _mark(width: int, time: str, order: list[str], columns: list[str]):
    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        t, at = pdf[time].to_numpy(), int(pdf["_start"].iloc[0])
        marks, i = [], 0 if at == _OLD else int(np.searchsorted(t, at + width))
        while i < len(t):
            marks.append(i)
            i = int(np.searchsorted(t, t[i] + width))
        place = np.arange(len(t))
        earlier = np.searchsorted(marks, place, side="left")
        before = np.where(earlier > 0, t[np.array([0, *marks])[earlier]], at)
        is_mark = np.isin(place, marks)
        out = pdf[columns].copy()
        out["is_mark"], out["last_mark_us"] = is_mark, before
        return out

    return mark


def greedy_marks(
    df: DataFrame,
    width_us: int,
    key: str = "capture_id",
    order: tuple[str, ...] = ("gen_us", "pkt_id"),
    cell_us: int = 10_000_000,
    block: int = 1024,
) -> DataFrame:
    """Add ``is_mark`` and ``last_mark_us`` (the mark strictly before the row, -1 if none).

    The first row of a group is a mark. ``order[0]`` is the time in microseconds and
    ``cell_us`` must not be less than ``width_us``.
    """
    if cell_us < width_us:
        raise ValueError("cell_us must be at least width_us")
    time = order[0]
    columns = df.columns
    text_key = F.col(key).cast("string")
    rows = df.withColumns({"_k": text_key, CELL: cell_of(time, cell_us)})
    near_end = F.col(time) >= (F.col(CELL) + 1) * cell_us - width_us
    lent = F.when(near_end, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    times = rows.select(
        "_k", CELL, F.col(time).alias("_t"), F.explode(lent).alias("_lent")
    ).withColumn(CELL, F.col(CELL) + F.col("_lent").cast("int"))
    tables = times.groupBy("_k", CELL).applyInPandas(
        _cell_table(width_us), f"_k string, {CELL} long, _from long, _to long"
    ).withColumn("_block", F.floor(F.col(CELL) / block).cast("bigint"))
    blocks = tables.groupBy("_k", "_block").applyInPandas(
        _block_table(width_us, cell_us), "_k string, _block long, _cell0 long, _from long, _to long, _any boolean"
    )
    block_starts = blocks.groupBy("_k").applyInPandas(
        _block_starts(width_us, cell_us), "_k string, _block long, _start long"
    )
    cell_starts = tables.join(block_starts, ["_k", "_block"]).groupBy("_k", "_block").applyInPandas(
        _cell_starts(width_us, cell_us), f"_k string, {CELL} long, _start long"
    )
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.join(cell_starts, ["_k", CELL]).groupBy("_k", CELL).applyInPandas(
        _mark(width_us, time, list(order), columns), f"{types}, is_mark boolean, last_mark_us long"
    )


def elastic_windows(
    packets: DataFrame,
    width_us: int = S.WINDOW_US,
    key: str = "capture_id",
    order: tuple[str, ...] = ("gen_us", "pkt_id"),
    **kw,
) -> DataFrame:
    """Sensor-side windows: closed by the first packet ``width`` after the start (A3).

    The closing packet belongs to the window it closes and its time starts the next one.
    All packets enter the signal means. The window still open at the end is not emitted.
    """
    time = order[0]
    need = [key, *order, "subtype", "rssi", "snr", "deauth_tgt", "seq_jump"]
    marked = greedy_marks(packets.select(*need), width_us, key, order, **kw)
    start = F.when(F.col("last_mark_us") == _OLD, F.col(time)).otherwise(F.col("last_mark_us"))
    kind = subtype_class(F.col("subtype"))
    one = lambda cond: F.count(F.when(cond, 1)).cast("double")
    closes = F.col("is_mark") & (F.col("last_mark_us") != _OLD)
    w = marked.withColumns({"start_us": start, "_kind": kind}).groupBy(key, "start_us").agg(
        F.max(F.when(closes, F.col(time))).alias("end_us"),
        F.count(F.lit(1)).cast("double").alias("total_packets"),
        *[one(F.col("_kind") == k).alias(f"{k}_packets") for k in ("beacon", "deauth", "probe", "auth")],
        one(F.col("deauth_tgt") >= 1).alias("deauth_targeted"),
        one(F.col("seq_jump") >= 1).alias("seq_jump"),
        F.sum("rssi").alias("_s"), F.sum(F.col("rssi") * F.col("rssi")).alias("_q"), F.sum("snr").alias("_r"),
    ).where(F.col("end_us").isNotNull())
    n = F.col("total_packets")
    mean = F.col("_s") / n
    return w.withColumns({
        "packet_density": n / ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)),
        "rssi_mean": mean,
        "rssi_var": running_variance(F.col("_q") / n, mean),
        "snr_mean": F.col("_r") / n,
    }).drop("_s", "_q", "_r")


def throttle_alerts(
    alerts: DataFrame,
    gap_us: int = 2_000_000,
    key: str = "capture_id",
    order: tuple[str, ...] = ("window_us",),
    cell_us: int = 3_600_000_000,
) -> DataFrame:
    """Alerts that lead to an action: at most one per ``gap_us``, counted from the last action."""
    marked = greedy_marks(alerts, gap_us, key, order, cell_us=cell_us)
    return marked.where("is_mark").drop("is_mark", "last_mark_us")
