"""Per-device state functions for ``applyInPandasWithState``.

Each function gets the rows of one device in one micro-batch, sorts them, and goes on from
the state the batch before left. A micro-batch is bounded by the source's rate options
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), so the rows of one device in it are too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from airlens import schema as S

Rows = Iterator[pd.DataFrame]


def _sorted(batches: Rows, order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)


CLOCK_STATE = "last_up long, low long, boot long"


def clock(columns: list[str], key: str, boot_drop_us: int = 5_000_000) -> Callable:
    """Boot number, least offset and generation time of each line (T4)."""
    def step(_, batches: Rows, state) -> Rows:
        pdf = _sorted(batches, ["arrival_us", "pkt_id"])
        last, low, boot = state.get if state.exists else (None, None, 0)
        up = np.rint(pdf["uptime_ms"].fillna(0).to_numpy(dtype=float) * 1000).astype("int64")
        before = np.concatenate([[up[0] + 2 * boot_drop_us if last is None else last], up[:-1]])
        boots = boot + np.cumsum(up < before - boot_drop_us)
        offset = pd.Series(pdf["arrival_us"].to_numpy() - up)
        least = offset.groupby(boots).cummin().to_numpy()
        if low is not None:
            least = np.where(boots == boot, np.minimum(least, low), least)
        state.update((int(up[-1]), int(least[-1]), int(boots[-1])))
        yield pdf[columns].assign(boot_id=boots, min_offset_us=least, aligned_us=least + up)

    return step


LABEL_STATE = "open_us long, open_kind string, starts array<long>, ends array<long>, kinds array<string>, newest long"


def first_rounds(starts: list[int], ends: list[int], times: np.ndarray) -> np.ndarray:
    """Place in the list of the first round that each time lies in, both ends included; the number of rounds if there is none.

    Rounds may lie in any order and overlap. Each is a stretch of the sorted times, put down as two stretches of
    2^k that cover it; level by level, the first round of a stretch goes on to both its halves.
    """
    order = np.argsort(times, kind="stable")
    lo = np.searchsorted(times[order], np.array(starts, dtype=float), "left")
    hi = np.searchsorted(times[order], np.array(ends, dtype=float), "right")
    place = np.flatnonzero(hi > lo)
    lo, hi = lo[place], hi[place]
    level = np.frexp(hi - lo)[1] - 1
    first = np.full(len(times), len(starts))
    for k in range(level.max(initial=-1), -1, -1):
        here = level == k
        np.minimum.at(first, lo[here], place[here])
        np.minimum.at(first, hi[here] - (1 << k), place[here])
        if k:
            half = 1 << (k - 1)
            first[half:] = np.minimum(first[half:], first[:-half])
    found = np.empty_like(first)
    found[order] = first
    return found


def live_labels(key: str, keep_us: int | None) -> Callable:
    """Label of each packet by the control messages that came before it (T3); rows with a status are messages.

    A packet's number of messages before it says which rounds were closed then, the first ones of the list, and which
    was open. So one look for the first round of all that a packet lies in does for any number of messages.
    """
    def step(group, batches: Rows, state) -> Rows:
        events = pd.concat(list(batches), ignore_index=True)
        events["told"] = events["status"].isna()  # messages first
        events = events.sort_values(["arrival_us", "told", "pkt_id"], kind="stable").reset_index(drop=True)
        if state.exists:
            open_us, open_kind, starts, ends, kinds, newest = state.get
            starts, ends, kinds = list(starts), list(ends), list(kinds)
        else:
            open_us, open_kind, starts, ends, kinds, newest = None, None, [], [], [], 0
        packets = events["told"].to_numpy()
        messages = events.loc[~packets, ["arrival_us", "status", "kind"]].astype({"arrival_us": "int64"})
        closed, opened = [len(ends)], [(open_us, open_kind)]  # after each number of messages
        for when, status, kind in messages.itertuples(index=False, name=None):
            if status == "START":
                open_us, open_kind = when, kind
            elif open_us is not None:
                starts.append(open_us)
                ends.append(when)
                kinds.append(open_kind)
                open_us = open_kind = None
            closed.append(len(ends))
            opened.append((open_us, open_kind))
        out = events.loc[packets, ["pkt_id", "arrival_us", "aligned_us"]]
        times, before = out["aligned_us"].to_numpy(dtype=float), np.cumsum(~packets)[packets]
        first = first_rounds(starts, ends, times)
        inside = first < np.array(closed)[before]  # the earliest round has the last word, an open one is the latest
        running = ~inside & (times >= np.array([np.nan if us is None else us for us, _ in opened])[before])
        found = np.full(len(out), "NONE", dtype=object)
        found[inside] = np.array(kinds, dtype=object)[first[inside]]
        found[running] = np.array([kind for _, kind in opened], dtype=object)[before[running]]
        newest = max(newest, int(events["arrival_us"].max()))
        if keep_us is not None:
            kept = [i for i, end in enumerate(ends) if end >= newest - keep_us]
            starts, ends, kinds = ([x[i] for i in kept] for x in (starts, ends, kinds))
        state.update((open_us, open_kind, starts, ends, kinds, newest))
        out = out.astype("int64")
        yield out.assign(**{key: group[0], "label": (inside | running).astype("int32"), "attack_type": found})[[key, "pkt_id", "arrival_us", "aligned_us", "label", "attack_type"]]

    return step


CALIBRATION_STATE = (
    "started long, ring array<double>, armed boolean, p90 double, thr double, pos int, neg int, latched int"
)


def calibration(
    columns: list[str], calib_ms: int = S.CALIB_MS, k: float = S.CALIB_K, ring_size: int = S.CALIB_RING,
    least: int = S.CALIB_MIN_SAMPLES, streak: int = S.CALIB_STREAK, deauth_streak: int = S.CALIB_DEAUTH_STREAK,
    clear: int = S.CALIB_CLEAR_STREAK,
) -> Callable:
    """Arming, gated candidate and latched alert of each window (T5)."""
    def step(_, batches: Rows, state) -> Rows:
        pdf = _sorted(batches, ["window_us"])
        if state.exists:
            started, ring, armed, p90, thr, pos, neg, latched = state.get
            ring = list(ring)
        else:
            started, ring, armed, p90, thr, pos, neg, latched = int(pdf["window_us"].iloc[0]), [], False, 0.0, 1.0, 0, 0, 0
        loud = ((pdf["deauth_packets"] > 0.5) | (pdf["deauth_targeted"] > 0.5)).tolist()
        out = []
        for at, total, raw, is_loud in zip(pdf["window_us"], pdf["total_packets"], pdf["raw_pred"], loud):
            if not armed:
                if not is_loud:
                    ring = [*ring, float(np.float32(total))][-ring_size:]
                if at - started >= calib_ms * 1000 and len(ring) >= least:
                    p90 = sorted(ring)[(len(ring) - 1) * 9 // 10]
                    thr, armed = max(k * p90, 1.0), True
            candidate = int(armed and raw != 0 and (is_loud or total > thr))
            if armed:
                pos, neg = (pos + 1, 0) if candidate else (0, neg + 1)
                if candidate and pos >= max(deauth_streak if is_loud else streak, 1):
                    latched = 1
                elif not candidate and neg >= clear:
                    latched = 0
            out.append(("ARMED" if armed else "CALIB", thr, candidate, latched))
        state.update((started, ring, armed, float(p90), float(thr), pos, neg, latched))
        calib, thr_col, cand, alert = zip(*out)
        yield pdf[columns].assign(calib=calib, calib_thr=thr_col, candidate=cand, alert=alert)

    return step


_SUMS = ("n", "beacon", "deauth", "probe", "auth", "tgt", "jump", "rssi", "rssi2", "snr")
ELASTIC_STATE = "started long, sums array<double>"
ELASTIC_OUTPUT = (
    "start_us long, end_us long, total_packets double, packet_density double, beacon_packets double, deauth_packets double,"
    " probe_packets double, auth_packets double, deauth_targeted double, seq_jump double, rssi_mean double, rssi_var double, snr_mean double"
)


def elastic(key: str, width_us: int = S.WINDOW_US) -> Callable:
    """Sensor-side windows, with the open one kept as sums."""
    def step(group, batches: Rows, state) -> Rows:
        pdf = _sorted(batches, ["gen_us", "pkt_id"])
        t, sub = pdf["gen_us"].to_numpy(), pdf["subtype"].fillna("").str.strip()
        parts = (
            np.ones(len(t)), sub == "BEACON", sub.isin(["DEAUTH", "DISASSOC"]), sub.str.startswith("PROBE"), sub == "AUTH",
            pdf["deauth_tgt"] >= 1, pdf["seq_jump"] >= 1, pdf["rssi"], pdf["rssi"] ** 2, pdf["snr"],
        )
        values = np.column_stack([np.asarray(p, dtype=float) for p in parts])
        started, held = state.get if state.exists else (int(t[0]), [0.0] * len(_SUMS))
        at, rows, held = 0, [], np.array(held)
        while True:
            close = int(np.searchsorted(t, started + width_us))
            if close >= len(t):
                break
            sums = held + values[at:close + 1].sum(axis=0)
            rows.append((group[0], started, int(t[close]), *sums))
            started, at, held = int(t[close]), close + 1, np.zeros(len(_SUMS))
        state.update((started, (held + values[at:].sum(axis=0)).tolist()))
        w = pd.DataFrame(rows, columns=[key, "start_us", "end_us", *_SUMS])
        mean = w["rssi"] / w["n"]
        yield pd.DataFrame({
            key: w[key], "start_us": w["start_us"], "end_us": w["end_us"], "total_packets": w["n"],
            "packet_density": w["n"] / ((w["end_us"] - w["start_us"]) / 1e6),
            "beacon_packets": w["beacon"], "deauth_packets": w["deauth"], "probe_packets": w["probe"], "auth_packets": w["auth"],
            "deauth_targeted": w["tgt"], "seq_jump": w["jump"], "rssi_mean": mean,
            "rssi_var": (w["rssi2"] / w["n"] - mean * mean).clip(lower=0), "snr_mean": w["snr"] / w["n"],
        })

    return step


GATEWAY_STATE = "mac string, flips long, conn long"


def gateway(columns: list[str]) -> Callable:
    """Running gateway changes; a new connection starts afresh."""
    def step(_, batches: Rows, state) -> Rows:
        pdf = _sorted(batches, ["arrival_us", "pkt_id"])
        mac, flips, conn = state.get if state.exists else (None, 0, None)
        known = pdf["gw_mac"].str.upper().where(~pdf["gw_mac"].isin(["", "-", "00:00:00:00:00:00"]))
        counts = []
        for this, part in known.groupby(pdf["conn"], sort=False):
            if conn != this:
                mac, flips, conn = None, 0, int(this)
            seen = part.dropna()
            changed = seen != seen.shift(1, fill_value=mac)
            if mac is None and len(seen):
                changed.iloc[0] = False
            counts.append((changed.astype("int64").reindex(part.index, fill_value=0)).cumsum() + flips)
            flips = int(counts[-1].iloc[-1])
            mac = seen.iloc[-1] if len(seen) else mac
        state.update((mac, flips, conn))
        yield pdf[columns].assign(flips=pd.concat(counts).astype("int64"))

    return step


THROTTLE_STATE = "last long, macs array<string>"


def throttle(key: str, gap_us: int = 2_000_000, limit: int = 16) -> Callable:
    """Actions at most every ``gap_us`` and the first ``limit`` addresses seen at them."""
    def step(group, batches: Rows, state) -> Rows:
        pdf = _sorted(batches, ["window_us"])
        last, macs = state.get if state.exists else (None, [])
        macs, t, rows = list(macs), pdf["window_us"].to_numpy(), []
        i = 0 if last is None else int(np.searchsorted(t, last + gap_us))
        while i < len(t):
            last, mac = int(t[i]), pdf["src_mac"].iloc[i]
            new = mac is not None and mac not in macs and len(macs) < limit
            if new:
                macs.append(mac)
            rows.append((group[0], last, mac, new))
            i = int(np.searchsorted(t, last + gap_us))
        if last is not None:
            state.update((last, macs))
        yield pd.DataFrame(rows, columns=[key, "action_us", "src_mac", "newly_listed"])

    return step
