"""Packing of token pieces into sequences of fixed length.

The pieces of all documents are counted by length. Neighbouring lengths are put into groups,
each as long as its pieces are in the mean, so that a way of filling a sequence is used many
times. Over the groups the configuration linear program
(how often to use each way, so that all pieces are covered by as few sequences as possible) is
solved by multiplicative weights: a group's weight falls as it gets covered, and the
configuration worth most at the present prices is found by a knapsack dynamic program. The
best prices bound the program's value from below; rounds go on until the solution is within
GAP of that bound. The solution is moved to a vertex, which uses no more configurations than
there are groups, and rounded down; of each group in a configuration such pieces are taken
as fill the sequence together. The same is done with what is left, until little is. The
shortest pieces, held back to fill room, and the last few are placed by best fit on counts. Pieces then find their place by their rank among the pieces of the same
length. The program's size depends on the sequence length only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.ranks import bins_for, in_bins, ranked
from airlens.llm.word_ids import shared_coder
from airlens.operators.stage import stage

CAPACITY = 2048
END = 0  # id that ends a document
GAP = 0.01  # of the fractional solution over the bound that prices give
GROUPS = 24  # of lengths in one program
USES = 6  # sequences for each group at least
LEAST = 8  # sequences from which the rest is worth a program
HELD = 0.05  # share of the pieces, the shortest, that may be held back to fill room
STEP = 0.25  # how fast a covered group loses weight, halved as often as need be
CHECKED = 40  # rounds from one knapsack to the next


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids as bytes) of a document: whole, or in pieces of the capacity."""
    for piece, at in enumerate(range(0, len(ids), capacity)):
        yield piece, at, ids[at:at + capacity].astype("<u4").tobytes()


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all whole texts; a null text has the end id only."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(tokenizer, spaces_dropped=True)
        for frame in frames:
            rows = []
            for doc_id, ids in zip(frame["doc_id"], coder.encode_all(frame["text"]), strict=True):
                for piece, at, raw in cut(np.append(ids, np.uint32(END)), capacity):
                    rows.append((doc_id, piece, at, len(raw) // 4, zlib.crc32(raw), raw)[:6 if with_ids else 5])
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id string, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    # Ids go through pandas as text: a column of longs with a null would turn to floats there.
    found = documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int = CAPACITY) -> Counter[int]:
    """How many pieces of each length fill a sequence at the highest total price: unbounded knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    for length, price in zip(lengths.tolist(), prices.tolist(), strict=True):
        for at in range(length, capacity + 1, length):  # one more piece in every room of a stretch as long as the piece
            end = min(at + length, capacity + 1)
            np.maximum(value[at:end], value[at - length:end - length] + price, out=value[at:end])
    out: Counter[int] = Counter()
    room = int(value.argmax())
    while room > 0:
        fits = lengths <= room
        with_one = np.where(fits, value[np.where(fits, room - lengths, 0)] + prices, -1.0)
        best = int(with_one.argmax())
        if value[room] <= 0 or with_one[best] < value[room]:
            room -= 1
            continue
        out[best] += 1
        room -= int(lengths[best])
    return out


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """Ranges of ascending lengths, ``groups`` at most, in which pieces are the fewest tokens below their range's longest."""
    n = len(lengths)
    many, mass = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))
    cost, came = np.concatenate([[0.0], np.full(n, np.inf)]), []
    for _ in range(min(groups, n)):
        step = np.zeros(n + 1, dtype=np.int64)
        after = cost.copy()
        for j in range(1, n + 1):
            with_last = cost[:j] + lengths[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            step[j] = with_last.argmin()
            after[j] = with_last[step[j]]
        came.append(step)
        cost = after
    ends = [n]
    for step in reversed(came):
        ends.append(int(step[ends[-1]]))
    ends = sorted(set(ends))
    return list(zip(ends, ends[1:], strict=False))


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations (a column each), how often each is used, and a lower bound of the program's value.

    The uses cover the demand and sum to at most 1 + ``gap`` times the bound. A knapsack at
    the present prices gives the bound and a column; between two knapsacks the columns at
    hand serve. A solution is the columns used since the step was last halved, scaled to
    cover every length.
    """
    m = len(lengths)
    demand = demand.astype(np.float64)
    columns = np.diag(capacity // lengths).astype(np.float64)
    weight = lengths * demand / np.dot(lengths, demand)
    step, lower = STEP, 0.0
    while True:
        uses, covered, rounds = np.zeros(columns.shape[1]), np.zeros(m), 0
        while covered.min() < 4 / step:
            prices = weight / demand
            if rounds % CHECKED == 0:
                found = best_configuration(lengths, prices, capacity)
                column = np.array([found[k] for k in range(m)], dtype=np.float64)
                lower = max(lower, float(prices @ demand) / float(prices @ column))
                if covered.min() > 0 and uses.sum() <= (1 + gap) * lower * covered.min():
                    return columns, uses / covered.min(), lower
                if not (columns == column[:, None]).all(axis=0).any():
                    columns, uses = np.column_stack([columns, column]), np.append(uses, 0.0)
            best = int((prices @ columns).argmax())
            share = columns[:, best] / demand
            times = 1 / share.max()
            uses[best] += times
            covered += share * times
            weight *= np.exp(-step * share * times)
            weight /= weight.sum()
            rounds += 1
        step /= 2


def vertex(columns: np.ndarray, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A solution that covers as much with no larger sum and no more columns than lengths: steps along null directions."""
    columns, uses = columns[:, uses > 0], uses[uses > 0]
    m = len(columns)
    while columns.shape[1] > m:
        way = np.linalg.svd(columns[:, :m + 1])[2][-1]
        way = -way if way.sum() > 0 or not (way < 0).any() else way
        down = np.flatnonzero(way < 0)
        steps = uses[down] / -way[down]
        uses[:m + 1] = np.maximum(uses[:m + 1] + steps.min() * way, 0)
        out = down[steps.argmin()]
        columns, uses = np.delete(columns, out, axis=1), np.delete(uses, out)
    return columns, uses


def _filled(groups: list[int], lengths: np.ndarray, rest: np.ndarray, ranges: list[tuple[int, int]], means: np.ndarray, times: int, capacity: int) -> list[tuple[tuple, int]]:
    """Sequences with a piece for each of ``groups``; ``rest`` is lowered. Ends early where a group has none left.

    The first piece is its group's longest, the others are those nearest to what leaves the
    groups after them their mean. The last may come from another group: it is the longest that fits.
    """
    out = []
    while times:
        taken: Counter[int] = Counter()
        room = capacity
        for at, group in enumerate(groups):
            low, high = ranges[group]
            if at and at == len(groups) - 1:
                low, high = 0, len(rest)
            left = rest[low:high] - np.array([taken[k] for k in range(low, high)])
            some = low + np.flatnonzero(left > 0)
            if not len(some):
                return out
            wanted = room - int(means[groups[at + 1:]].sum())
            k = int(some[max(np.searchsorted(lengths[some], wanted, side="right") - 1, 0)]) if at else int(some[-1])
            if lengths[k] <= room:
                taken[k] += 1
                room -= int(lengths[k])
        each = min(times, min(int(rest[k]) // n for k, n in taken.items()))
        for k, n in taken.items():
            rest[k] -= n * each
        out.append((tuple((int(lengths[k]), n) for k, n in taken.items()), each))
        times -= each
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, opened: list[tuple[tuple, int]] | None = None) -> list[tuple[tuple, int]]:
    """Best fit by falling length, on counts, into ``opened`` sequences and new ones: sequences with the same content are one entry."""
    by_room: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)
    for content, n in opened or []:
        room = capacity - sum(length * c for length, c in content)
        by_room.setdefault(room, []).append([content, n])
        rooms[room] = room > 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, left = int(lengths[k]), int(counts[k])
        while left:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                each = min(capacity // size, left)
                content, n, room = (), left // each, capacity
            else:
                room = size + int(fits[0])
                content, held = by_room[room].pop()
                each = min(room // size, left)
                n = min(held, left // each)
                if held > n:
                    by_room[room].append([content, held - n])
                rooms[room] = bool(by_room[room])
            rest = room - each * size
            by_room.setdefault(rest, []).append([(*content, (size, each)), n])
            rooms[rest] = rest > 0
            left -= n * each
    return [(content, n) for entries in by_room.values() for content, n in entries]


def programmed(lengths: np.ndarray, rest: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Sequences ((length, pieces), ...) with their number, as rounded programs give them; ``rest`` is lowered by their pieces."""
    out: list[tuple[tuple, int]] = []
    reach = np.cumsum(rest)
    short = reach <= HELD * reach[-1]  # these wait for the room that is left
    while (sequences := int(np.dot(lengths, rest)) // capacity) >= LEAST:
        some = np.flatnonzero((rest > 0) & ~short)
        here, long = rest[some], lengths[some]
        ranges = grouped(long, here, max(2, min(GROUPS, sequences // USES)))
        demand = np.array([here[a:b].sum() for a, b in ranges])
        means = np.array([-(-int(np.dot(long[a:b], here[a:b])) // int(n)) for (a, b), n in zip(ranges, demand, strict=True)])
        columns, uses = vertex(*fractional(means, demand, capacity)[:2])
        found = []
        for k in np.argsort(-uses, kind="stable").tolist():
            groups = [g for g in np.flatnonzero(columns[:, k])[::-1].tolist() for _ in range(int(columns[g, k]))]
            found += _filled(groups, long, here, ranges, means, int(uses[k] + 1e-6), capacity)
        rest[some] = here
        out += found
        if not found:
            break
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole configurations ((length, pieces), ...) with their number of sequences; together they hold exactly the histogram."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    rest = np.array([histogram[k] for k in sorted(histogram)], dtype=np.int64)
    if not len(lengths):
        return []
    opened = programmed(lengths, rest, capacity)
    return best_fit(lengths, rest, capacity, opened)


def plan(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> pd.DataFrame:
    """One row for each length in a configuration: the ranks it takes, its first sequence, pieces a sequence and offset."""
    rows, taken, sequence = [], Counter(), 0
    for content, times in found:
        offset = 0
        for length, n in content:
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"])


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces(doc_id, piece, length, ...)`` with sequence_id and offset; each sequence is gapless from 0.

    Pieces of one length change places freely, so any number of them, a third of all rows
    too, is ranked in bins. Repeated rows are pieces of their own. No pieces give no rows.
    """
    cut_pieces = stage(cut_pieces)
    histogram = dict(cut_pieces.groupBy("length").count().collect())  # at most ``capacity`` rows
    table = plan(configurations(histogram, capacity))
    bins = np.array([bins_for(histogram.get(k, 0)) for k in range(capacity + 1)])
    rows = in_bins(cut_pieces, F.element_at(F.array(*[F.lit(int(b)) for b in bins]), F.col("length") + 1), "doc_id", "piece")
    places = ranked(stage(rows), ["length"], ["doc_id", "piece", "ids_crc32"]).drop("bin", "before")
    key = (table["length"].to_numpy(dtype=np.int64) << 44) + table["rank"].to_numpy(dtype=np.int64)
    order = np.argsort(key)
    # Rows: at most the lengths in all configurations, which depends on the capacity alone.
    shared = places.sparkSession.sparkContext.broadcast((key[order], *(table[c].to_numpy(dtype=np.int64)[order] for c in ("rank", "sequence", "each", "offset"))))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, first, sequence, each, offset = shared.value
        for frame in frames:
            length, rank = frame["length"].to_numpy(dtype=np.int64), frame["rank"].to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            i = rank - first[at]
            yield frame.drop(columns="rank").assign(sequence_id=sequence[at] + i // each[at], offset=offset[at] + i % each[at] * length)

    places = places.withColumn("doc_id", F.col("doc_id").cast("string"))
    kept = [c for c in places.columns if c != "rank"]
    schema = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in kept)
    put_ = places.select(*kept, "rank").mapInPandas(put, f"{schema}, sequence_id long, offset long")
    return put_.withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids: the ids of a sequence as one array, at most the capacity long."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int64) for parts in frame["parts"]]
            yield pd.DataFrame({"sequence_id": frame["sequence_id"], "ids": ids})

    return grouped.mapInPandas(joined, "sequence_id long, ids array<long>")


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of the pieces of all documents.

    Rows without a doc_id are packed like any other; columns beyond doc_id and text are ignored.
    """
    packed = pack(pieces(documents, tokenizer, capacity), capacity)
    return packed.withColumn("length", F.col("length").cast("long"))
