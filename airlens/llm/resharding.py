"""Resharding by minimum-cost flow: shards of near-equal bytes, moving as few bytes as can be.

Old shards are sources with their bytes, new shards sinks with their capacities, and a byte
that changes its shard costs one. The cheapest flow over all bytes says how many go from each
old shard to each new one; each such transfer is a block, a range of the old shard's rows in
the order of their hash. A row that a border crosses goes to the nearer side. Only a row
larger than a shard's capacity is placed beforehand, as no block can hold it. What the borders
leave uneven is evened out by moving, or exchanging, single rows between the fullest and
emptier shards, by preference rows that change their shard anyway. Then the shards that gain
or lose rows are rewritten, the others stay as they are.
"""

from __future__ import annotations

import bisect
import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.ranks import bins_for, in_bins, ranked
from airlens.operators.stage import stage
from airlens.session import shared_dir

OVERHEAD = 8  # bytes of a row besides its text
SHARDS = 24
CLASSES, SLOTS = 4, 16  # size classes in a power of two, and rows of each that may even shards out
EVEN = 0.002  # of a shard's bytes, by which shards may differ
FIRST_BITS, SECOND_BITS, HASH_BITS = 12, 12, 62
FILE_BYTES = 128 << 20


def size(text: Column | str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def text_crc32(text: Column | str = "text") -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def by_hash(shards: int) -> Column:
    """Shard of an id in a layout by hash; ids that are null lie in shard 0."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % shards, F.lit(0)).cast("int")


def cheapest_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each source to each sink at the least total cost: successive shortest paths with potentials.

    Supplies and demands must have one sum. Every round empties a source, fills a sink or
    empties an arc, so the number of rounds depends on the number of shards, not on bytes.
    """
    m, n = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow = [[0] * n for _ in range(m)]
    potential = [0] * (m + n)
    while any(left):
        dist = [None] * (m + n)
        came = [-1] * (m + n)
        heap = [(0, i) for i in range(m) if left[i]]
        for _, i in heap:
            dist[i] = 0
        settled = [False] * (m + n)
        while heap:
            d, u = heapq.heappop(heap)
            if settled[u]:
                continue
            settled[u] = True
            arcs = [(m + j, cost[u][j]) for j in range(n)] if u < m else [(i, -cost[i][u - m]) for i in range(m) if flow[i][u - m]]
            for v, c in arcs:
                reach = d + c + potential[u] - potential[v]
                if dist[v] is None or reach < dist[v]:
                    dist[v], came[v] = reach, u
                    heapq.heappush(heap, (reach, v))
        end = min((m + j for j in range(n) if room[j]), key=lambda v: dist[v] + potential[v])
        path, v = [end], end
        while came[v] >= 0:
            v = came[v]
            path.append(v)
        path.reverse()
        most = min(left[path[0]], room[end - m])
        for u, v in zip(path, path[1:], strict=False):
            if u >= m:
                most = min(most, flow[v][u - m])
        for u, v in zip(path, path[1:], strict=False):
            if u < m:
                flow[u][v - m] += most
            else:
                flow[v][u - m] -= most
        left[path[0]] -= most
        room[end - m] -= most
        far = max(d for d in dist if d is not None)
        potential = [p + (d if d is not None else far) for p, d in zip(potential, dist, strict=True)]
    return flow


def place_large(rows: list[tuple[int, int, int]], shards: int, capacity: float) -> tuple[dict[tuple[int, int], int], list[int]]:
    """New shard of each large (old, hash, bytes), and the bytes so placed in each shard.

    By falling size: a row stays where it is while that shard has room for it, and otherwise
    goes to the emptiest shard.
    """
    placed, where = [0] * shards, {}
    for old, h, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        stays = old < shards and (placed[old] + n <= capacity or placed[old] == min(placed))
        new = old if stays else min(range(shards), key=lambda j: (placed[j], j))
        where[old, h] = new
        placed[new] += n
    return where, placed


def fill_up(placed: list[int], pool: int) -> list[int]:
    """Bytes of the pool each shard takes so that all end as level as they can, summing to the pool."""
    low, high = 0, max(placed, default=0) + pool
    while low < high:
        level = (low + high) // 2
        if sum(max(0, level - p) for p in placed) >= pool:
            high = level
        else:
            low = level + 1
    take = [max(0, low - p) for p in placed]
    over = sum(take) - pool
    for j, t in enumerate(take):
        if over and t:
            take[j] -= 1
            over -= 1
    return take


@dataclass
class Layout:
    """Where every row goes: single rows by their hash, the others by ranges of hashes of their old shard."""

    shards: int
    single: dict[tuple[int, int], int]
    cuts: dict[int, list[tuple[int, int]]]  # old shard -> (hash below which, new shard) in ascending order
    transfers: list[tuple[int, int, int]]  # old, new, bytes of the cheapest flow
    affected: list[int]
    rows: int
    total: int

    def of(self, rows: DataFrame) -> DataFrame:
        """``rows(old, h, size, ...)`` with their new ``shard``; native expressions and one join of bounded size."""
        spark = rows.sparkSession
        table = spark.createDataFrame([(o, h, s) for (o, h), s in self.single.items()], "old int, h long, moved int")
        ranges = F.lit(0)
        for old, steps in self.cuts.items():
            inner = F.lit(steps[-1][1])
            for below, new in reversed(steps[:-1]):
                inner = F.when(F.col("h") < below, F.lit(new)).otherwise(inner)
            ranges = F.when(F.col("old") == old, inner).otherwise(ranges)
        joined = rows.join(F.broadcast(table), ["old", "h"], "left")  # rows above a capacity, and those that even shards out
        return joined.withColumn("shard", F.coalesce("moved", ranges).cast("int")).drop("moved")


def described(documents: DataFrame, old: Column) -> DataFrame:
    """Rows with their old shard, size and a hash of id and text that orders them inside it."""
    marked = documents.withColumn("old", old).withColumn("size", size()).withColumn("crc", text_crc32())
    return marked.withColumn("h", F.xxhash64("doc_id", "crc", "size").bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def solve(rows: DataFrame, shards: int = SHARDS) -> Layout:
    """The layout for ``rows(old, h, size)``, a narrow table that is read several times and should be staged.

    The driver gets sums only: bytes by old shard and leading hash bits, the same once more
    with finer bits where a transfer begins or ends, rows above a capacity, of which there
    are fewer than shards, and SLOTS rows of each size class of each new shard.
    """
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = total / shards
    big = rows.where(F.col("size") > capacity).groupBy("old", "h").agg(F.sum("size").alias("n")).collect()
    large, placed = place_large([tuple(r) for r in big], shards, capacity)
    small = rows.where(F.col("size") <= capacity)
    prefix = F.shiftright("h", HASH_BITS - FIRST_BITS)
    first: dict[int, dict[int, int]] = {}
    for old, p, n in small.groupBy("old", prefix.alias("p")).agg(F.sum("size")).collect():
        first.setdefault(old, {})[p] = n
    olds = sorted(first)
    supply = [sum(first[o].values()) for o in olds]
    demand = fill_up(placed, sum(supply))
    flow = cheapest_flow(supply, demand, [[0 if o == j else 1 for j in range(shards)] for o in olds]) if olds else []
    transfers = [(o, j, flow[k][j]) for k, o in enumerate(olds) for j in range(shards) if flow[k][j]]
    fine = _fine(small, first, transfers)
    cuts = {o: _cuts(first[o], fine.get(o, {}), [(j, n) for i, j, n in transfers if i == o]) for o in olds}
    layout = Layout(shards, large, cuts, transfers, [], count, total)
    if olds:
        sizes, candidates = _candidates(layout.of(rows), large, shards)
        layout.single = large | even_out(sizes, candidates)
    moved = layout.of(rows).where("old <> shard").select("old", "shard").distinct().collect()  # pairs of shards
    layout.affected = sorted({s for r in moved for s in r if s < shards})
    return layout


def _candidates(placed: DataFrame, large: dict, shards: int) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Bytes of each new shard, and (shard, size, old, hash) of rows that may be moved singly."""
    kind = F.floor(F.log2("size") * CLASSES).alias("kind")
    slot = F.pmod(F.xxhash64("h"), F.lit(SLOTS)).alias("slot")
    groups = placed.groupBy("shard", kind, slot).agg(F.sum("size").alias("bytes"), F.min(F.struct("old", "h")).alias("one"))
    groups = stage(groups.select("shard", "bytes", "one.old", "one.h"))
    sizes = [0] * shards
    for shard, n in groups.groupBy("shard").agg(F.sum("bytes")).collect():
        sizes[shard] = n
    chosen = groups.select("old", "h").distinct()
    alike = placed.join(chosen, ["old", "h"], "left_semi").groupBy("shard", "old", "h").agg(F.sum("size").alias("n")).collect()
    return sizes, sorted((shard, n, old, h) for shard, old, h, n in alike if (old, h) not in large)


def even_out(sizes: list[int], candidates: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], int]:
    """New shards of single rows (shard, size, old, hash) that bring the shards' sizes closer together.

    A step takes the fullest shard that can give and moves a row of it, or exchanges it for a
    smaller one, so that the two shards' difference falls most; rows that have left their old
    shard anyway come first. Shards that differ by no more than EVEN of their size are even;
    every step lowers the sum of squares by a hundredth of the difference's at least, so steps end.
    """
    sizes = list(sizes)
    held: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for shard, n, old, h in candidates:
        held[shard].append((n, old, h))
    where: dict[tuple[int, int], int] = {}
    least = max(1, int(EVEN * sum(sizes) / max(len(sizes), 1)))

    def gain(n: int, gap: int) -> int:
        return 2 * n * (gap - n)  # what moving n bytes takes from the sum of squares

    def worth(row: tuple[int, int, int], shard: int) -> int:
        return 4 if row[1] == shard else 10  # a row that still is where it was would be moved anew

    for _ in range(64 * len(sizes)):
        by_size = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        step = None
        for full in reversed(by_size[1:]):
            for empty in by_size[:4]:
                gap = sizes[full] - sizes[empty]
                if gap <= least or empty == full:
                    continue
                options = [(gain(r[0], gap) * worth(r, full), r, None) for r in held[full] if r[0] < gap]
                back = sorted(held[empty])
                for r in held[full]:  # for each row, the one whose exchange for it fits best
                    at = bisect.bisect_left(back, (r[0] - gap // 2,))
                    options += [(gain(r[0] - b[0], gap) * worth(r, full) * worth(b, empty) // 12, r, b) for b in back[max(0, at - 1):at + 2] if 0 < r[0] - b[0] < gap]
                best = max(options, key=lambda o: o[0], default=None)
                if best and best[0] >= gap * gap // 10 and (step is None or best[0] > step[0]):
                    step = (best[0], full, empty, best[1], best[2])
            if step:
                break
        if step is None:
            break
        _, full, empty, row, back = step
        for one, a, b in ((row, full, empty), (back, empty, full)):
            if one:
                held[a].remove(one)
                held[b].append(one)
                sizes[a] -= one[0]
                sizes[b] += one[0]
                where[one[1], one[2]] = b
    return where


def _borders(transfers: list[tuple[int, int]]) -> list[int]:
    """Bytes of an old shard before each of its transfers but the first."""
    out, before = [], 0
    for _, n in transfers[:-1]:
        before += n
        out.append(before)
    return out


def _fine(small: DataFrame, first: dict[int, dict[int, int]], transfers: list[tuple[int, int, int]]) -> dict[int, dict[int, dict[int, int]]]:
    """Bytes by finer bits of those leading bits in which a transfer begins."""
    wanted = []
    for o in first:
        borders = _borders([(j, n) for i, j, n in transfers if i == o])
        before = 0
        for p in sorted(first[o]):
            if any(before < b < before + first[o][p] for b in borders):
                wanted.append((o, p))
            before += first[o][p]
    out: dict[int, dict[int, dict[int, int]]] = {}
    if not wanted:
        return out
    table = small.sparkSession.createDataFrame(wanted, "old int, p long")  # at most one for each transfer
    rows = small.withColumn("p", F.shiftright("h", HASH_BITS - FIRST_BITS)).join(F.broadcast(table), ["old", "p"], "left_semi")
    finer = F.shiftright("h", HASH_BITS - FIRST_BITS - SECOND_BITS)
    for o, p, q, n in rows.groupBy("old", "p", finer.alias("q")).agg(F.sum("size")).collect():
        out.setdefault(o, {}).setdefault(p, {})[q] = n
    return out


def _cuts(first: dict[int, int], fine: dict[int, dict[int, int]], transfers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hashes below which rows go to each new shard; a border goes to the nearest step of the finest bits known."""
    steps = []
    for p in sorted(first):
        if p in fine:
            steps += [((q + 1) << (HASH_BITS - FIRST_BITS - SECOND_BITS), n) for q, n in sorted(fine[p].items())]
        else:
            steps.append(((p + 1) << (HASH_BITS - FIRST_BITS), first[p]))
    out, at, before = [], 0, 0
    below = 0
    for (j, _), border in zip(transfers[:-1], _borders(transfers), strict=True):
        while at < len(steps) and before + steps[at][1] / 2 <= border:
            before += steps[at][1]
            below = steps[at][0]
            at += 1
        out.append((below, j))
    return [*out, (1 << HASH_BITS, transfers[-1][0])]


def moved_bytes(rows: DataFrame, layout: Layout) -> int:
    """Bytes of ``rows(old, h, size)`` that change their shard; the flow's own value is ``planned_bytes``."""
    return layout.of(rows).agg(F.coalesce(F.sum(F.when(F.col("old") != F.col("shard"), F.col("size"))), F.lit(0))).first()[0]


def planned_bytes(layout: Layout) -> int:
    return sum(n for o, j, n in layout.transfers if o != j)


def rewrite(rows: DataFrame, layout: Layout, path: str) -> None:
    """Write the affected shards of ``rows(shard, h, text, ...)`` to ``path``, one folder a shard, in files of bounded size."""
    files = max(1, layout.total // (layout.shards * FILE_BYTES)) * 4
    chosen = rows.where(F.col("shard").isin(layout.affected)) if len(layout.affected) < layout.shards else rows
    chosen.withColumn("__file", F.pmod("h", F.lit(files))).repartition("shard", "__file").drop("__file", "h", "old", "size", "crc").write.partitionBy("shard").parquet(path)


def reshard(documents: DataFrame, old: Column, shards: int = SHARDS, path: str | None = None) -> tuple[DataFrame, Layout]:
    """(doc_id, text, shard, slot, ...) read back from the rewritten files and the unaffected old ones, and the layout.

    A null text has size 8 and stays null. Rows that repeat both id and text share a hash and
    move together. No rows give no rows. Columns besides doc_id and text are not written.
    """
    rows = described(documents.select("doc_id", "text"), old)
    narrow = stage(rows.select("old", "h", "size"))
    layout = solve(narrow, shards)
    path = path or f"{shared_dir(documents.sparkSession)}/shards/{uuid.uuid4().hex}"
    placed = layout.of(rows)
    rewrite(placed, layout, path)
    parts = []
    if layout.affected:
        parts.append(documents.sparkSession.read.schema("doc_id long, text string, shard int").parquet(path))
    if len(layout.affected) < shards:
        parts.append(placed.where(~F.col("shard").isin(layout.affected)).select("doc_id", "text", "shard"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, layout


def slots(rows: DataFrame, count: int) -> DataFrame:
    """``rows(doc_id, size, text_crc32, shard)`` with ``slot``, gapless from 0 in each shard."""
    binned = in_bins(rows, bins_for(count // SHARDS), "doc_id", "text_crc32")
    return ranked(stage(binned), ["shard"], ["doc_id", "text_crc32", "size"]).drop("bin", "before").withColumnRenamed("rank", "slot")
