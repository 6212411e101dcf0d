"""Repair of conversations: the cheapest edits after which the roles take turns.

Rows of a conversation, in the order of their turns, may be kept, given another role or deleted, and rows may be
put in, so that the initials of the roles are nothing or ``s?(ua)+``. What the roles so far
end in (nothing, s, u or a) is the state; (row, state) are the nodes of a graph whose arcs are
edits, and the cost to go of each node is found from the last row backwards. Of the arcs only
those on cheapest paths stay. They are ranked by the first 1, 2, 4, 8 ... letters of the least
audit that begins with them: the rank for twice the length comes from the pair of an arc's
rank and the rank of the arc its doubled pointer leads to. The arcs of a node have different
letters, so the ranks decide between them, and the doubled pointers unfold the least path.

One conversation may hold a third of all rows. Rows are sorted by ranges and cut into blocks;
a block lying wholly inside a range is a conversation and solved alone. Of the others a
block's edits are first summed up as a table of least costs from state to state; passes
over these small tables, in order and one block at a time, give the cost to go at every
block's end and the state at its start, and then each block is solved alone as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.operators.stage import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is added for a truncated row that stays
SPACE = " \t\n\x0b\x0c\r"
STEPS = 1 << 12  # rows of a block
CHARS = 1 << 18  # characters of its texts from which a block is closed

NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states
_NEXT = np.array([USER, USER, ASSISTANT, USER])  # the role that a new row takes
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_FORCED, _CUT = 4, 8  # marks beside a row's initial: must go, is truncated
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)
_FAR = 1 << 40
_LEGAL = ("su", "ua", "au")
END = (0, 2 * INSERT, INSERT, 0)  # cost to go after the last row


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) as the exercise damages them, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (times 0), 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it
    (times 2), 4 makes the role ``user``. Nulls in role, text and the hashed key are one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and each one's faults; ``first`` where role and text were not seen in an earlier turn."""
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    there = times > 0
    rows = rows.select(
        "conv_id", F.when(there, F.col("turn")).cast("long").alias("turn"), *[F.when(there, F.coalesce(c, F.lit(" "))).otherwise("").alias(c) for c in ("role", "text")], times.alias("times")
    )
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    same = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("role"), F.col("text")]
    shown = F.rtrim("text", F.lit(SPACE))
    runs = stage(runs.select(
        "*", (F.length(shown) == 0).alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.xxhash64(*same).alias("h"), F.xxhash64(F.lit(1), *same).alias("g"),
    ))
    firsts = runs.where("times > 0").groupBy("h", "g").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    firsts = firsts.select(F.col("h").alias("fh"), F.col("g").alias("fg"), F.col("least.turn").alias("of"), F.lit(True).alias("first"))
    match = (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & F.col("turn").eqNullSafe(F.col("of"))
    return runs.join(firsts, match, "left").select("conv_id", "turn", "role", "text", "times", "blank", "truncated", F.coalesce("first", F.lit(False)).alias("first"))


class _Block:
    """Rows of one conversation in a task, as far as a block goes."""

    def __init__(self, conv: str | None, steps: int):
        self.steps = steps
        self.conv, self.codes, self.roles, self.texts, self.size = conv, bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = self.low = self.high = None
        self.turns = 0

    def full(self) -> bool:
        return len(self.codes) >= self.steps or self.size >= CHARS

    def add(self, turn: int | None, role: str, text: str, n: int, blank: bool, truncated: bool, first: bool) -> None:
        """``n`` equal rows one after the other, of which the first may stay."""
        initial = role[:1]
        if self.tail is not None and self.tail + initial not in _LEGAL:
            self.illegal += 1
        self.illegal += n - 1  # no initial may follow itself
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
        stays = first and not blank
        if stays:
            self.truncated += truncated
            self.codes.append(_INITIALS.get(initial, 0) | _CUT * truncated)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text)
        self.codes.extend(bytes([_FORCED]) * (n - stays))

    def row(self, part: int, no: int, edge: bool) -> tuple:
        codes = np.frombuffer(bytes(self.codes), dtype=np.uint8)
        return (
            self.conv, part, no, edge, codes.tobytes(), self.roles, self.texts, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail,
            None if self.low is None else str(self.low), None if self.high is None else str(self.high), self.turns, costs(codes).ravel().tolist() if edge else [],
        )


_NAMED = ["conv", "part", "no", "edge", "codes", "roles", "texts", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns", "costs"]
_BLOCK = (
    "conv string, part int, no long, edge boolean, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, "
    "illegal long, head string, tail string, low string, high string, turns long, costs array<long>"
)


def _blocks(rows: DataFrame, steps: int) -> DataFrame:
    """A row a block, in order of (part, no); ``edge`` where a conversation may have others."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, block, opened = TaskContext.get().partitionId(), 0, None, True  # the first may go on from the part before
        out: list[tuple] = []
        for frame in frames:
            for conv, turn, role, text, n, blank, truncated, first in frame.itertuples(index=False, name=None):
                if block is None or conv != block.conv:
                    if block is not None:
                        out.append(block.row(part, no, opened))
                        no, opened = no + 1, False
                    block = _Block(conv, steps)
                turn = None if turn is None else int(turn)
                while n:
                    if block.full():
                        out.append(block.row(part, no, True))
                        block, no, opened = _Block(conv, steps), no + 1, True
                    some = min(n, steps)
                    block.add(turn, role, text, some, blank, truncated, first)
                    n, first = n - some, False
            if out:
                yield pd.DataFrame(out, columns=_NAMED)
                out = []
        if block is not None:
            yield pd.DataFrame([block.row(part, no, True)], columns=_NAMED)

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "times", "blank", "truncated", "first").mapInPandas(run, _BLOCK)


def _step(code: int) -> np.ndarray:
    """Least costs from state to state over one row, rows put in before it included."""
    one = np.full((4, 4), _FAR)
    np.fill_diagonal(one, DELETE)
    if not code & _FORCED:
        extra = TRUNCATED if code & _CUT else 0
        for state in range(4):
            one[state, _NEXT[state]] = min(one[state, _NEXT[state]], REROLE + extra)
            if code & 3 and _fits(state, code & 3):
                one[state, code & 3] = min(one[state, code & 3], KEEP + extra)
    free = np.full((4, 4), _FAR)
    np.fill_diagonal(free, 0)
    for state in range(4):
        after = _NEXT[state]
        free[state, after] = min(free[state, after], INSERT)
        free[state, _NEXT[after]] = min(free[state, _NEXT[after]], 2 * INSERT)
    return _then(free, one)


def _fits(state: int, initial: int) -> bool:
    return state == NOTHING if initial == SYSTEM else _NEXT[state] == initial


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs over ``a`` and then ``b``, tables or arrays of them."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


_STEPS = np.array([_step(code) for code in range(16)])


def costs(codes: np.ndarray) -> np.ndarray:
    """Least costs from state to state over all rows of a block."""
    tables = _STEPS[codes]
    if not len(tables):
        return np.where(np.eye(4, dtype=bool), 0, _FAR)
    while len(tables) > 1:
        odd = tables[len(tables) // 2 * 2:]
        tables = np.concatenate([_then(tables[:-1:2], tables[1::2]), odd]) if len(odd) else _then(tables[::2], tables[1::2])
    return tables[0]


def _to_go(codes: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Cost to go at every (row, state) and after the last row, where it is ``out``."""
    found = np.empty((len(codes) + 1, 4), dtype=np.int64)
    found[-1] = out
    tables, v = _STEPS[codes], out
    for k in range(len(codes) - 1, -1, -1):
        v = (tables[k] + v).min(axis=1)
        found[k] = v
    return found


class Arcs:
    """The arcs on cheapest paths of many blocks, ranked; element 0 is the end of a path."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, bool]]):
        """``blocks``: codes, cost to go after the last row, and whether the conversation ends there."""
        self.base = np.cumsum([0, *[4 * (len(codes) + 1) for codes, _, _ in blocks]])
        go = np.concatenate([_to_go(codes, out) for codes, out, _ in blocks])
        code = np.concatenate([np.append(codes, 16) for codes, _, _ in blocks])  # 16: no row
        over = np.concatenate([np.append(np.zeros(len(codes), bool), not last) for codes, _, last in blocks])  # others go on from here
        layer, state = np.repeat(np.arange(len(code)), 4), np.tile(np.arange(4), len(code))
        code, over, have = np.repeat(code, 4), np.repeat(over, 4), go.ravel()
        row, stays, extra = code < 16, (code < 16) & (code & _FORCED == 0), np.where(code & _CUT > 0, TRUNCATED, 0)
        initial, after = code & 3, _NEXT[state]
        below = np.minimum(layer + 1, len(go) - 1)
        fits = stays & (initial > 0) & np.where(initial == SYSTEM, state == NOTHING, after == initial)
        kinds = (  # letter, whether there is such an arc, its cost, the layer and state it leads to
            (1, row, DELETE, below, state), (2, ~over, INSERT, layer, after), (3, fits, KEEP + extra, below, initial), (4, stays, REROLE + extra, below, after),
        )
        source, letter, target, cost = [], [], [], []
        for name, there, price, to_layer, to_state in kinds:
            at = np.flatnonzero(there & (price + go[to_layer, to_state] == have))
            source.append(at)
            letter.append(np.full(len(at), name))
            target.append((4 * to_layer + to_state)[at])
            cost.append(np.broadcast_to(price, have.shape)[at])
        self.letter, self.target, self.cost = (np.concatenate([[0], *x]).astype(np.int64) for x in (letter, target, cost))
        self._source = np.concatenate([[-1], *source]).astype(np.int64)
        self._nodes = len(have)
        self.pointers, self.rank = self._ranked()

    def _least(self, rank: np.ndarray) -> np.ndarray:
        """Each node's arc of the least rank, 0 where a path ends."""
        order = np.lexsort((rank, self._source))[1:]
        first = np.zeros(self._nodes, dtype=np.int64)
        source = self._source[order]
        lead = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else []
        first[source[lead]] = order[lead]
        return first

    def _ranked(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Pointers to the arc 1, 2, 4, ... letters on, and the rank of each arc by all the letters to its end."""
        rank = self.letter
        on = self._least(rank)[self.target]
        on[0] = 0
        pointers = [on]
        while on.any():
            rank = np.unique(rank * (len(rank) + 5) + rank[on], return_inverse=True)[1]
            on = on[on]
            pointers.append(on)
        return pointers, rank

    def paths(self, nodes: np.ndarray) -> np.ndarray:
        """The least path from each node, as arcs in a row; 0 after its end."""
        line = self._least(self.rank)[nodes][:, None]
        for pointer in reversed(self.pointers[:-1]):
            line = np.stack([line, pointer[line]], axis=2).reshape(len(nodes), -1)
        return line


def _classes(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of the blocks of about one size."""
    by: dict[int, list[int]] = {}
    for k, size in enumerate(sizes):
        by.setdefault(size.bit_length(), []).append(k)
    for width, members in by.items():
        some = max(1, (STEPS << 4) >> width)
        yield from (members[at:at + some] for at in range(0, len(members), some))


def _frames_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], list[np.ndarray]]]:
    for frame in frames:
        codes = [np.frombuffer(c, dtype=np.uint8) for c in frame["codes"]]
        yield frame, codes, [np.array(v, dtype=np.int64) for v in frame["v"]]


def _exits(blocks: DataFrame) -> DataFrame:
    """(conv, part, no, exits): the state after a block for each state before it, on the least path."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, codes, out in _frames_of(frames):
            found: list = [None] * len(frame)
            for members in _classes([len(c) for c in codes]):
                arcs = Arcs([(codes[k], out[k], bool(frame["last"].iat[k])) for k in members])
                path = arcs.paths((arcs.base[:-1, None] + np.arange(4)).ravel())
                end = np.maximum((path > 0).sum(axis=1) - 1, 0)
                states = np.where(path[:, 0] > 0, arcs.target[path[np.arange(len(path)), end]] % 4, np.tile(np.arange(4), len(members)))
                for k, one in zip(members, states.reshape(-1, 4).tolist(), strict=True):
                    found[k] = one
            yield frame[["conv", "part", "no"]].assign(exits=found)

    return blocks.select("conv", "part", "no", "codes", "v", "last").mapInPandas(run, "conv string, part int, no long, exits array<int>")


def _in_order(rows: DataFrame, run, schema: str, backwards: bool = False) -> DataFrame:
    """``run`` over the rows of each conversation one after the other; no conversation is held as a whole."""
    key = F.xxhash64("conv", F.col("conv").isNull())
    order = [F.col(c).desc() if backwards else F.col(c).asc() for c in ("part", "no")]
    return rows.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key", "conv", *order).drop("__key").mapInPandas(run, schema)


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before, v = (), np.array(END)
    for frame in frames:
        rows = []
        for conv, part, no, table in zip(frame["conv"], frame["part"], frame["no"], frame["costs"], strict=True):
            last = before != (conv,)
            v = np.array(END, dtype=np.int64) if last else v
            rows.append((part, no, v.tolist(), last))
            v = (np.array(table, dtype=np.int64).reshape(4, 4) + v).min(axis=1)
            before = (conv,)
        yield pd.DataFrame(rows, columns=["part", "no", "v", "last"])


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before, state = (), NOTHING
    for frame in frames:
        rows = []
        for conv, part, no, exits in zip(frame["conv"], frame["part"], frame["no"], frame["exits"], strict=True):
            state = state if before == (conv,) else NOTHING
            rows.append((part, no, state))
            state, before = exits[state], (conv,)
        yield pd.DataFrame(rows, columns=["part", "no", "state"])


_CARRIED = ["conv", "part", "no", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns"]
_SOLVED = (
    "conv string, part int, no long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low string, high string, turns long, "
    "cost long, audit string, roles array<string>, texts array<string>"
)


def _solve(blocks: DataFrame) -> DataFrame:
    """Blocks (with ``v``, ``last`` and ``state``) with their part of the audit, its cost and the repaired rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, codes, out in _frames_of(frames):
            found: list = [None] * len(frame)
            for members in _classes([len(c) for c in codes]):
                arcs = Arcs([(codes[k], out[k], bool(frame["last"].iat[k])) for k in members])
                lines = arcs.paths(arcs.base[:-1] + frame["state"].to_numpy(dtype=np.int64)[members])
                for k, line in zip(members, lines, strict=True):
                    found[k] = _written(arcs, line[line > 0], codes[k], frame["roles"].iat[k], frame["texts"].iat[k])
            solved = pd.DataFrame(found, columns=["cost", "audit", "new_roles", "new_texts"], index=frame.index)
            yield frame[_CARRIED].assign(cost=solved["cost"], audit=solved["audit"], roles=solved["new_roles"], texts=solved["new_texts"])

    return blocks.select(*_CARRIED, "codes", "roles", "texts", "v", "last", "state").mapInPandas(run, _SOLVED)


def _written(arcs: Arcs, path: np.ndarray, codes: np.ndarray, roles, texts) -> tuple[int, str, list[str], list[str]]:
    letters, states = arcs.letter[path], arcs.target[path] % 4
    row = np.cumsum(letters != 2) - 1
    held = np.cumsum(codes & _FORCED == 0) - 1  # of a row among those whose text is at hand
    new_roles, new_texts = [], []
    for at in np.flatnonzero(letters > 1).tolist():
        letter = letters[at]
        k = None if letter == 2 else int(held[row[at]])
        new_roles.append(roles[k] if letter == 3 else _NAMES[int(states[at])])
        new_texts.append("" if k is None else texts[k])
    return int(arcs.cost[path].sum()), _LETTERS[letters].tobytes().decode(), new_roles, new_texts


def _solved(rows: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """Solved blocks: those that are whole conversations, and those of conversations that may have several."""
    blocks = stage(_blocks(_runs(rows), steps))
    whole = blocks.where("NOT edge").withColumn("v", F.array(*[F.lit(x).cast("long") for x in END])).withColumn("last", F.lit(True)).withColumn("state", F.lit(NOTHING))
    edged = blocks.where("edge")
    ends = _in_order(edged.select("conv", "part", "no", "costs"), _ends, "part int, no long, v array<long>, last boolean", backwards=True)
    edged = stage(edged.join(ends, ["part", "no"]))
    starts = _in_order(_exits(edged), _starts, "part int, no long, state int")
    return _solve(whole), _solve(edged.join(starts, ["part", "no"]))


def repaired(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(conv_id, part, no, place, role, text) of the repaired conversations, in that order; as for ``report``."""
    whole, edged = _solved(rows, steps)
    lines = whole.unionByName(edged).select("conv", "part", "no", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "line"))
    kind = rows.schema["conv_id"].dataType
    return lines.select(F.col("conv").cast(kind).alias("conv_id"), "part", "no", "place", F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))


_REPORT = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _reported(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order added up; repaired text is hashed as it passes."""
    open_: list | None = None

    def close() -> tuple:
        conv, low, high, turns, _, counts, audit, digest, _ = open_
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv, gaps, *counts, "".join(audit), digest.hexdigest())

    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            if open_ is None or open_[0] != r.conv:
                if open_ is not None:
                    out.append(close())
                open_ = [r.conv, None, None, 0, None, [0, 0, 0, 0, 0], [], hashlib.sha256(), False]
            if r.low is not None:
                low, high = int(r.low), int(r.high)
                open_[3] += r.turns - (open_[2] == low)
                open_[1] = low if open_[1] is None else open_[1]
                open_[2] = high
            counts = open_[5]
            for k, n in enumerate((r.blank, r.duplicate, r.truncated, r.illegal, r.cost)):
                counts[k] += n
            if r.head is not None:
                counts[3] += open_[4] is not None and open_[4] + r.head not in _LEGAL
                open_[4] = r.tail
            open_[6].append(r.audit)
            for role, text in zip(r.roles, r.texts, strict=True):
                open_[7].update((("\n" if open_[8] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                open_[8] = True
        if out:
            yield pd.DataFrame(out, columns=_REPORT)
    if open_ is not None:
        yield pd.DataFrame([close()], columns=_REPORT)


def report(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows(conv_id, turn, role, text[, times])``; ``times`` says how often a row stands there, 0
    not at all, though its conversation is reported (zeros and empty strings if it has no
    other rows). Rows go by turn, those without one first, then by role and text. Null
    roles and texts are one space, a null conv_id is a conversation of its own. Equal rows are
    counted before they are sorted, so any number of them is one. An empty table gives an
    empty one; other columns are ignored. ``steps`` rows make a block. An audit has a letter for each row of its conversation.
    """
    whole, edged = _solved(rows, steps)
    schema = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = whole.mapInPandas(_reported, schema).unionByName(_in_order(edged, _reported, schema))
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *_REPORT[1:])
