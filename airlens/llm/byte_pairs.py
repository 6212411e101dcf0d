"""Encoding and decoding by a byte-level vocabulary of ranks.

A text is split by the vocabulary's pattern; each match is merged alone. A match that is a
token as it stands is that token. The others are merged many at a time: matches of about one
length are the rows of a padded matrix of token ids, and in every round each row merges its
leftmost pair of the least rank. A pair's rank is looked up in a hash table of all pairs of
tokens whose bytes together are a token. A merge shortens its row by one, so the matrix
loses a column a round; rows without a pair to merge are written out and leave the matrix.
A match longer than LONG bytes merges in the same order from a heap, since a matrix
would take the square of its length.

A Python worker remembers the ids of the matches it has met.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.pair_merges import CELLS, NONE, PairTable, merge_rows, width_for
from airlens.llm.word_ids import Memory, blocks

LONG = 1024  # bytes of a match beyond which a heap merges it
AT_ONCE = 1 << 22  # characters of texts whose matches are held at once
REMEMBERED = 300_000  # matches of a generation; a worker keeps the present and the last one

# Code points that Unicode has made letters or numbers since the tables the public encoder was built
# with. It takes them as marks, so they are read as one when a text is split.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d \U000107bb-\U000107bf "
    "\U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb "
    "\U00011de0-\U00011de9 \U00011df1 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 "
    "\U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 "
    "\U0001df1f-\U0001df24 \U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de "
    "\U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 \U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff "
    "\U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)
_NEWER = regex.compile(f"[{NEWER.replace(' ', '')}]")
_MARK = "\ue000"  # for private use, so neither letter, number nor blank


class BytePairCoder:
    """One file of ranks, lines of a token in base 64 and its rank, with every single byte among them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self._single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        cut = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self._pairs = PairTable(*np.array(cut, dtype=np.int32).reshape(-1, 3).T)
        self._split = regex.compile(pattern)
        self._split_narrow = _narrow(pattern)
        self._known = Memory(REMEMBERED)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, which together are the text."""
        try:
            text.encode("latin-1")
            return self._split_narrow.findall(text)
        except UnicodeEncodeError:
            pass
        if not _NEWER.search(text):
            return self._split.findall(text)
        return [text[m.start():m.end()] for m in self._split.finditer(_NEWER.sub(_MARK, text))]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each whole text, little-endian signed 32-bit; none for a null or empty text."""
        held: list[list[list[str]]] = []
        size = 0
        for text in texts:
            held.append([])
            for block in blocks(text or ""):
                held[-1].append(self.split(block))
                size += len(block)
            if size >= AT_ONCE:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def _ids(self, texts: list[list[list[str]]]) -> Iterator[np.ndarray]:
        get, fresh = self._known.get, {}
        found, missing = [], []
        for text in texts:
            found.append([])
            for pieces in text:
                parts = list(map(get, pieces))
                at = [k for k, ids in enumerate(parts) if ids is None] if None in parts else []
                fresh.update(dict.fromkeys([pieces[k] for k in at]))
                found[-1].append(parts)
                missing.append((parts, pieces, at))
        for piece in fresh:
            fresh[piece] = self._known.find(piece)
        new = [piece for piece, ids in fresh.items() if ids is None]
        for piece, ids in zip(new, self.merge([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            fresh[piece] = ids
            self._known.put(piece, ids)
        for parts, pieces, at in missing:
            for k in at:
                parts[k] = fresh[pieces[k]]
        for text in found:
            yield np.frombuffer(b"".join([ids for parts in text for ids in parts]), dtype="<i4")

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match as bytes of 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.int32(whole).tobytes()
            elif len(piece) > LONG:
                out[k] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(width_for(len(piece)), []).append(k)
        for width, members in by_width.items():
            rows = max(1, CELLS // width)
            for at in range(0, len(members), rows):
                self._merge_rows(pieces, members[at:at + rows], width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in members]), dtype=np.uint8).reshape(-1, width)
        sizes = np.array([len(pieces[k]) for k in members])
        ids = np.where(np.arange(width) < sizes[:, None], self._single[raw], np.int32(-1))
        for k, merged in zip(members, merge_rows(self._pairs, ids), strict=True):
            out[k] = merged

    def _merge_long(self, piece: bytes) -> bytes:
        ids: list[int] = self._single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        tokens, ranks = self.tokens, self.ranks

        def rank_at(k: int) -> int | None:
            return ranks.get(tokens[ids[k]] + tokens[ids[after[k]]]) if after[k] < n else None

        first = self._pairs.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[k]), k) for k in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if not alive[k] or rank_at(k) != rank:
                continue  # merged otherwise since
            gone = after[k]
            alive[gone] = False
            ids[k], after[k] = rank, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for side in (before[k], k):
                if side >= 0 and (r := rank_at(side)) is not None:
                    heapq.heappush(heap, (r, side))
        return np.array([i for i, a in zip(ids, alive, strict=True) if a], dtype="<i4").tobytes()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens one after the other."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _narrow(pattern: str) -> re.Pattern:
    """The pattern for texts of code points below 256, with its classes written out, which is faster to match."""
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        if name == r"\S":
            pattern = pattern.replace(name, f"[^{members}]")
            break
        members = "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
        inside = regex.compile(r"(\[[^\]]*)" + regex.escape(name))
        while inside.search(pattern):
            pattern = inside.sub(lambda m: m[1] + members, pattern)  # noqa: B023
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern)


@functools.cache
def shared_coder(path: str, pattern: str) -> BytePairCoder:
    """The coder of this Python worker, which keeps its memory from task to task."""
    return BytePairCoder(path, pattern)


def _mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    # Ids go through pandas as text: a column of longs with a null would turn to floats there.
    found = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {schema}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of all whole texts, one row a row.

    Null and empty texts have no ids; an empty table gives an empty one. Repeated rows get
    the same ids each; columns beyond doc_id and text are ignored. Texts of any length are whole.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": list(coder.encode(frame["text"]))})

    return _mapped(documents.select("doc_id", "text"), run, "ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) with the bytes of the ids; null ids give no bytes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "decoded": [coder.decode([] if i is None else i) for i in frame["ids"]]})

    return _mapped(encoded.select("doc_id", "ids"), run, "decoded binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids as decimals joined by commas and of the bytes decoded from them.

    Encodes and decodes in one pass, so ids do not leave the task; rows as for ``encode``.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(path, pattern)
        for frame in frames:
            rows = []
            for found in coder.encode(frame["text"]):
                ids = found.tolist()
                joined = ",".join(map(str, ids)).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=frame["doc_id"].to_numpy())

    return _mapped(documents.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
