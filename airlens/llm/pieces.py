"""Encoding and decoding with a SentencePiece vocabulary.

An Aho-Corasick automaton over the pieces reads a text once; at every place its output links
name the pieces that end there, and each relaxes the best score of that place (Viterbi). The
highest sum of piece scores wins, ties go to the longer last piece. A character without a
piece scores ten below the lowest piece and becomes its bytes. Scores are added exactly.
This is a unigram reading of the scores: for a BPE model, whose scores are merge ranks, the
ids are not those of the library's encoder.

Blanks become U+2581, with one before the text. As no piece has a blank after another
character, the stretches between blanks are independent, and a task remembers their ids.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.word_ids import Memory

BLANK = "▁"
PENALTY = 10.0  # of a character without a piece, below the lowest score
REMEMBERED = 200_000  # stretches of a generation; a worker keeps the present and the last one
ROWS = 256  # texts whose ids are held at once
LONG = 48  # longer ones are encoded but not remembered


class PieceCoder:
    """One vocabulary file whose normaliser leaves texts as they are, with byte pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self._bytes = {int(self._names[i][3:5], 16): i for i in range(len(self._names)) if model.is_byte(i)}
        self._byte_of = {i: b for b, i in self._bytes.items()}
        self._silent = {i for i in range(len(self._names)) if model.is_control(i) or model.is_unknown(i)}
        self._automaton = ahocorasick.Automaton()
        normal = [i for i in range(len(self._names)) if i not in self._byte_of and i not in self._silent and self._names[i]]
        for i in normal:
            self._automaton.add_word(self._names[i], (i, len(self._names[i]), float(model.get_score(i))))
        self._automaton.make_automaton()
        self._single = {self._names[i] for i in normal if len(self._names[i]) == 1}
        self._unknown = min((model.get_score(i) for i in normal), default=0.0) - PENALTY
        self._plain = np.array([i not in self._byte_of and i not in self._silent for i in range(len(self._names))])
        # Where no piece can lie across: before a blank after another character, at a line break, and between a letter
        # and a mark. The vocabulary says which of these hold.
        pairs = {(a, b) for i in normal for a, b in itertools.pairwise(self._names[i])}
        breaks = not any("\n" in self._names[i] for i in normal)
        marks = "".join(m for m in ".,;:!?|&%$#*)" if not any(b == m and a.isalpha() for a, b in pairs))
        if any(b == BLANK and a != BLANK for a, b in pairs):
            self._stretch, self._words = re.compile(r".+", re.DOTALL), False
        else:
            self._stretch = re.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if breaks else rf"{BLANK}*[^{BLANK}]+|{BLANK}+", re.DOTALL)
            self._words = breaks
        self._marked = re.compile(rf"(.*[A-Za-z])([{re.escape(marks)}]+)") if marks else None
        self._known = Memory(REMEMBERED)

    def best(self, text: str) -> list[int]:
        """Ids of a text whose blanks are already U+2581, by one pass of the automaton."""
        n = len(text)
        if self._single.issuperset(text):  # every place ends some piece
            top, last, length = [0.0] + [float("-inf")] * n, [0] * (n + 1), [0] * (n + 1)
            for end, (piece, size, worth) in self._automaton.iter(text):
                reach = top[end + 1 - size] + worth
                if reach > top[end + 1]:
                    top[end + 1], last[end + 1], length[end + 1] = reach, piece, size
            found: list[int] = []
            while n:
                found.append(last[n])
                n -= length[n]
            return found[::-1]
        score, last, length = [0.0] * (n + 1), [-1] * (n + 1), [1] * (n + 1)
        reached, single, unknown = 0, self._single, self._unknown

        def alone(upto: int) -> None:  # characters no piece ends at
            for e in range(reached + 1, upto):
                score[e], last[e], length[e] = score[e - 1] + unknown, -1, 1

        at = 0  # the place whose pieces are being relaxed
        for end, (piece, size, worth) in self._automaton.iter(text):
            end += 1
            if end != at:
                if at and text[at - 1] not in single and score[at - 1] + unknown > score[at]:
                    score[at], last[at], length[at] = score[at - 1] + unknown, -1, 1
                reached = at
                alone(end)
                at = end
                score[end] = float("-inf")
            reach = score[end - size] + worth
            if reach > score[end]:
                score[end], last[end], length[end] = reach, piece, size
        if at and text[at - 1] not in single and score[at - 1] + unknown > score[at]:
            score[at], last[at], length[at] = score[at - 1] + unknown, -1, 1
        reached = at
        alone(n + 1)
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                out += [self._bytes[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass"))]
            n -= length[n]
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one."""
        if not text:
            return np.zeros(0, dtype="<i4")
        if self._words and BLANK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            units = [BLANK + w for w in text.split(" ")]
        else:
            units = self._stretch.findall(BLANK + text.replace(" ", BLANK))
        parts = list(map(self._known.get, units))
        if None in parts:
            parts = [self._unit(u) if p is None else p for u, p in zip(units, parts, strict=True)]
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def _unit(self, unit: str) -> bytes:
        """Ids of a stretch that stands alone, cut further where no piece can lie across."""
        ids = self._known.find(unit)
        if ids is not None:
            return ids
        if self._words and "\n" in unit and unit != "\n":
            return b"".join(map(self._unit, self._stretch.findall(unit)))
        cut = self._marked.fullmatch(unit) if self._marked else None
        ids = self._unit(cut[1]) + self._unit(cut[2]) if cut else array("i", self.best(unit)).tobytes()
        if len(unit) <= LONG:
            self._known.put(unit, ids)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; byte pieces join to characters, control pieces say nothing, the blank before the text goes."""
        ids, names = np.asarray(ids, dtype=np.int64), self._names
        plain = self._plain[ids]
        out, at = [], 0
        borders = np.flatnonzero(plain[1:] != plain[:-1]) + 1
        for end in [*borders.tolist(), len(ids)]:
            part = ids[at:end].tolist()
            if at < end and plain[at]:
                out.append("".join([names[i] for i in part]))
            elif part:
                for silent, run in itertools.groupby(part, self._silent.__contains__):
                    if not silent:
                        out.append(bytes(map(self._byte_of.__getitem__, run)).decode("utf-8", "replace"))
            at = end
        return "".join(out).replace(BLANK, " ").removeprefix(" ")


@functools.cache
def shared_coder(path: str) -> PieceCoder:
    """The coder of this Python worker, which keeps its memory from task to task."""
    return PieceCoder(path)


def _small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            yield frame.iloc[at:at + ROWS]


def encode(documents: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of all whole texts. Null and empty texts have no ids; other columns are ignored."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(model)
        for frame in _small(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": [coder.encode(t) for t in frame["text"]]})

    found = documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, ids array<int>")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of ids; null ids give an empty text. U+2581 in a text comes back as a blank, as with the library."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(model)
        for frame in _small(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [coder.decode([] if i is None else i) for i in frame["ids"]]})

    found = encoded.select(F.col("doc_id").cast("string"), "ids").mapInPandas(run, "doc_id string, text string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def round_trip(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids, their crc32 and that of the text decoded from them, and whether that is the text.

    A null text has no ids and decodes to the empty text, which counts as the same.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_coder(model)
        for frame in _small(frames):
            ids = [coder.encode(t) for t in frame["text"]]
            back = [coder.decode(i) for i in ids]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n_ids": [len(i) for i in ids], "ids": ids, "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids],
                "decoded_crc32": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back],
                "same_text": [b == (t or "") for b, t in zip(back, frame["text"], strict=True)],
            })

    schema = "doc_id string, n_ids long, ids array<int>, ids_crc32 long, decoded_crc32 long, same_text boolean"
    return documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
