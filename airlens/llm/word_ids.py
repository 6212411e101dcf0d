"""Ids of whole texts by the tokenizers library, with the ids of words a task has met before.

Both vocabularies split texts into words before merging, so the ids of a text are those of
its words one after the other. A Python worker remembers the ids of the words it has met;
words of many texts are looked up, and their ids put one after the other, as whole arrays.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

from airlens.llm.pair_merges import CELLS, PairTable, merge_matrix, width_for

REMEMBERED = 600_000  # words of a generation; a worker keeps the present and the last one
LONG_WORD = 48  # longer ones are encoded but not remembered
SHORT = 23  # bytes of a word that is looked up in arrays
TABLED = 1_200_000  # short words from which a worker begins anew
BLOCK = 1 << 20  # characters encoded at once
AT_ONCE = 1 << 21  # characters of texts whose words are looked up at once


class Memory:
    """Ids of words in two generations: words in use move to the new one, the others go with the old."""

    def __init__(self, limit: int = REMEMBERED) -> None:
        self._limit = limit
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self.get = self._new.get

    def find(self, word: str) -> bytes | None:
        ids = self._new.get(word)
        if ids is None and (ids := self._old.get(word)) is not None:
            self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> None:
        if len(word) <= LONG_WORD:
            if len(self._new) >= self._limit:
                self._old, self._new = self._new, {}
                self.get = self._new.get
            self._new[word] = ids


class Lists:
    """Lists of ids: stretches of one array, by where they begin and how many ids they hold."""

    def __init__(self, n: int) -> None:
        self.used = 0
        self.begin, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self._ids = np.zeros(0, dtype="<u4")

    def put(self, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """The lists at the places ``at``: ``count`` of the ids each, one list after the other."""
        if len(at):
            self.begin, self.count = _room(self.begin, int(at.max()) + 1), _room(self.count, int(at.max()) + 1)
            self._ids = _room(self._ids, self.used + len(ids))
            self._ids[self.used:self.used + len(ids)] = ids
            self.begin[at], self.count[at] = self.used + np.cumsum(count) - count, count
            self.used += len(ids)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists at the places ``at``, one list after the other, and their numbers."""
        count = self.count[at]
        places = np.repeat(self.begin[at] - np.cumsum(count) + count, count)
        places += np.arange(len(places))
        return self._ids[places], count


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array with n rows at least; it grows twofold."""
    if n <= len(array):
        return array
    more = max(n, 2 * len(array)) - len(array)
    return np.concatenate([array, np.zeros((more, *array.shape[1:]), dtype=array.dtype)])


def cut_at(raw: bytes, mark: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with zeros after them, and where the words begin of which each ends with the mark, and their sizes."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(codes == mark[0])
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins
    return np.append(codes, np.zeros(2 * int(sizes.max()) + SHORT, dtype=np.uint8)), begins, sizes


def rows_at(codes: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """As many bytes from each beginning."""
    return np.ndarray((len(codes) - width + 1, width), np.uint8, codes, strides=(1, 1))[begins]


class WordTable:
    """Ids of words of at most SHORT bytes, by hashing with linear probes; whole arrays of words are looked up at once.

    A word's key is three numbers of 64 bits: its bytes, zeros, and its size in the last byte. Words
    are the same if their keys are, whatever the hash. Entry 0 stands for words not held.
    """

    _TIMES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    _INSIDE = np.where(np.arange(SHORT + 1) < np.arange(SHORT + 1)[:, None], 255, 0).astype(np.uint8).view("<u8")

    def __init__(self, limit: int = TABLED) -> None:
        self._limit = limit
        self._clear()

    def _clear(self) -> None:
        self.n = 1
        self.lists = Lists(1)
        self._keys = np.full((1, 3), np.iinfo(np.uint64).max, dtype=np.uint64)
        self._entry = np.zeros(1 << 12, dtype=np.int32)

    def forget(self) -> None:
        """Begin anew if too many words are held; entries found before hold no more."""
        if self.n > self._limit:
            self._clear()

    @classmethod
    def keys(cls, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of words from SHORT + 1 bytes of each, which are overwritten."""
        keys = rows.view("<u8")
        keys &= cls._INSIDE[sizes]
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        return keys

    @staticmethod
    def words(keys: np.ndarray, mark: bytes) -> list[str]:
        """The words, none of which holds the mark."""
        rows = keys.view(np.uint8).reshape(-1, SHORT + 1).copy()
        sizes = rows[:, SHORT].astype(np.int64)
        rows[np.arange(len(rows)), sizes] = mark[0]
        return rows[np.arange(SHORT + 1) <= sizes[:, None]].tobytes().decode().split(mark.decode())[:-1]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = self._TIMES
        mixed = (keys[:, 0] * a ^ keys[:, 1]) * b
        mixed ^= mixed >> np.uint64(32)
        return (mixed ^ keys[:, 2]) * c

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (self._hash(keys) >> np.uint64(65 - len(self._entry).bit_length())).astype(np.int64)

    def _others(self, entry: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where an entry holds another word."""
        held = self._keys[entry]
        return ((held[:, 0] != keys[:, 0]) | (held[:, 1] != keys[:, 1]) | (held[:, 2] != keys[:, 2])) & (entry > 0)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The words' entries."""
        slot = self._slots(keys)
        entry = self._entry[slot]
        at = np.flatnonzero(self._others(entry, keys))
        while len(at):
            slot[at] = slot[at] + 1 & len(self._entry) - 1
            entry[at] = self._entry[slot[at]]
            at = at[self._others(entry[at], keys[at])]
        return entry

    def different(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different ones of the keys, and the place of each key among them."""
        order = np.argsort(self._hash(keys))
        ranked, place = keys[order], np.empty(len(keys), dtype=np.int64)
        first = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])
        place[order] = np.cumsum(first) - 1
        return ranked[first], place

    def add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Different words that are not held, as the next entries."""
        old, self.n = self.n, self.n + len(keys)
        self._keys = _room(self._keys, self.n)
        self._keys[old:self.n] = keys
        self.lists.put(np.arange(old, self.n), ids, count)
        if 3 * self.n > len(self._entry):
            self._entry, old = np.zeros(1 << (3 * self.n).bit_length(), dtype=np.int32), 1
        entry = np.arange(old, self.n, dtype=np.int32)
        slot = self._slots(self._keys[old:self.n])
        while len(entry):  # one of those that meet at a free slot settles, the others go on to the next slot
            free = self._entry[slot] == 0
            self._entry[slot[free]] = entry[free]
            on = self._entry[slot] != entry
            entry, slot = entry[on], slot[on] + 1 & len(self._entry) - 1


class LetterWords:
    """Words of letters below 256 by a vocabulary's merges, many at once.

    To both vocabularies a word of letters is one unit: its bytes in UTF-8, as symbols, merged
    by the order of the merges. ``ok`` is false where a file is made otherwise.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [(a, b, a + b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        self.ok = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        symbols = [_symbol(b) for b in range(256)]
        self.ok = self.ok and all(x in names and x + end in names for x in symbols) and all(x in names for m in merges for x in m)
        if self.ok:
            table = np.array([[names[x] for x in m] for m in merges], dtype=np.int32)
            self.ok = bool((np.diff(table[:, 2]) > 0).all())
            self._pairs = PairTable(*table.T)
            self._inside = np.array([names[x] for x in symbols], dtype=np.int32)
            self._last = np.array([names[x + end] for x in symbols], dtype=np.int32)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and their numbers; a word may have a blank in front."""
        codes, begins, sizes = cut_at("\0".join([*words, ""]).encode(), b"\0")
        widths = np.array([width_for(n) for n in range(int(sizes.max()) + 1)])[sizes]
        out = Lists(len(words))
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            for at in range(0, len(members), max(1, CELLS // width)):
                some = members[at:at + max(1, CELLS // width)]
                symbols, last, row = rows_at(codes, begins[some], width), sizes[some] - 1, np.arange(len(some))
                ids = np.where(np.arange(width) <= last[:, None], self._inside[symbols], np.int32(-1))
                ids[row, last] = self._last[symbols[row, last]]
                merged = merge_matrix(self._pairs, ids)
                out.put(some, merged[merged >= 0], (merged >= 0).sum(axis=1))
        return out.take(np.arange(len(words)))


def _symbol(byte: int) -> str:
    """The character that stands for a byte: itself where it is printable, else one of those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in plain else chr(256 + sum(b not in plain for b in range(byte)))


class WordCoder:
    """Encodes texts with one tokenizers file.

    ``spaces_dropped``: the vocabulary drops white space and case, so words at any blank are
    alone. Otherwise a word owns the blank before it, which holds for a single blank between
    two visible characters; texts with longer runs of white space are left to the library.
    Marks at the end of a word, and a line break between visible characters, are words of
    their own to both vocabularies.
    """

    def __init__(self, path: str, spaces_dropped: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._dropped = spaces_dropped
        self._letters = LetterWords(path)
        self._mark = b" " if spaces_dropped else b"\0"  # between words
        self._short = WordTable()
        self._long = Memory()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a null text is empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text. What is not at hand is gathered over many texts and encoded once."""
        held: list[str | list[str]] = []
        ends: list[int] = []
        size = 0
        for text in texts:
            held += [self._words(block) for block in blocks(text or "")]
            ends.append(len(held))
            size += len(text or "")
            if size >= AT_ONCE:
                yield from self._joined(held, ends)
                held, ends, size = [], [], 0
        if ends:
            yield from self._joined(held, ends)

    def _words(self, text: str) -> str | list[str]:
        """Words that may be remembered, each with the blank it owns, with marks between them; a list: stretches for the library."""
        if self._dropped:
            try:  # without marks that combine with a letter a word is the same in small letters
                text = text.encode("latin-1").lower().decode("latin-1")
            except UnicodeEncodeError:
                pass
            return _ENDS.sub(r" \g<0>", text).replace("\n", " ")
        if "\0" in text or _RUN.search(text):
            return _joined(text)
        return _BREAK.sub("\0\n\0", _ENDS.sub("\0\\g<0>", text)).replace(" ", "\0 ")

    def _joined(self, held: list[str | list[str]], ends: list[int]) -> Iterator[np.ndarray]:
        """Ids of texts, of which each ends before one of the blocks ``ends``. A block for the library is an empty word among the others."""
        raw = [b"" if isinstance(block, list) else block.encode() for block in held]
        codes, begins, sizes = cut_at(self._mark.join([*raw, b""]), self._mark)
        last = np.searchsorted(begins + sizes, np.cumsum([len(x) + 1 for x in raw]) - 1)  # the last word of each block
        entry = np.zeros(len(begins), dtype=np.int64)
        short, others = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        entry[short] = self._entries(rows_at(codes, begins[short], SHORT + 1), sizes[short])

        made = self._remembered([codes[a:a + n].tobytes().decode() for a, n in zip(begins[others].tolist(), sizes[others].tolist(), strict=True)])
        whole = [k for k, block in enumerate(held) if isinstance(block, list)]
        made += [b"".join(self._library(held[k])) for k in whole]
        lists, n = self._short.lists, self._short.n
        kept = lists.used
        places = np.arange(n, n + len(made))  # after the table's own lists, for these texts only
        lists.put(places, *_array(made))
        entry[np.append(others, last[whole])] = places
        ids, count = lists.take(entry)
        lists.used = kept

        end = np.cumsum(count)[last[np.array(ends) - 1]].tolist()
        for a, b in zip([0, *end], end, strict=False):
            yield ids[a:b]

    def _entries(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of short words; those not held are made."""
        table = self._short
        table.forget()
        keys = table.keys(rows, sizes)
        entry = table.find(keys)
        new = np.flatnonzero(entry == 0)
        if len(new):
            different, place = table.different(keys[new])
            ids = self._made(table.words(different, self._mark))
            entry[new] = table.n + place
            table.add(different, *ids)
        return entry

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Ids of long words."""
        found = {w: self._long.find(w) for w in words}
        missing = [w for w, ids in found.items() if ids is None]
        ids, count = self._made(missing)
        for w, one in zip(missing, np.split(ids, np.cumsum(count)[:-1]), strict=True) if missing else ():
            found[w] = one.tobytes()
            self._long.put(w, found[w])
        return [found[w] for w in words]

    def _made(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and their numbers: plain words by their merges, the others by the library."""
        plain = np.array([self._letters.ok and _LETTERS.fullmatch(w) is not None for w in words], dtype=bool)
        out = Lists(len(words))
        if plain.any():
            some = list(itertools.compress(words, plain))
            out.put(np.flatnonzero(plain), *self._letters.ids([w.lower() for w in some] if self._dropped else some))
        out.put(np.flatnonzero(~plain), *_array(self._library(list(itertools.compress(words, ~plain)))))
        return out.take(np.arange(len(words)))

    def _library(self, words: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _array(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the lists, one after the other, and their numbers."""
    return np.frombuffer(b"".join(lists), dtype="<u4"), np.array([len(x) // 4 for x in lists], dtype=np.int64)


@functools.cache
def shared_coder(path: str, spaces_dropped: bool) -> WordCoder:
    """The coder of this Python worker, which keeps its memory from task to task."""
    return WordCoder(path, spaces_dropped)


# Visible to every definition of white space: printable ASCII, or a letter, digit or underscore. Below: a blank
# that is not between two visible characters; a line break that is; marks after a letter that end a word. What
# each looks for comes first, so that a text is scanned for it fast.
_RUN = re.compile(r" (?:(?![!-~\w])|(?<![!-~\w] ))")
_BREAK = re.compile(r"\n(?<=[!-~\w]\n)(?=[!-~\w])")
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]{1,48}")
_ENDS = re.compile(r"[.,;:!?|&%$#*)](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)[.,;:!?|&%$#*)]*(?![^ \n])")
_CUT = re.compile(r"[!-~\w](?= [!-~\w])")


def _joined(text: str) -> list[str]:
    """Stretches of a text, cut before every blank between two visible characters."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        out.append(text[at:m.end()])
        at = m.end()
    return [*out, text[at:]]


def blocks(text: str) -> Iterator[str]:
    """Stretches of a long text, cut before a blank between two visible characters."""
    at = 0
    while len(text) - at > BLOCK:
        cut = _CUT.search(text, at + BLOCK - 1)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:]
