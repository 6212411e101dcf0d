"""Personal data: fixed patterns, and terms that reveal what they occur with.

The patterns find mail addresses, IP addresses, card and phone numbers; each distinct value
is a protected entity c. From the whole corpus come document counts of entities, of terms t,
and of both together, wherever in a document they stand. A term discloses the share
PMI(c; t) / IC(c) = 1 - IC(c | t) / IC(c) of what knowing c would tell. Of P(c | t) a lower
bound is taken: a term seen with c in m different contexts has its share of documents times
level ** (1 / m), the exact bound for m of m, where ``level`` is LEVEL divided by the
number of pairs of an entity and a term that were looked at. So what meets c a few times by
chance discloses nothing, and the contexts a term needs grow with the number of terms.

A context is the words around c, across line breaks, so that copies of one text are one
context. Terms whose share reaches the threshold are treated where they can reveal: in
every document that holds c, and in every other one with two different terms that disclose
the same c. They are generalised to their shape, or removed where the shape too discloses
c. In documents with a mail address, capitalised or CJK words that spell out a run of two or
more letters of its local part are generalised as well, whatever the counts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.operators.stage import stage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.8  # share of an entity's information from which a term is treated
LEVEL = 0.05  # chance that any term of a corpus is taken to disclose more than it does
TOGETHER = 2  # terms of one entity from which they are treated in a document without it
WINDOW = 8  # words on either side of an entity that make its context
REACH = 256  # characters on either side in which those words are looked for
FILTER_BITS = 1 << 23  # size of the filter that says which terms need counting
REMEMBERED = 1 << 19  # words a task remembers the filter's answer for
COUNTED = 1 << 18  # terms a task adds up before it hands them on
SHAPES = ("[NAME]", "[WORD]")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
LETTERS = 4  # of a term that is neither capitalised nor CJK


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, in code points, ordered by kind and start."""
    text = text or ""
    finders = (_emails, _addresses, _cards, _phones)
    return [(k, a, b) for k, find in enumerate(finders) for a, b in find(text)]


def _entity(kind: int, value: str) -> str:
    if kind >= 2:
        value = "".join(c for c in value if c.isdigit())
    return f"{KINDS[kind]}:{value.lower()}"


def _shape(term: str) -> str:
    return SHAPES[0] if term[0].isupper() else SHAPES[1]


def _name(word: str) -> bool:
    return word[0].isupper() or _CJK.search(word) is not None


def _fits(word: str) -> bool:
    return len(word) >= LETTERS or _name(word)


def _outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Words outside all base spans."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            yield m


def _context(text: str, start: int, end: int) -> int:
    """Hash of the terms within WINDOW words of a span, half words at the edges left out."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    while low and low < start and text[low - 1].isalpha() and text[low].isalpha():
        low += 1
    while high < len(text) and high > end and text[high - 1].isalpha() and text[high].isalpha():
        high -= 1
    near = _WORD.findall(text, low, start)[-WINDOW:] + _WORD.findall(text, end, high)[:WINDOW]
    return xxhash.xxh64_intdigest(" ".join(near).lower().encode("utf-8", "surrogatepass"), 1) >> 1


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found, entities, words, own = [], [], [], []
        for text in frame["text"]:
            text = text or ""
            spans = base_spans(text)
            seen: dict[str, list[int]] = {}
            parts: set[str] = set()
            for kind, a, b in spans:
                seen.setdefault(_entity(kind, text[a:b]), []).append(_context(text, a, b))
                if kind == 0:
                    parts.update(p for p in _WORD.findall(text[a:b].partition("@")[0].lower()) if len(p) > 1)
            terms: dict[str, list[bool]] = {}
            mine = []
            for m in _outside(text, spans) if spans else ():
                w = m.group()
                t = w.lower()
                has = terms.setdefault(t, [False, False, False])
                if _fits(w):
                    has[0] = True
                    has[1 if _shape(w) == SHAPES[0] else 2] = True
                if t in parts and _name(w):
                    mine.append({"start": m.start(), "stop": m.end(), "replacement": _shape(w)})
            found.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
            entities.append([{"entity": e, "low": min(c)} for e, c in seen.items()])
            words.append([{"term": t, "fits": fits, "name": name, "word": word} for t, (fits, name, word) in terms.items()])
            own.append(mine)
        yield pd.DataFrame({"id": frame["id"], "mark": frame["mark"], "spans": found, "entities": entities, "words": words, "own": own})


_TERMS = "array<struct<start: int, stop: int, replacement: string>>"
_SCAN = (
    "id string, mark long, spans array<struct<kind: int, start: int, stop: int>>, entities array<struct<entity: string, low: long>>, "
    f"words array<struct<term: string, fits: boolean, name: boolean, word: boolean>>, own {_TERMS}"
)


def scanned(keyed: DataFrame) -> DataFrame:
    """One row a document of ``_keyed``: its base spans, entities with a context each, words beside them, and a number as ``row``; staged."""
    return stage(keyed.mapInPandas(_scan, _SCAN).withColumn("row", F.monotonically_increasing_id()))


def _keyed(documents: DataFrame) -> DataFrame:
    """Rows by id and a hash of id and text, so that rows without an id or with a repeated one find their own spans."""
    return documents.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("doc_id", "text").alias("mark"), "text")


def _filter_of(terms: DataFrame) -> np.ndarray:
    """A bit for the hash of each term; FILTER_BITS bits whatever the number of terms."""
    h = F.xxhash64("term").bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = terms.select(h.alias("h")).select(F.shiftright("h", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _wanted(held: np.ndarray, known: dict[str, bool], word: str) -> bool:
    """Whether the filter lets ``word`` through, remembered in ``known``."""
    if word not in known:
        if len(known) > REMEMBERED:
            known.clear()
        at = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 42) & (FILTER_BITS - 1)
        known[word] = bool(int(held[at >> 6]) >> (at & 63) & 1)
    return known[word]


def _without_mail(text: str) -> str:
    """The text with its mail addresses blanked; other base spans hold no letters."""
    if "@" not in text:
        return text
    out, at = [], 0
    for a, b in _emails(text):
        out += [text[at:a], " "]
        at = b
    return "".join([*out, text[at:]])


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many rows each of ``terms(term)``, and each shape, occurs outside base spans, over all whole texts.

    Texts are read once; words a fixed-size filter rules out are not counted, and the few
    it lets through by chance are dropped by the join that uses the counts.
    """
    bits = documents.sparkSession.sparkContext.broadcast(_filter_of(terms))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = bits.value, {}
        n: Counter[str] = Counter()
        for frame in frames:
            for text in frame["text"]:
                words = set(_WORD.findall(_without_mail(text or "")))
                n.update({w.lower() for w in words if (known[w] if w in known else _wanted(held, known, w))})
                n.update({_shape(w) for w in words if _fits(w)})
            if len(n) > COUNTED:
                yield pd.DataFrame({"term": list(n), "n": list(n.values())})
                n = Counter()
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values())})

    return documents.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def occurrences(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, mark, term, shape, start, stop) of every place outside base spans where one of ``terms(term)`` stands, over all whole texts.

    The filter lets a few other words through, which the caller's join drops.
    """
    bits = documents.sparkSession.sparkContext.broadcast(_filter_of(terms))

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = bits.value, {}
        for frame in frames:
            rows = []
            for i, mark, text in zip(frame["id"], frame["mark"], frame["text"], strict=True):
                text = text or ""
                if any([_wanted(held, known, w) for w in set(_WORD.findall(text))]):
                    for m in _outside(text, base_spans(text)):
                        w = m.group()
                        if _wanted(held, known, w):
                            rows.append((i, mark, w.lower(), _shape(w), m.start(), m.end()))
            yield pd.DataFrame(rows, columns=["id", "mark", "term", "shape", "start", "stop"])

    return documents.select("id", "mark", "text").mapInPandas(places, "id string, mark long, term string, shape string, start int, stop int")


def disclosing(documents: DataFrame, scanned: DataFrame) -> DataFrame:
    """(entity, term, share, bare) of the terms that disclose an entity; ``bare`` holds the shapes that disclose it too.

    Counts are of rows, a repeated row as often as it stands there. Entities without the
    contexts that a single term would need are left out first; terms come once a row, and
    those standing in too many rows with entities to disclose any are dropped before they
    meet the entities. No row, no entity or no such term gives no rows.
    """
    total = documents.count()
    one = F.explode("entities").alias("e")
    held = scanned.select("row", one).select("row", "e.entity", F.col("e.low").alias("context"))
    entities = held.groupBy("entity", "context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("contexts"))
    able = _share(F.pow(F.lit(LEVEL), 1 / F.col("contexts")), total) >= DISCLOSURE
    entities = stage(entities.where(able).select("entity", "n_entity"))
    held = stage(held.join(entities, "entity"))
    # P(c | t) is n_entity / n_term at most, so a term in more rows than this discloses no entity.
    most = entities.agg(F.max(F.pow("n_entity", F.lit(DISCLOSURE)) * F.lit(float(max(total, 1)) ** (1 - DISCLOSURE)))).first()[0]
    if most is None:
        return held.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("share"), F.array(F.lit("")).alias("bare")).where("false")
    rows = scanned.join(held.select("row").distinct(), "row", "left_semi").select("row", F.explode("words").alias("w")).select("row", "w.*")
    seen = rows.groupBy("term").agg(F.count("*").alias("n_seen"), F.max("fits").alias("fits"))
    seen = stage(seen.where(F.col("fits") & (F.col("n_seen") > 1) & (F.col("n_seen") <= F.lit(most))).select("term", "n_seen"))
    pairs = rows.select("row", "term").join(seen, "term").join(held, "row")
    both = pairs.groupBy("entity", "n_entity", "term", "n_seen", "context").agg(F.count("*").alias("n"))
    both = stage(both.groupBy("entity", "n_entity", "term", "n_seen").agg(F.sum("n").alias("n_both"), F.count("*").alias("contexts")))
    level = LEVEL / max(both.count(), 1)
    lowered = F.pow(F.lit(level), 1 / F.col("contexts")) * F.col("n_both")
    # Any rows' count is below n_term, so the share only falls when all rows are counted.
    both = stage(both.where(_share(lowered / F.col("n_seen"), total) >= DISCLOSURE))
    counts = stage(term_counts(documents, both.select("term").distinct()))
    found = both.join(counts.withColumnRenamed("n", "n_term"), "term").withColumn("share", _share(lowered / F.col("n_term"), total))
    found = stage(found.where(F.col("share") >= DISCLOSURE))
    of_shape = {r.term: r.n for r in counts.where(F.col("term").isin(*SHAPES)).collect()}
    has = lambda field: F.max(F.col(field).cast("long"))
    shaped = rows.groupBy("row").agg(has("name").alias("name"), has("word").alias("word")).join(held, "row")
    shaped = shaped.groupBy("entity").agg(F.sum("name").alias("with_name"), F.sum("word").alias("with_word"))
    bare = [
        F.when(_share(F.col(c) / F.lit(of_shape.get(s, 0) or 1), total) >= DISCLOSURE, F.lit(s))
        for s, c in zip(SHAPES, ("with_name", "with_word"), strict=True)
    ]
    return found.join(shaped, "entity").select("entity", "term", "share", F.array_compact(F.array(*bare)).alias("bare"))


def _share(given: Column, total: int) -> Column:
    """1 - IC(c | t) / IC(c) for P(c | t) ``given``, with c in n_entity of ``total`` documents; 0 where c is in all of them."""
    own = F.log(F.col("n_entity") / F.lit(float(max(total, 1))))
    return F.when(own >= 0, F.lit(0.0)).otherwise(1 - F.log(F.least(given, F.lit(1.0))) / own)


def find(documents: DataFrame) -> DataFrame:
    """(id, mark, spans, terms) of every row: base spans, and the places of disclosing terms with what replaces them.

    Null texts are empty and have no spans; an empty table gives an empty one. Whole texts are
    read whatever their length. Repeated rows get the same spans each. Counts are over all
    rows of ``documents``; other columns are ignored.
    """
    keyed = _keyed(documents)
    seen = scanned(keyed)
    reveals = stage(disclosing(keyed, seen))
    terms = stage(reveals.select("term").distinct())
    added = seen.select("id", "mark", F.explode("own").alias("o")).select("id", "mark", "o.*")
    if terms.head(1):
        met = stage(occurrences(keyed, terms).join(terms, "term"))
        links = met.select("id", "mark", "term").distinct().join(reveals.select("entity", "term", "bare"), "term")
        holders = seen.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), F.explode("entities.entity").alias("entity")).distinct()
        same = (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of"))
        holders = holders.select("of", "of_mark", F.col("entity").alias("has"), F.lit(True).alias("held"))
        links = links.join(holders, same & (F.col("has") == F.col("entity")), "left").select("id", "mark", "term", "entity", "bare", "held")
        enough = links.groupBy("id", "mark", "entity").agg(F.count("term").alias("n")).where(F.col("n") >= TOGETHER)
        enough = enough.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), F.col("entity").alias("e"), F.lit(True).alias("together"))
        links = links.join(enough, same & (F.col("e") == F.col("entity")), "left").where("held OR together")
        links = links.groupBy("id", "mark", "term").agg(F.array_distinct(F.flatten(F.collect_set("bare"))).alias("bare"))
        links = links.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), F.col("term").alias("t"), "bare")
        treated = met.join(links, same & (F.col("t") == F.col("term")))
        treated = treated.select("id", "mark", "start", "stop", F.when(F.array_contains("bare", F.col("shape")), F.lit("")).otherwise(F.col("shape")).alias("replacement"))
        added = added.union(treated)
    added = (
        added.groupBy("id", "mark", "start", "stop").agg(F.min("replacement").alias("replacement"))
        .groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "replacement"))).alias("terms"))
    )
    added = added.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "terms")
    return (
        seen.select("id", "mark", "spans").join(added, (F.col("mark") == F.col("of_mark")) & F.col("id").eqNullSafe(F.col("of")), "left")
        .select("id", "mark", "spans", "terms")
    )


def _replace(text: str | None, spans, terms) -> str | None:
    """The text with base values replaced by their kind and terms by their replacement; the earlier of overlapping spans decides."""
    if text is None:
        return None
    cuts = [(s["start"], s["stop"], f"[{KINDS[s['kind']].upper()}]") for s in (spans if spans is not None else ())]
    cuts += [(t["start"], t["stop"], t["replacement"]) for t in (terms if terms is not None else ())]
    out, at = [], 0
    for start, stop, new in sorted(cuts):
        if start >= at:
            out += [text[at:start], new]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def _replaced(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans, terms in batches:
        yield pd.Series([_replace(*x) for x in zip(texts, spans, terms, strict=True)], dtype=object)


def sanitise(documents: DataFrame) -> DataFrame:
    """The rows with the personal data in ``text`` replaced; n_chars, where there is one, follows the new text.

    Only rows with a span are rewritten; the others keep their columns as they are.
    """
    hits = find(documents).where((F.size("spans") > 0) | F.col("terms").isNotNull())
    hits = hits.groupBy("id", "mark").agg(F.first("spans").alias("__spans"), F.first("terms").alias("__terms"))
    hits = hits.select(F.col("id").alias("__id"), F.col("mark").alias("__of"), "__spans", "__terms")
    rows = documents.withColumn("__mark", F.xxhash64("doc_id", "text"))
    rows = rows.join(hits, (F.col("__mark") == F.col("__of")) & F.col("doc_id").cast("string").eqNullSafe(F.col("__id")), "left")
    # Texts without a span are not sent to Python.
    marked = F.when(F.col("__spans").isNotNull(), F.col("text"))
    new = F.coalesce(pandas_udf(_replaced, "string")(marked, "__spans", "__terms"), F.col("text"))
    rows = rows.withColumn("__new", new)
    columns = {"text": F.col("__new"), "n_chars": F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("__new")) if "n_chars" in documents.columns else None}
    return rows.select(*[columns[c].cast(documents.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in documents.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    by_kind = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    kind = F.array(*map(F.lit, KINDS))
    name = lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.transform("spans", name)
    terms = F.transform(F.coalesce("terms", F.array().cast(_TERMS)),
                        lambda t: F.concat_ws(":", F.lit(TERM), t["start"].cast("string"), t["stop"].cast("string")))
    return found.select(
        F.col("id").cast("long").alias("doc_id"), *by_kind, F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, terms)).alias("spans"), F.size(terms).cast("long").alias("n_terms"),
    )


def base_sha256(text: str | None) -> str:
    """The same hash for one text, for tests and spot checks."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()
