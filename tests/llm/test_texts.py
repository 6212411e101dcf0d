"""Operators on documents: results against brute force, and the awkward rows."""

import hashlib
import itertools
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from airlens.llm import language, packing, pieces, pii, quality, resharding, simhash, token_store
from airlens.llm.word_ids import WordCoder, WordTable

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# --- ids ---

@pytest.mark.parametrize("path,dropped", [(WORD, True), (BYTE, False)])
def test_word_coder_equals_library(spark, sf_dir, path, dropped, monkeypatch):
    texts = [r.text for r in table(spark, sf_dir).limit(60).collect()]
    texts += ["a  b", " a", "a ", "\n\n x", "a b", "it's  'should", "é x", "<|endoftext|> a", "a\x1cb \x85", "", "end.\nStart 12.5%"]
    coder, want = WordCoder(path, dropped), library(path)
    assert all(coder.encode(t).tolist() == want(t) for t in texts + texts)
    monkeypatch.setattr("airlens.llm.word_ids.BLOCK", 40)
    assert all(coder.encode(t).tolist() == want(t) for t in texts)


@pytest.mark.parametrize("path,dropped,words", [(WORD, True, ["qzword", "x"]), (BYTE, False, [" QZWORD", " qzword", "Qzword", "qzWord"])])
def test_marks_line_breaks_and_case_make_no_new_words(path, dropped, words, monkeypatch):
    coder, seen, want = WordCoder(path, dropped), [], library(path)
    make = coder._letters.ids
    monkeypatch.setattr(coder._letters, "ids", lambda some, *rest: (seen.extend(some), make(some, *rest))[1])
    texts = ["Qzword qzword QZWORD, qzword.", "Qzword qzword!?\nqzWord qzword;", "x" if dropped else "Qzword"]
    assert [a.tolist() for a in coder.encode_all(texts)] == [want(t) for t in texts]
    assert sorted(seen) == sorted(words)
    odd = ["H\u0331 a", "E\u0301, T\u0308.", "a.\n\nb,\n c", "don't, 'll. it's.", "3. 4, x.5 a..", "\0 a. b", "a.\u00a0b.\x85c."]
    assert [a.tolist() for a in coder.encode_all(odd)] == [want(t) for t in odd]


@pytest.mark.parametrize("path,dropped", [(WORD, True), (BYTE, False)])
def test_words_are_looked_up_and_merged_as_arrays(path, dropped):
    words = ["".join(w) for w in itertools.product("aeinorstxyzq", repeat=4)]
    coder, calls = WordCoder(path, dropped), []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        got = coder.encode(" ".join(words))
    finally:
        sys.setprofile(None)
    assert got.tolist() == library(path)(" ".join(words))
    assert len(calls) < len(words) / 10  # no call of a Python function for each word


@pytest.mark.parametrize("path,dropped", [(WORD, True), (BYTE, False)])
@pytest.mark.parametrize("limit", [3, 1000])
def test_words_of_one_hash_and_begun_anew(path, dropped, limit, monkeypatch):
    monkeypatch.setattr(WordTable, "_hash", lambda self, keys: np.zeros(len(keys), dtype=np.uint64))
    monkeypatch.setattr("airlens.llm.word_ids.AT_ONCE", 90)
    coder, want = WordCoder(path, dropped), library(path)
    coder._short = WordTable(limit)
    texts = ["a b ab ba", "a\0 a a\0\0 b", None, "", "a  b\n\nc", " ".join(["x" * n for n in (21, 22, 23, 24, 47, 48, 49, 99)])]
    texts += ["\u00e9" * 11 + " " + "\u00e9" * 12 + " \u00c9t\u00c9 \u65e5\u672c\u8a9e 12.5", "ab " + "ab," * 9 + " ba. b!", "a b ab ba"]
    assert [a.tolist() for a in coder.encode_all(texts + texts)] == [want(t) for t in texts + texts]
    assert coder._short.n > 1 and (limit == 1000 or coder._short.n < 60)


# --- packing ---

def test_configurations_hold_exactly_the_histogram():
    rng = np.random.default_rng(1)
    for n in (1, 7, 400):
        lengths = np.clip(rng.lognormal(5, 1, n).astype(int), 1, 200)
        want = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        found, got = packing.configurations(want, 200), {}
        for content, times in found:
            assert sum(length * k for length, k in content) <= 200
            for length, k in content:
                got[length] = got.get(length, 0) + k * times
        assert got == want
        assert sum(t for _, t in found) <= 1.02 * -(-int(lengths.sum()) // 200) + 1
    assert packing.configurations({}) == []


def test_knapsack_is_optimal():
    lengths, prices = np.array([3, 4, 7]), np.array([3.1, 4.3, 7.2])
    found = packing.best_configuration(lengths, prices, 18)
    best = max(a * 3.1 + b * 4.3 + c * 7.2 for a in range(7) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 18)
    assert sum(prices[k] * n for k, n in found.items()) == pytest.approx(best)


def test_packing_rows(spark, awkward, nothing):
    packed = packing.pack_documents(awkward, WORD)
    rows = [tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    want, tokens = library(WORD), []
    for r in awkward.collect():
        ids = np.array([*want(r.text), 0], dtype="<u4")
        tokens += [(r.doc_id, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    key = lambda rows: sorted(map(repr, rows))
    assert key(rows) == key(tokens)
    for _, s in packed.toPandas().sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all() and s["length"].sum() <= 2048
    assert packing.pack_documents(nothing, WORD).count() == 0


def test_sequences_hold_the_ids(spark, awkward):
    packed = packing.pack(packing.pieces(awkward, WORD, 64, with_ids=True), 64)
    assert all(len(r.ids) <= 64 for r in packing.sequences(packed).collect())
    assert packing.sequences(packed).selectExpr("sum(size(ids))").first()[0] == packed.selectExpr("sum(length)").first()[0]


# --- pieces ---

def brute_pieces(coder, text):
    text = pieces.BLANK + text.replace(" ", pieces.BLANK) if text else ""
    worth = {k: coder._automaton.get(k) for k in coder._automaton.keys()}
    best = [(0.0, [])]
    for e in range(1, len(text) + 1):
        top = None
        for s in range(max(0, e - 20), e):
            w = text[s:e]
            if w in worth:
                found = (best[s][0] + worth[w][2], best[s][1] + [worth[w][0]])
            elif e - s == 1:
                found = (best[s][0] + coder._unknown, best[s][1] + [coder._bytes[b] for b in w.encode()])
            else:
                continue
            top = found if top is None or found[0] > top[0] else top
        best.append(top)
    return best[-1][1]


def test_pieces(spark, awkward, nothing):
    coder = pieces.PieceCoder(PIECE)
    for text in ("", "the thing  is\nnew", "日本 \x00 é 👍x", "   lead", "a" * 40, "qz\n\n then "):
        ids = coder.encode(text).tolist()
        assert ids == brute_pieces(coder, text) and coder.decode(ids) == text
    got = pieces.round_trip(awkward, PIECE).collect()
    assert len(got) == awkward.count() and all(r.same_text for r in got) and {r.n_ids for r in got if r.doc_id in (2, 3)} == {0}
    back = pieces.decode(pieces.encode(awkward, PIECE), PIECE).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in awkward.collect())
    assert pieces.round_trip(nothing, PIECE).count() == 0


# --- simhash ---

def test_masks_cover_all_pairs_of_bits():
    masks = simhash.covering_masks()
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))
    for m in masks:
        free = [i for i in range(64) if not m >> i & 1]
        finer = simhash.finer_masks(m)
        assert all(any(not f >> i & 1 and not f >> j & 1 for f in finer) for i in free for j in free)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, sf_dir, awkward, nothing, monkeypatch):
    for docs in (table(spark, sf_dir), awkward):
        got = simhash.groups(docs).select("doc_id", simhash.fingerprint_hex("fp").alias("f"), "component_id").collect()
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
        parent = list(range(len(rows)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(rows)):
            for j in range(i):
                if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
        least = {}
        for k, (d, _) in enumerate(rows):
            if d is not None:
                least[root(k)] = min(d, least.get(root(k), d))
        want = [(d, f"{f:016x}", least.get(root(k))) for k, (d, f) in enumerate(rows)]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert simhash.groups(nothing).count() == 0
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 1").count() == 1


def test_divided_buckets_lose_no_pair(spark):
    rng, fps = np.random.default_rng(0), {1 << 40}
    while len(fps) < 600:
        x = list(fps)[int(rng.integers(min(len(fps), 50)))]
        fps.add(x ^ 1 << int(rng.integers(60)) ^ 1 << int(rng.integers(60)))
    got = {tuple(r) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket=8).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


# --- resharding ---

def test_cheapest_flow_is_cheapest():
    supply, demand, cost = [5, 4], [3, 3, 3], [[1, 4, 2], [3, 1, 5]]
    flow = resharding.cheapest_flow(supply, demand, cost)
    best = min(
        a * 1 + b * 4 + (5 - a - b) * 2 + (3 - a) * 3 + (3 - b) * 1 + (3 - 5 + a + b) * 5
        for a in range(4) for b in range(4) if 0 <= 5 - a - b <= 3
    )
    assert sum(f * c for fs, cs in zip(flow, cost, strict=True) for f, c in zip(fs, cs, strict=True)) == best


def test_reshard(spark, sf_dir, awkward, nothing):
    for docs in (table(spark, sf_dir), awkward):
        rows, layout = resharding.reshard(docs, resharding.by_hash(16))
        got = rows.withColumn("size", resharding.size()).toPandas()
        assert sorted(got["text"].fillna("<none>")) == sorted(r.text if r.text is not None else "<none>" for r in docs.collect())
        narrow = rows.select("doc_id", resharding.size().alias("size"), resharding.text_crc32().alias("text_crc32"), "shard")
        for _, s in resharding.slots(narrow, layout.rows).toPandas().groupby("shard"):
            assert sorted(s["slot"]) == list(range(len(s)))
    sizes = table(spark, sf_dir).select(resharding.size().alias("size"))
    rows, layout = resharding.reshard(table(spark, sf_dir), resharding.by_hash(16))
    load = rows.groupBy("shard").agg({"text": "count"}).count()
    by_shard = [r[0] for r in rows.withColumn("size", resharding.size()).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert load == 24 and max(by_shard) - min(by_shard) <= sizes.agg({"size": "max"}).first()[0]
    assert resharding.reshard(nothing, resharding.by_hash(16))[0].count() == 0


def test_balanced_shards_stay(spark):
    docs = spark.createDataFrame([(i, "abcdefgh") for i in range(400)], "doc_id long, text string")
    rows, layout = resharding.reshard(docs, (docs["doc_id"] % 4).cast("int"), 4)
    assert layout.affected == [] and rows.where("shard <> doc_id % 4").count() == 0


# --- token files ---

def test_codes_give_any_id():
    rng = np.random.default_rng(0)
    for n in (0, 1, 64, 513, 3000):
        ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 33, n, dtype=np.uint64)).astype(np.uint32)
        held = token_store.open_segment(token_store.pack_segment([5, None], [ids[:n // 2], ids[n // 2:]]))
        at = rng.integers(0, max(n, 1), 100) if n else np.zeros(0, dtype=int)
        assert (held.all_ids() == ids).all() and (held.ids(at) == ids[at]).all() and held.doc_ids == [5, None]
    broken = bytearray(token_store.pack_segment([1], [np.arange(9, dtype=np.uint32)]))
    broken[30] ^= 1
    with pytest.raises(ValueError):
        token_store.open_segment(bytes(broken))


def test_token_files(spark, sf_dir, awkward, nothing, tmp_path):
    want = library(BYTE)
    for k, docs in enumerate((table(spark, sf_dir).limit(80), awkward)):
        token_store.write(docs, str(tmp_path / f"t{k}"), BYTE, segment=5000)
        got = token_store.read_documents(spark, str(tmp_path / f"t{k}"), with_ids=True).collect()
        texts = sorted(repr([*want(r.text), 2]) for r in docs.collect())
        assert texts == sorted(repr(list(r.ids)) for r in got)
        end, before = 0, None
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == end and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
            assert before is None or (r.doc_id is not None and r.doc_id >= before)
            end, before = end + r.n_tokens, r.doc_id if r.doc_id is not None else before
        flat = [i for r in sorted(got, key=lambda r: r.start) for i in r.ids]
        places = spark.createDataFrame([(0,), (end - 1,), (end // 2,), (end + 5,)], "place long")
        assert {tuple(r) for r in token_store.ids_at(spark, str(tmp_path / f"t{k}"), places).collect()} == {(p, flat[p]) for p in (0, end - 1, end // 2)}
    token_store.write(nothing, str(tmp_path / "none"), BYTE)
    assert token_store.read_documents(spark, str(tmp_path / "none")).count() == 0


# --- classifiers ---

def test_language(spark, sf_dir, awkward, nothing):
    docs = table(spark, "/root/testdata/sf0.01")
    model = language.fit(docs, per_language=120)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and np.mean([r.rejected for r in got]) < 0.02
    odd = language.predict(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 4, 7)} == {"und"}
    assert language.keep_known(awkward, model).columns == awkward.columns
    empty = language.fit(nothing)
    assert all(r.rejected for r in language.predict(awkward, empty).collect()) and language.predict(nothing, model).count() == 0


def test_language_reads_blocks_alike(monkeypatch):
    text = "der die das und nicht ein kleines Haus " * 40
    whole = dict(zip(*(x.tolist() for x in language.features(text)), strict=True))
    assert sum(whole.values()) > 0 and language.features("123")[0].size == 0


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        e, t = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        w = [np.exp(sum(e[i, p[i]] for i in range(n)) + sum(t[p[i], p[i + 1]] for i in range(n - 1))) for p in paths]
        want = [sum(x for x, p in zip(w, paths, strict=True) if p[i]) / sum(w) for i in range(n)]
        assert np.allclose(quality.marginals(e, t), want)
        assert np.allclose(quality._batch_marginals([e, e[:1]], t)[0], want)


def test_quality(spark, awkward, nothing):
    docs, labels = table(spark, "/root/testdata/sf0.01"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = quality.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.keep_good(awkward, model).columns == awkward.columns and quality.score(nothing, model).count() == 0
    flat = quality.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality.score(awkward, flat).collect()} == {1}
    assert 0 <= quality.score(awkward, quality.fit(nothing, labels)).first().score <= 1


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(text):
    n = lambda m: sum(c.isdigit() for c in m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= n(m) <= 19 and luhn(m.group())]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= n(m) <= 15]


def test_patterns_equal_plain_ones():
    rng, marks = np.random.default_rng(1), list("ab1234.@-+% 9()\n1") + ["@1", "4111 1111 1111 1111"]
    texts = ["".join(rng.choice(marks, rng.integers(40))) for _ in range(4000)]
    for text in [*texts, "1.2.3.4.5.6.7.8", "999.1.1.1.2.3.4", "a@b@c.d", "+1 (234) 555-1234"]:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_spans(text), text
    pii.base_spans("1" * 100_000 + "a." * 100_000 + "@")  # long runs take time in proportion


def test_personal_data(spark, sf_dir, awkward, nothing):
    docs = table(spark, sf_dir)
    for frame in (docs, awkward):
        got = pii.digest(pii.find(frame)).collect()
        want = [(r.doc_id, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r.text or "")).encode()).hexdigest()) for r in frame.collect()]
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.base_sha256)) for r in got)
    clean = pii.sanitise(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert {r.text for r in clean.where("doc_id = 1").collect()} == {"The quick brown fox jumps over the lazy dog. Mail [EMAIL] now."}
    assert pii.find(nothing).count() == 0 and pii.sanitise(nothing).count() == 0
