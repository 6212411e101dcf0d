"""Registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.llm import byte_pairs, conversations, importance, language, near_vectors, nearest, packing, pieces, pii, quality, resharding, simhash, token_store
from airlens.llm.settings import ready
from airlens.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OLD_SHARDS = 16


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.groups(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    documents = _table(spark, sf_dir, "documents")
    return language.predict(documents, language.fit(documents))


@_query
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


@_query
def op10_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with the terms that disclose it."""
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op7_addressable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the written files."""
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    token_store.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_documents(spark, path)


@_query
def op6_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place when a layout of 16 shards by hash is made one of 24 with equal bytes."""
    documents = _table(spark, sf_dir, "documents")
    rows, layout = resharding.reshard(documents, resharding.by_hash(OLD_SHARDS))
    narrow = rows.select("doc_id", resharding.size().alias("size"), resharding.text_crc32().alias("text_crc32"), "shard")
    return resharding.slots(narrow, layout.rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every vector."""
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLES["op4_near_vectors"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), usable AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, m) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT link.u, reach.m FROM reach JOIN link ON reach.u = link.w
), least AS (
    SELECT u AS vec_id, min(m) AS component_id FROM reach GROUP BY u
), counted AS (
    SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u
)
SELECT l.vec_id, CAST(coalesce(c.n_links, 0) AS BIGINT) AS n_links, l.component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN counted c USING (vec_id)
"""


@_query
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id 20 divides."""
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op3_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and what they decode to."""
    return pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by a file of ranks, and the bytes they decode to, as digests."""
    return byte_pairs.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, towards the benchmark texts."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# The CRC-32 of a string, from its bytes as a list of hexadecimal digits: the table is made by its rule.
_CRC_TABLE = """crc_step AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
)"""
_CRC = """xor(list_reduce(list_transform(range(strlen({0})), lambda i: CAST(('0x' || substr(hex(encode({0})), 2 * i + 1, 2)) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295)"""

ORACLES["op13_importance_resampling"] = f"""
WITH {_CRC_TABLE}, source_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), target_words AS (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark
), source_counts AS (
    SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM source_words) GROUP BY w
), target_counts AS (
    SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM target_words) GROUP BY w
), buckets AS (
    SELECT w, {_CRC.format("w")} % 10000 AS b FROM (SELECT w FROM source_counts UNION SELECT w FROM target_counts), crc_step
), counted AS (
    SELECT b, CAST(sum(coalesce(s.n, 0)) AS DOUBLE) AS s, CAST(sum(coalesce(t.n, 0)) AS DOUBLE) AS t
    FROM buckets LEFT JOIN source_counts s USING (w) LEFT JOIN target_counts t USING (w) GROUP BY b
), gain AS (
    SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counted
), weighted AS (
    SELECT doc_id, len(ws) AS n_features, h, coalesce((
        SELECT sum(gain) FROM (SELECT unnest(d.ws) AS w) JOIN buckets USING (w) JOIN gain USING (b)), 0) AS weight
    FROM (SELECT *, CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM source_words) d
), scored AS (
    SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM weighted
), able AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, a.r AS rank
FROM scored s LEFT JOIN (SELECT doc_id, r FROM able WHERE r <= n * 10 // 100) a USING (doc_id)
"""


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after the exercise's damage."""
    return conversations.report(conversations.damaged(_table(spark, sf_dir, "conversations")))


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    """A state (cost, audit, lines, text) after one more edit, which writes ``line``; null from a null one."""
    text = f"k := {state}.k, r := {state}.r" if line is None else f"k := {state}.k + 1, r := CASE WHEN {state}.k = 0 THEN {line} ELSE {state}.r || chr(10) || {line} END"
    return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, p := {state}.p || '{letter}', {text}) END"


def _rows_edits(state: str, sources: str, initial: str) -> str:
    """The best state after a row: the same state with the row deleted, or a source state with it kept or given its role."""
    name = {"u": "user", "a": "assistant"}.get(initial)
    options = [_edit(state, "D", "2")]
    for source in sources:
        kept = _edit(source, "K", "e", "role || ':' || text")
        options.append(f"CASE WHEN NOT forced AND left(role, 1) = '{initial}' THEN {kept} END")
        if name:
            given = _edit(source, "R", "(1 + e)", f"'{name}:' || text")
            options.append(f"CASE WHEN NOT forced THEN {given} END")
    return f"list_min([{', '.join(options)}])"


def _inserted(state: str, sources: str, name: str) -> str:
    return f"list_min([{', '.join([state, *[_edit(x, 'I', '5', repr(name + ':')) for x in sources]])}])"


ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hit AS (
    SELECT *, {_CRC.format("key")} % 20 AS d FROM keyed, crc_step
), rows_after AS (
    SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hit
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
    FROM rows_after
), faults AS (
    SELECT conv_id, turn, role, text, i, shown = '' AS blank, shown <> '' AND seen > 1 AS duplicate,
        shown <> '' AND seen = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), steps AS (
    SELECT conv_id, i, role, text, blank OR duplicate AS forced, CASE WHEN truncated THEN 5 ELSE 0 END AS e FROM faults
), walk(conv_id, i, z, s, u, a) AS (
    SELECT conv_id, CAST(0 AS BIGINT), z, z_null, u, {_inserted("NULL", "u", "assistant").replace("NULL, ", "")}
    FROM (SELECT conv_id, z, CASE WHEN false THEN z END AS z_null, {_edit("z", "I", "5", "'user:'")} AS u
          FROM (SELECT DISTINCT conv_id, struct_pack(c := CAST(0 AS BIGINT), p := '', k := CAST(0 AS BIGINT), r := '') AS z FROM conversations))
    UNION ALL
    SELECT conv_id, i, z, s, u, {_inserted("a", "u", "assistant")}
    FROM (
        SELECT conv_id, i, z, s, {_inserted("u", "zsa", "user")} AS u, a
        FROM (
            SELECT w.conv_id, t.i, {_edit("z", "D", "2")} AS z, {_rows_edits("s", "z", "s")} AS s, {_rows_edits("u", "zsa", "u")} AS u, {_rows_edits("a", "u", "a")} AS a
            FROM walk w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
        )
    )
), least AS (
    SELECT conv_id, list_min([z, a]) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, best.c AS cost, best.p AS audit, sha256(best.r) AS repaired_sha256
FROM least l LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""
