"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of embeddings of its letter n-grams (2 to 4 letters, inside words, with
word edges), looked up by hash; a linear layer with softmax gives the languages. Embeddings
and layer are trained together by stochastic gradient descent in numpy. As everything after
the lookup is linear, scoring uses one table of hash -> logits and never splits words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.llm.sampling import held_out, sample_ids

UNKNOWN = "und"
# The sample of labelled rows the model may see, per language; a quarter of it calibrates.
SAMPLE_PER_LANGUAGE = 400
BUCKETS = 1 << 16
DIMENSIONS = 12
EPOCHS = 4
RATE = 2.0
# Share of the calibration texts of a known language that rejection may cost.
FALSE_REJECTION = 0.001
# Characters scored at once; a longer text is scored in pieces whose sums are added.
BLOCK = 1 << 18

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case code of each letter of the basic plane; 32 for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(1 << 16, 32, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS = table
    return _LETTERS


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _letters()[np.minimum(raw, 0xFFFF)]
    far = raw > 0xFFFF
    if far.any():
        codes = codes.copy()
        codes[far] = [c if chr(c).isalpha() else 32 for c in raw[far].tolist()]
    return codes


def _ngrams(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, valid) of the n-grams at each place, n from 2 to 4; valid ones have white space at their ends only."""
    x = codes.astype(np.uint32)
    space = x == 32
    out = []
    h = x * np.uint32(2654435761)
    inner = np.ones(len(x), dtype=bool)
    for n in (2, 3, 4):
        if len(x) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + x[n - 1:] * np.uint32(3266489917)
        if n == 2:
            valid = ~(space[:-1] & space[1:])
        else:
            inner = inner[:-1] & ~space[n - 2:-1] if n > 3 else ~space[1:-1]
            valid = inner
        mixed = h ^ (h >> np.uint32(16))
        out.append((mixed % np.uint32(BUCKETS), valid))
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of a whole text and their counts."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for codes in _blocks(text):
        for hashed, valid in _ngrams(codes):
            counts += np.bincount(hashed[valid], minlength=BUCKETS)
    which = np.flatnonzero(counts)
    return which, counts[which]


def _blocks(text: str) -> Iterator[np.ndarray]:
    for at in range(0, len(text), BLOCK):
        yield np.concatenate([[32], _codes(text[max(0, at - 3):at + BLOCK]), [32]]).astype(np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # hash -> one number per language
    bias: np.ndarray
    temperature: float
    threshold: float  # of the calibrated probability, below which a text is rejected

    def scores(self, text: str | None) -> np.ndarray | None:
        """Calibrated probabilities, or None for a text without letters."""
        total, n, letters = np.zeros(len(self.languages)), 0, False
        for codes in _blocks(text or ""):
            if not (codes != 32).any():
                continue
            letters = True
            for hashed, valid in _ngrams(codes):
                hits = hashed[valid]
                total += np.ones(len(hits)) @ self.logits.take(hits, axis=0)
                n += len(hits)
        if not letters:
            return None
        return _softmax((total / max(n, 1) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the text is rejected."""
        p = self.scores(text)
        if p is None:
            return UNKNOWN, 0.0, True
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel:
    """Fit embeddings and layer by stochastic gradient descent, then temperature and threshold.

    Every fourth text of the given order calibrates and is not trained on. Without texts the
    model knows no language and rejects everything.
    """
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 2.0)
    rng, y = np.random.default_rng(seed), np.array([languages.index(x) for x in labels])
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    layer, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    usable = [i for i, (which, _) in enumerate(bags) if len(which)]
    calibration = [i for i in usable if i % 4 == 3] or usable
    fitting = [i for i in usable if i % 4 != 3] or usable
    steps, done = max(1, EPOCHS * len(fitting)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fitting):
            which, count = bags[i]
            share = count / count.sum()
            hidden = share @ embed[which]
            p = _softmax(hidden @ layer + bias)
            p[y[i]] -= 1
            rate = RATE * (1 - done / steps)
            back = layer @ p
            layer -= rate * np.outer(hidden, p) * 0.1
            bias -= rate * p * 0.01
            embed[which] -= rate * 50 * np.outer(share, back)
            done += 1
    table = embed @ layer
    z = np.array([(c @ table[w]) / c.sum() + bias for w, c in (bags[i] for i in calibration)])
    temperature = _temperature(z, y[calibration])
    p = np.array([_softmax(r) for r in z / temperature])
    right = p.argmax(axis=1) == y[calibration]
    best = np.sort(p.max(axis=1)[right]) if right.any() else np.zeros(1)
    threshold = float(min(best[int(FALSE_REJECTION * len(best))], 0.5))
    return LanguageModel(languages, table, bias, temperature, threshold)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy on the calibration texts.

    Each text counts as wrong by one in n + 2, so that a faultless sample of n texts doesn't
    lead to certainty.
    """
    doubt = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        logp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return float(-((1 - doubt) * logp[np.arange(len(y)), y] + doubt * logp.mean(axis=1)).mean())

    return min(np.geomspace(0.05, 5, 60), key=loss)


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        pairs = [features(t or "") for t in frame["text"]]
        yield pd.DataFrame({
            "doc_id": frame["doc_id"], "lang": frame["lang"],
            "which": [w.astype("<u4").tobytes() for w, _ in pairs], "count": [c.astype("<u4").tobytes() for _, c in pairs],
        })


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on at most ``per_language`` whole texts of each language.

    Uses rows with a text and a lang whose id is not in the held-out fold. Tasks turn the
    sampled texts into n-gram counts; only those reach the driver, at most BUCKETS a text.
    """
    usable = documents.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out())
    chosen = sample_ids(usable.select("doc_id", "lang"), "lang", per_language).select("doc_id").distinct()
    rows = usable.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    bags = rows.mapInPandas(_bags, "doc_id long, lang string, which binary, count binary").toPandas().sort_values("doc_id")
    read = lambda b: np.frombuffer(b, dtype="<u4").astype(np.int64)
    order = np.random.default_rng(1).permutation(len(bags))
    bags = bags.iloc[order]
    return train([(read(w), read(c)) for w, c in zip(bags["which"], bags["count"], strict=True)], bags["lang"].tolist())


def predict_column(spark: SparkSession, model: LanguageModel, text: Column | str) -> Column:
    """Struct (lang_pred, score, rejected) of each text."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS x languages numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = pickle.loads(shared.value)
        for batch in batches:
            yield pd.DataFrame([known.predict(t) for t in batch], columns=["lang_pred", "score", "rejected"])

    return pandas_udf(run, "lang_pred string, score double, rejected boolean")(text)


def predict(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row.

    Null texts and texts without a letter get ``und``, score 0, and are rejected. Repeated
    rows give repeated results, no rows none. Other columns are ignored.
    """
    found = predict_column(documents.sparkSession, model, "text")
    rows = documents.select("doc_id", held_out().alias("held_out"), found.alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def keep_known(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows, with all their columns, whose language the model does not reject."""
    rows = documents.withColumn("__language", predict_column(documents.sparkSession, model, "text"))
    return rows.where(~F.col("__language.rejected")).select(*documents.columns)
