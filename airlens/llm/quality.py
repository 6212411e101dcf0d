"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Emissions are linear in the features of the line and of
its two neighbours, transitions are learned, and the forward-backward marginals of the good
label, weighted by line length, give a document's share of good text; a logistic curve
fitted on further labelled documents turns it into a score.

Only documents are labelled. A good document's lines count as good. For a bad document the
model's own marginals say which lines are bad, with the worst line always among them; two
rounds of that follow a first one in which all its lines are bad.
"""

from __future__ import annotations

import operator
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from airlens.llm.sampling import held_out, sample_ids

THRESHOLD = 0.3  # of the score, from which a document counts as good
# The sample of labelled documents the model may see, per label; a third of it fits the curve.
SAMPLE_PER_LABEL = 1000
# Lines of a sampled document the chain is trained on at once; a longer one is trained on in stretches.
STRETCH = 64
LINES_AT_ONCE = 1 << 14

# A longer line counts as several of this many characters, the last one shorter.
LINE = 1 << 16
# Lines are described in groups of about this many characters.
BLOCK = 1 << 18

# Classes of characters; every character has one.
LOWER, UPPER, DIGIT, SPACE, PLAIN, SYMBOL, PIPE, SHOUT = range(8)
_FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "pipe", "shout", "repeated", "run",
    "long_words", "short_words", "symbol_words", "end_stop", "start_upper", "blank", "long_run",
)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Class of each character of the basic plane; what lies beyond counts as a symbol."""
    global _classes
    if _classes is None:
        table = np.full((1 << 16) + 1, SYMBOL, dtype=np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                table[i] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                table[i] = DIGIT
            elif c.isspace():
                table[i] = SPACE
        for c in ".,;:'\"()?-_":
            table[ord(c)] = PLAIN
        table[ord("|")], table[ord("!")] = PIPE, SHOUT
        _classes = table
    return _classes


def _words_of(line: str) -> tuple[int, int, int, int, int, int, int, int]:
    """Words, distinct words, equal neighbours, long words, short words, words with two marks at the end, stop at the end, capital at the start."""
    words = line.split()
    if not words:
        return 0, 0, 0, 0, 0, 0, 0, 0
    distinct = Counter(words)
    run = sum(map(operator.eq, words, words[1:])) if len(distinct) < len(words) else 0
    long = short = marked = 0
    for word, n in distinct.items():
        size = len(word)
        if size > 14:
            long += n
        elif size <= 2:
            short += n
        if not word[-1].isalnum() and size > 1 and not word[-2].isalnum():
            marked += n
    return len(words), len(distinct), run, long, short, marked, words[-1][-1] in ".!?", words[0][0].isupper()


def line_features(lines: list[str]) -> np.ndarray:
    """One row of numbers for each line, from its characters and words."""
    sizes = np.array([len(x) for x in lines])
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _class_table()[np.minimum(raw, 1 << 16)]
    place = np.repeat(np.arange(len(lines)) * 8, sizes)
    kind = np.bincount(place + kinds, minlength=8 * len(lines)).reshape(-1, 8).astype(np.float64)
    w, distinct, run, long, short, marked, stop, capital = np.array([_words_of(x) for x in lines], dtype=np.float64).T
    n, words = np.maximum(sizes, 1), np.maximum(w, 1)
    out = np.stack([
        np.log1p(sizes) / 5, np.log1p(w) / 4, (sizes - kind[:, SPACE]) / words / 10,
        kind[:, UPPER] / np.maximum(kind[:, UPPER] + kind[:, LOWER], 1), kind[:, DIGIT] / n, kind[:, PLAIN] / n, kind[:, SYMBOL] / n,
        kind[:, PIPE] / words, kind[:, SHOUT] / words, (w - distinct) / words, run / words, long / words, short / words, marked / words,
        stop, capital, w == 0, run >= 5,
    ], axis=1)
    out[w == 0, :-2] = 0
    return out


def lines_of(text: str) -> list[str]:
    lines = text.split("\n")
    if max(map(len, lines)) <= LINE:
        return lines
    return [line[at:at + LINE] for line in lines for at in range(0, max(len(line), 1), LINE)]


def _groups(lines: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for line in lines:
        group.append(line)
        size += len(line)
        if size >= BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features with those of both neighbours and a constant, lengths) of a whole text's lines."""
    lines = lines_of(text or "")
    own = np.concatenate([line_features(group) for group in _groups(lines)])
    edge = np.zeros((1, own.shape[1]))
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    first = np.zeros((len(own), 2))
    first[0, 0], first[-1, 1] = 1, 1
    return np.hstack([own, before, after, first, np.ones((len(own), 1))]), np.array([max(len(x), 1) for x in lines], dtype=np.float64)


def marginals(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of the good label of each line; emissions and transitions are log scores, label 1 is good.

    Forward and backward messages are kept as the log ratio of label 1 to label 0, which needs
    no scaling however long the chain is.
    """
    n = len(emissions)
    d = (emissions[:, 1] - emissions[:, 0]).tolist()
    t = transitions.tolist()
    forward, backward = [0.0] * n, [0.0] * n

    def passed(x: float, a: float, b: float, c: float, e: float) -> float:
        return np.logaddexp(a, x + b) - np.logaddexp(c, x + e)

    m = 0.0
    for i in range(n):
        forward[i] = m + d[i]
        m = float(passed(forward[i], t[0][1], t[1][1], t[0][0], t[1][0]))
    m = 0.0
    for i in range(n - 1, -1, -1):
        backward[i] = m
        m = float(passed(m + d[i], t[1][0], t[1][1], t[0][0], t[0][1]))
    return 1 / (1 + np.exp(-np.clip(np.array(forward) + np.array(backward), -500, 500)))


def _batch_marginals(chains: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """As ``marginals`` for many chains at once, stepping through those still running, longest first."""
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    sizes = np.array([len(chains[i]) for i in order])
    width = int(sizes[0])
    if width > STRETCH and len(chains) > 1:  # long chains alone, so that padding stays small
        cut = int((sizes > STRETCH).sum())
        out: list[np.ndarray] = [np.empty(0)] * len(chains)
        for i in order[:cut]:
            out[i] = marginals(chains[i], transitions)
        rest = order[cut:]
        if rest:
            for i, m in zip(rest, _batch_marginals([chains[i] for i in rest], transitions), strict=True):
                out[i] = m
        return out
    d = np.zeros((len(order), width))
    for k, i in enumerate(order):
        d[k, :len(chains[i])] = chains[i][:, 1] - chains[i][:, 0]
    t = transitions
    forward, backward = np.zeros_like(d), np.zeros_like(d)
    m = np.zeros(len(order))
    for c in range(width):
        forward[:, c] = m + d[:, c]
        m = np.logaddexp(t[0, 1], forward[:, c] + t[1, 1]) - np.logaddexp(t[0, 0], forward[:, c] + t[1, 0])
    m = np.zeros(len(order))
    for c in range(width - 1, -1, -1):
        here = c < sizes
        backward[:, c] = np.where(here, m, 0)
        x = m + d[:, c]
        m = np.where(here, np.logaddexp(t[1, 0], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[0, 1]), m)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
    out = [np.empty(0)] * len(chains)
    for k, i in enumerate(order):
        out[i] = p[k, :sizes[k]]
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # features -> log odds of good
    transitions: np.ndarray
    slope: float
    shift: float

    def emissions(self, features: np.ndarray) -> np.ndarray:
        odds = ((features - self.mean) / self.deviation) @ self.weights
        return np.stack([np.zeros_like(odds), odds], axis=1)

    def shares(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Length-weighted mean marginal of the good label."""
        found = _batch_marginals([self.emissions(f) for f, _ in documents], self.transitions)
        return [float((p * n).sum() / n.sum()) for p, (_, n) in zip(found, documents, strict=True)]

    def scores(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            held.append(document_features(text))
            if sum(len(n) for _, n in held) >= LINES_AT_ONCE:
                out, held = out + self.shares(held), []
        return [self.score(x) for x in out + (self.shares(held) if held else [])]

    def score(self, share: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift))))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _fit_chain(features: list[np.ndarray], targets: list[np.ndarray], weights: list[float], steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions that maximise the likelihood of soft line labels, by Adam.

    The gradient is the expected count of the targets minus that of the model; pairs of
    neighbouring targets count as independent given the lines.
    """
    width = max(len(f) for f in features)
    n, k = len(features), features[0].shape[1]
    x = np.zeros((n, width, k))
    y, mask = np.zeros((n, width)), np.zeros((n, width))
    for i, (f, t) in enumerate(zip(features, targets, strict=True)):
        x[i, :len(f)], y[i, :len(f)], mask[i, :len(f)] = f, t, 1
    per_line = mask * (np.array(weights) / np.maximum(mask.sum(1), 1))[:, None]
    total = per_line.sum()
    pair = per_line[:, 1:] * mask[:, 1:]
    w, t = np.zeros(k), np.zeros((2, 2))
    state = [np.zeros(k), np.zeros(k), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        d = x @ w
        forward, backward = np.zeros_like(d), np.zeros_like(d)
        m = np.zeros(n)
        for c in range(width):
            forward[:, c] = m + d[:, c]
            m = np.logaddexp(t[0, 1], forward[:, c] + t[1, 1]) - np.logaddexp(t[0, 0], forward[:, c] + t[1, 0])
        m = np.zeros(n)
        for c in range(width - 1, -1, -1):
            here = mask[:, c] > 0
            backward[:, c] = np.where(here, m, 0)
            z = m + d[:, c]
            m = np.where(here, np.logaddexp(t[1, 0], z + t[1, 1]) - np.logaddexp(t[0, 0], z + t[0, 1]), 0)
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        grad_w = np.einsum("nl,nlk->k", (y - p) * per_line, x) / total - 1e-3 * w
        right = backward[:, 1:] + d[:, 1:]
        joint = np.zeros((n, width - 1, 2, 2)) if width > 1 else np.zeros((n, 0, 2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint[:, :, a, b] = a * forward[:, :-1] + t[a, b] + b * right
        joint -= joint.max(axis=(2, 3), keepdims=True) if width > 1 else 0
        joint = np.exp(joint)
        joint /= joint.sum(axis=(2, 3), keepdims=True) if width > 1 else 1
        left_y, right_y = y[:, :-1], y[:, 1:]
        grad_t = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                want = (left_y if a else 1 - left_y) * (right_y if b else 1 - right_y)
                grad_t[a, b] = ((want - joint[:, :, a, b]) * pair).sum() / total
        grad_t -= 1e-2 * t
        for value, grad, at in ((w, grad_w, 0), (t, grad_t, 2)):
            state[at] = 0.9 * state[at] + 0.1 * grad
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * grad**2
            value += 0.1 * (state[at] / (1 - 0.9**step)) / (np.sqrt(state[at + 1] / (1 - 0.99**step)) + 1e-8)
    return w, t


def train(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], good: float = 0.5) -> QualityModel:
    """Fit the chain on two thirds of the documents and the score curve on the others.

    ``good`` is the share of good documents among all labelled ones; the sample holds both
    labels in other shares, and the curve is shifted by the difference. With one label only, or none, every document gets the share of good ones (one half without any).
    """
    width = 3 * len(_FEATURES) + 3
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        base = _logit(float(y.mean()) if len(y) else 0.5)
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), 0.0, base)
    fitting = [i for i in range(len(y)) if i % 3 != 2]
    curve = [i for i in range(len(y)) if i % 3 == 2]
    if len({labels[i] for i in curve}) < 2 or len({labels[i] for i in fitting}) < 2:
        fitting = curve = list(range(len(y)))
    rows = np.concatenate([documents[i][0] for i in fitting])
    mean, deviation = rows.mean(0), rows.std(0)
    mean[-1], deviation = 0.0, np.where(deviation < 1e-9, 1.0, deviation)
    chains, owner = [], []
    for i in fitting:
        f = (documents[i][0] - mean) / deviation
        for at in range(0, len(f), STRETCH):
            chains.append(f[at:at + STRETCH])
            owner.append((i, at))
    share = {1: 0.5 / max(sum(labels[i] for i in fitting), 1), 0: 0.5 / max(sum(1 - labels[i] for i in fitting), 1)}
    weights = [share[labels[i]] * len(c) / len(documents[i][0]) * len(fitting) for (i, _), c in zip(owner, chains, strict=True)]
    targets = [np.full(len(c), float(labels[i])) for (i, _), c in zip(owner, chains, strict=True)]
    w, t = _fit_chain(chains, targets, weights)
    for _ in range(2):
        worst = {}
        found = _batch_marginals([np.stack([np.zeros(len(c)), c @ w], axis=1) for c in chains], t)
        for (i, _at), p in zip(owner, found, strict=True):
            worst[i] = min(worst.get(i, 1.0), float(p.min()))
        targets = [np.ones(len(p)) if labels[i] else np.where(p <= worst[i] + 1e-9, 0.0, p) for (i, _), p in zip(owner, found, strict=True)]
        w, t = _fit_chain(chains, targets, weights)
    model = QualityModel(mean, deviation, w, t, 1.0, 0.0)
    z = np.array([_logit(s) for s in model.shares([documents[i] for i in curve])])
    model.slope, model.shift = _curve(z, y[curve])
    model.shift += _logit(good)
    return model


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a rising logistic curve, by Newton steps on labels weighted alike per class."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (y - p) * z).sum() - 0.1 * a, (weight * (y - p)).sum()])
        r = weight * p * (1 - p)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def _described(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        pairs = [document_features(t) for t in frame["text"]]
        yield pd.DataFrame({
            "doc_id": frame["doc_id"], "quality": frame["quality"],
            "features": [f.astype("<f4").tobytes() for f, _ in pairs], "lengths": [n.astype("<f4").tobytes() for _, n in pairs],
        })


def fit(documents: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Fit on at most ``per_label`` whole documents of each quality label outside the held-out fold.

    Rows whose label is null or not 0 or 1 teach nothing; of several labels of one document
    the lower counts. Tasks describe the sampled texts; only features reach the driver.
    """
    known = labels.where("quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    there = known.join(documents.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    counted = dict(there.groupBy("quality").count().collect())
    good = counted.get(1, 0) / max(sum(counted.values()), 1)
    chosen = sample_ids(there, "quality", per_label)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    pdf = rows.mapInPandas(_described, "doc_id long, quality int, features binary, lengths binary").toPandas().sort_values("doc_id")
    pdf = pdf.iloc[np.random.default_rng(1).permutation(len(pdf))]
    width = 3 * len(_FEATURES) + 3
    read = lambda b: np.frombuffer(b, dtype="<f4").astype(np.float64)
    docs = [(read(f).reshape(-1, width), read(n)) for f, n in zip(pdf["features"], pdf["lengths"], strict=True)]
    return train(docs, pdf["quality"].astype(int).tolist(), good)


def score_column(spark: SparkSession, model: QualityModel, text: Column | str) -> Column:
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # a few hundred numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = pickle.loads(shared.value)
        for batch in batches:
            yield pd.Series(known.scores(batch.tolist()), dtype="float64")

    return pandas_udf(run, "double")(text)


def score(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its text alone.

    A null or empty text is one blank line and is scored as such. Repeated rows give repeated
    results, no rows none. Other columns are ignored.
    """
    rows = documents.select("doc_id", held_out().alias("held_out"), score_column(documents.sparkSession, model, "text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    rows = documents.withColumn("__quality", score_column(documents.sparkSession, model, "text"))
    return rows.where(F.col("__quality") >= threshold).select(*documents.columns)
