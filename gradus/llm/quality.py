"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are fitted with numpy on a bounded sample of labelled rows, flattened into arrays, and
applied to batches of documents by stepping all rows down a level at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import small

FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "common_marks", "other_marks", "high_bytes", "control",
    "byte_entropy", "word_bytes", "longest_word", "distinct_words", "top_word", "top_ten_words", "single_byte_words", "marked_words",
    "shouted_words", "distinct_lines", "line_bytes", "stops_per_word", "commas_per_word", "distinct_pairs", "repeats",
)

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[*b".,;:'\"?!-()"]] = 5
_CLASS[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7
_CLASS[[*range(9), *range(14, 32), 127]] = 8
_MARKS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


def statistics(text: str | None) -> list[float]:
    """The numbers of FEATURES for one text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=9) / n
    share = by_byte[by_byte > 0] / n
    words = raw.split()
    nw = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(10)
    lines = raw.split(b"\n")
    lengths = [len(w) for w in counts]
    singles = sum(c for w, c in counts.items() if len(w) == 1)
    marked = sum(c for w, c in counts.items() if w[-1] in _MARKS)
    shouted = sum(c for w, c in counts.items() if w.isupper())
    pairs = len(set(zip(words, words[1:], strict=False)))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *by_class[1:9].tolist(),
        float(-(share * np.log2(share)).sum()), n / nw, float(max(lengths, default=0)), len(counts) / nw, (top[0][1] if top else 0) / nw,
        sum(c for _, c in top) / nw, singles / nw, marked / nw, shouted / nw, len(set(lines)) / len(lines), n / len(lines),
        float(by_byte[46]) / nw, float(by_byte[44]) / nw, pairs / max(1, nw - 1), again / nw,
    ]


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.low[at], self.high[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, ridge: float = 2.0, least: float = 1.0) -> Trees:
    """Gradient boosting on logistic loss; splits are searched in histograms of each feature.

    No rows: every score is 0.5. A single label: every score is near it.
    """
    n = len(y)
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, x.shape[1]), int)
    feature, cut, low, high, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        cut.append(0.0)
        low.append(len(value))
        high.append(len(value))
        value.append(v)
        return len(value) - 1

    raw = np.full(n, base)
    for _ in range(rounds if n else 0):
        chance = 1 / (1 + np.exp(-raw))
        g, h = chance - y, np.maximum(chance * (1 - chance), 1e-9)
        step = np.zeros(n)

        def grow(rows: np.ndarray, left: int, g=g, h=h, step=step) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            v = -rate * gs / (hs + ridge)
            at = leaf(v)
            step[rows] = v
            best = (1e-6, -1, 0)
            if left and len(rows) > 1:
                for f, c in enumerate(cuts):
                    if len(c):
                        b = binned[rows, f]
                        gl = np.bincount(b, weights=g[rows], minlength=len(c) + 1)[:-1].cumsum()
                        hl = np.bincount(b, weights=h[rows], minlength=len(c) + 1)[:-1].cumsum()
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least) | (hs - hl < least)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
            if best[1] >= 0:
                _, f, k = best
                below = binned[rows, f] <= k
                feature[at], cut[at] = f, float(cuts[f][k])
                low[at] = grow(rows[below], left - 1)
                high[at] = grow(rows[~below], left - 1)
            return at

        roots.append(grow(np.arange(n), depth))
        raw += step
    return Trees(base, np.array(roots, dtype=np.int64), *(np.array(a, dtype=t) for a, t in ((feature, np.int64), (cut, float), (low, np.int64), (high, np.int64), (value, float))), depth)


def held_out(doc_id):
    """Rows that no label may be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _measured(batches):
    for batch in small(batches):
        x = [statistics(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **kwargs) -> Trees:
    """Trees fitted on at most max_rows labelled documents outside of the held-out fifth.

    If there are more, those with the smallest md5 of doc_id are used: the bound keeps what
    the driver gets, and the table that is broadcast, at a fixed size. Null labels are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "label").limit(max_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
    found = found.select("doc_id", "label", "text").mapInArrow(_measured, "doc_id long, label double, x array<double>")
    # Repeated doc_ids must not let the sample grow.
    got = sorted(found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect())
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r.label for r in got]), **kwargs)


def score(docs: DataFrame, trees: Trees, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs with the score of each whole text; no shuffle.

    Null texts score like empty ones. Repeated rows each get their score.
    """
    held = docs.sparkSession.sparkContext.broadcast(trees)
    picked = docs.select(*columns, F.col("text").alias("__text"))
    kinds = [f for f in picked.schema.fields[:-1]]

    def run(batches):
        for batch in small(batches):
            x = np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(x))], names=[*names, "score"])

    names = [f.name for f in kinds]
    return picked.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "score double"]))


def select(docs: DataFrame, trees: Trees, threshold: float) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches, at=docs.columns.index("text")):
        for batch in small(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(held.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
