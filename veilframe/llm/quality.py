"""Quality rules: base rules, and an isolation forest over rule statistics.

The forest is grown on labelled rows of good quality, at most ``max_labelled`` of them (a documented bound: those with the
lowest hash of the id). Each tree takes a subsample and splits its node's box at uniformly random places; the root's box spans
all labelled rows, so that a place where only bad rows lie is cut off after few splits; the subsample is large enough to hold the
rarer kinds of good rows, such as those with repeated lines. The mean path length gives the usual
anomaly score 2^(-E[h] / c). The threshold is calibrated on labelled rows that the trees have not seen, good and bad: of the
scores that reject at most ``max_good_rejected`` of the good rows, the one of best balanced accuracy.

Statistics use every whole text. There is no shuffle: one scan with the few labelled ids broadcast (a proven bound), then one
scan that scores. Results: a null or empty text has no words and fails the base rules; without labelled rows only the base
rules decide; of labelled rows that share an id the one of the least statistics is learned; repeated rows repeat their result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .common import SPACES, batch, ids_and_texts, in_slices, only, spark_schema

SYMBOLS = "#*$%&|<>"
WINDOW = 8
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ALNUM_SPACE = _UPPER + bytes(range(97, 123)) + _DIGITS + b" \t\n\x0b\x0c\r" + bytes(range(128, 256))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "dup_lines", "repeats", "word_length", "upper", "punctuation", "digits")


def repeated_words(ws: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` (a power of two) that occur twice or more in the text.

    Ranks of windows of 1, 2, 4, ... words are refined pair by pair, so equal ranks mean equal words.
    """
    if len(ws) <= width:
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in ws), dtype=np.int64, count=len(ws))
    if len(known) == len(ws):
        return 0
    span = 1
    while span < width:
        pair = rank[:-span] * (int(rank.max()) + 1) + rank[span:]
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(rank):
            return 0
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ws) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(STATS, FEATURES) of a whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    n = len(ws)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0), (0.0,) * len(FEATURES)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(ws)

    def share(deleted: bytes) -> int:
        return len(raw) - len(raw.translate(None, deleted))

    punctuation = len(raw.translate(None, _ALNUM_SPACE))
    features = (min(symbols / n, 4.0), dup / len(lines), repeats / n, min(chars / n, 20.0), share(_UPPER) / chars, min(punctuation / n, 4.0), min(share(_DIGITS) / chars, 1.0))
    return (n, chars, symbols, dup, repeats), features


def base_failed(stats: tuple[int, ...]) -> bool:
    return stats[0] < 20 or 100 * stats[4] > 30 * stats[0]


def c(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes, -1 at a leaf
    cut: np.ndarray
    length: np.ndarray  # path length at a leaf
    norm: float
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length):
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, 2 * at + 1 + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            total += length[at]
        return 2 ** (-total / len(self.feature) / self.norm)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """``x``: good rows; low, high: the root's box."""
    rng = np.random.default_rng(seed)
    psi = min(subsample, len(x))
    depth = max(1, int(np.ceil(np.log2(max(psi, 2)))))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    usable = np.flatnonzero(high > low)
    for t in range(trees):
        stack = [(0, 0, x[rng.choice(len(x), psi, replace=False)], low.copy(), high.copy())]
        while stack:
            node, d, rows, lo, hi = stack.pop()
            if d == depth or len(rows) <= 1 or not len(usable):
                length[t, node] = d + c(len(rows))
                continue
            f = int(rng.choice(usable))
            at = rng.uniform(lo[f], hi[f])
            feature[t, node], cut[t, node] = f, at
            right = rows[:, f] >= at
            lower, upper = hi.copy(), lo.copy()
            lower[f] = upper[f] = at
            stack += [(2 * node + 1, d + 1, rows[~right], lo, lower), (2 * node + 2, d + 1, rows[right], upper, hi)]
    return Forest(feature, cut, length, float(max(c(psi), 1.0)))


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, max_good_rejected: float) -> float:
    """The score of best balanced accuracy, rows above it being rejected, among those that reject at most that share of the good
    rows; of equal ones the highest. None is rejected without rows of both labels."""
    if not len(bad) or not len(good):
        return np.inf
    good, bad = np.sort(forest.scores(good)), np.sort(forest.scores(bad))
    at = np.unique(np.concatenate([good, bad]))
    rejected = len(good) - np.searchsorted(good, at, side="right")
    caught = len(bad) - np.searchsorted(bad, at, side="right")
    at, gain = at[::-1], (caught / len(bad) - rejected / len(good))[::-1]
    return float(at[np.argmax(np.where(rejected[::-1] <= max_good_rejected * len(good), gain, -np.inf))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, trees: int = 100, subsample: int = 2_048, max_good_rejected: float = 0.02, seed: int = 11) -> Forest | None:
    """A forest from labelled rows (``labels``: doc_id, quality), at most ``max_labelled`` of them; None without good rows."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(max_labelled)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("failed", pa.bool_()), ("features", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            found = [statistics(t) for t in b.column("text").to_pylist()]
            yield batch(out, doc_id=b.column("doc_id"), quality=b.column("quality"), failed=[base_failed(s) for s, _ in found], features=[list(f) for _, f in found])

    # of rows that share an id, the one of the least statistics
    judged = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, spark_schema(out)).where("NOT failed")
    rows = judged.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    x, good = np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), len(FEATURES)), rows["quality"].to_numpy() >= 1
    if good.sum() < 2:
        return None
    order = np.random.default_rng(seed).permutation(np.flatnonzero(good))
    seen, unseen = order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]
    forest = grow(x[seen], x.min(axis=0), x.max(axis=0), trees, subsample, seed)
    forest.threshold = calibrate(forest, x[unseen], x[~good], max_good_rejected)
    return forest


OUT = pa.schema([("doc_id", pa.int64()), *((s, pa.int64()) for s in STATS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("anomaly", pa.float64())])


def _judge(forest: Forest | None, texts: list[str | None]) -> tuple[list[tuple[int, ...]], list[bool], list[bool], list[float]]:
    only("quality", dict)
    found = [statistics(t) for t in texts]
    failed = [base_failed(s) for s, _ in found]
    x = np.array([f for _, f in found], dtype=float).reshape(len(found), len(FEATURES))
    scores = forest.scores(x) if forest is not None and len(x) else np.zeros(len(x))
    most = np.inf if forest is None else forest.threshold
    return [s for s, _ in found], failed, [bool(not f and s <= most) for f, s in zip(failed, scores)], scores.tolist()


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """Per row: doc_id, the statistics, base_failed, kept and the anomaly score."""

    def run(batches):
        for b in in_slices(batches, 2048):
            stats, failed, kept, scores = _judge(forest, b.column("text").to_pylist())
            yield batch(OUT, doc_id=b.column("doc_id"), base_failed=failed, kept=kept, anomaly=scores, **{s: [x[i] for x in stats] for i, s in enumerate(STATS)})

    return ids_and_texts(docs).mapInArrow(run, spark_schema(OUT))


def keep_good(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    @pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series(_judge(forest, [t if isinstance(t, str) else None for t in texts])[2], dtype=bool)

    return docs.where(kept(docs["text"].cast("string")))
