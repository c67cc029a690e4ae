"""Quality rules and an isolation forest over their statistics.

Every text is read once for its rule statistics. The forest is grown on the
statistics of a bounded sample of labelled rows: random splits isolate unusual
rows after few steps, so short paths mark anomalies. The score that separates
rejected from accepted rows is calibrated on the labels of the same sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Besides the contract's counts: what the forest looks at.
EXTRA = ("n_upper", "n_marks", "n_bars")
_STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)
#: Repeated lines and words are left to the base rule: clean texts have some.
FEATURES = ("word_length", "symbols", "upper", "marks", "bars")

_UPPER = np.array([chr(i).isupper() for i in range(0x250)])
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words)
    if n <= width:
        return 0
    codes: dict = {}
    ids = _mix(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, n) + np.uint64(1))
    m = n - width + 1
    window = np.zeros(m, np.uint64)
    for i in range(width):
        window += _mix(ids[i : i + m] * _MULTIPLIERS[i])
    _, where, count = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS and EXTRA for one text; null and blank: zeros."""
    if not text:
        return (0,) * (len(COUNTS) + len(EXTRA))
    words = text.encode().split()
    if not words:
        return (0,) * (len(COUNTS) + len(EXTRA))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            if line in seen:
                dup += 1
            seen.add(line)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = int(_UPPER[points[points < len(_UPPER)]].sum())
    return (
        len(words),
        len(text) - sum(text.count(c) for c in _SPACE),
        sum(text.count(c) for c in _SYMBOLS),
        dup,
        repeated_words(words),
        upper,
        text.count("!") + text.count("?"),
        text.count("|"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, EXTRA), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_statistics(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS) + len(EXTRA))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1]))],
                ["doc_id", *COUNTS, *EXTRA],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STATS)


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios of the counts, so that long documents look like short ones."""
    words = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_upper"] / chars,
            c["n_marks"] / words,
            c["n_bars"] / words,
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Isolation trees as flat arrays; a leaf has feature -1 and holds the path
    length that its rows get."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: int
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies."""
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] < self.value[t, at]
                at = np.where(inner, np.where(go_left, self.left[t, at], self.right[t, at]), at)
            total += self.value[t, at]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def _expected(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int = 200, rows: int = 256, seed: int = 17) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(rows, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2)))) + 2
    grown = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def build(ids: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, depth + _expected(len(ids)), 0, 0])
            low, high = x[ids].min(0), x[ids].max(0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(ids) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
                side = x[ids, f] < cut
                if side.any() and not side.all():
                    nodes[me] = [f, cut, build(ids[side], depth + 1), build(ids[~side], depth + 1)]
            return me

        build(rng.choice(len(x), size, replace=False), 0)
        grown.append(np.array(nodes))
    most = max(map(len, grown))
    table = np.zeros((trees, most, 4))
    table[:, :, 0] = -1
    for t, nodes in enumerate(grown):
        table[t, : len(nodes)] = nodes
    return Forest(
        table[:, :, 0].astype(np.int64), table[:, :, 1], table[:, :, 2].astype(np.int64), table[:, :, 3].astype(np.int64), limit + 1, _expected(size) or 1.0
    )


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def keep(self, x: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(x):
            return np.ones(len(x), bool)
        return self.forest.score(x) <= self.threshold


def fit(x: np.ndarray, good: np.ndarray, contamination: float = 0.04, strict: float = 20.0, seed: int = 17) -> Model:
    """Grow the forest on half of the accepted rows and so many rejected ones
    that these make up ``contamination``; on the other half take the threshold
    at which the share of rejected rows caught, less ``strict`` times the share
    of accepted rows lost, is largest. With labels of one kind only, every row
    is kept."""
    if not good.any() or good.all():
        return Model(None, math.inf)
    rng = np.random.default_rng(seed)
    fine, poor = rng.permutation(np.flatnonzero(good)), rng.permutation(np.flatnonzero(~good))
    half = (len(fine) + 1) // 2
    some = max(1, int(half * contamination))
    forest = grow_forest(x[np.concatenate([fine[:half], poor[:some]])], seed=seed)
    fine, poor = (fine[half:] if len(fine) > 1 else fine), (poor[some:] if len(poor) > some else poor)
    score = forest.score(x)
    order = np.sort(np.unique(score))
    cuts = np.concatenate([(order[1:] + order[:-1]) / 2, [order[-1]]])
    lost = 1 - np.searchsorted(np.sort(score[fine]), cuts, "right") / len(fine)
    caught = 1 - np.searchsorted(np.sort(score[poor]), cuts, "right") / len(poor)
    gain = caught - strict * lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return Model(forest, float(cuts[best[len(best) // 2]]))


def fit_on_labels(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Model:
    """Fit on at most ``max_rows`` labelled rows, the first by a hash of
    doc_id. Labels without a document, or null, are left out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    first = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # settled first: a collected top-k would send each partition's rows to the driver
    rows = settle(first, "fit-rows").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    c = {k: rows[k].to_numpy(np.int64) for k in COUNTS + EXTRA}
    able = ~base_failed(c) if len(rows) else np.zeros(0, bool)
    return fit(features(c)[able], rows["quality"].to_numpy()[able] == 1)


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) from ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS + EXTRA}
            failed = base_failed(c)
            kept = ~failed & model.keep(features(c))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(k) for k in COUNTS), pa.array(failed), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return stats.mapInArrow(run, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept), one row for each input row. Null, empty and blank
    texts have zero counts and fail the base rule; repeated rows are judged
    alike. Without usable labels only the base rule decides."""
    stats = settle(statistics(docs), "statistics")
    return judge(stats, fit_on_labels(stats, labels, max_rows))


def quality_filter(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep. The
    model is fitted as in ``quality_verdicts``, on at most ``max_rows`` labels;
    that bound lets the labels be broadcast."""
    some = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long"), "quality")
    some = settle(some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labels")
    known = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit_on_labels(statistics(known), some, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS) + len(EXTRA))
            c = {k: rows[:, i] for i, k in enumerate(COUNTS + EXTRA)}
            yield batch.filter(pa.array(~base_failed(c) & model.keep(features(c))))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_forest(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
