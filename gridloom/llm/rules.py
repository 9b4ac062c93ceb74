"""Quality rules: word statistics of whole texts and an isolation forest on them.

``rule_statistics`` counts, ``fit_forest`` grows random-split trees on a bounded sample
of the statistics, ``calibrate`` chooses the threshold from all labelled rows of
both classes, and ``quality_rules`` puts them together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import frugal, written

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

#: Counts that the mapper adds to a row, all long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_other", "n_lines", "n_distinct_words")
WINDOW = 5


def _byte_class(members) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


#: A code point is counted by its first byte: any that isn't 10xxxxxx.
_WORD_CHAR = _byte_class(b for b in range(256) if b not in _SPACES and not 0x80 <= b < 0xC0)
_SYMBOL = _byte_class(_SYMBOLS)
_UPPER = _byte_class(range(65, 91))
_OTHER = _byte_class(b for b in range(33, 128) if not chr(b).isalnum())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    found = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(found)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, n_dup_lines, n_repeat_words, n_lines, n_distinct_words of UTF-8 bytes."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's counts go beside its first column, which is ``text`` or a struct that has it."""
    for batch in batches:
        # a slice at a time, so that the working arrays stay small
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            own = part.column("text") if "text" in part.schema.names else part.column(0).field("text")
            texts = pa.array(own.fill_null(""), pa.large_string()).cast(pa.large_binary())
            texts = pa.concat_arrays([texts])
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            held = memoryview(raw)[offsets[0] : offsets[-1]] if raw is not None else memoryview(b"")
            offsets = offsets - offsets[0]
            data = np.frombuffer(held, np.uint8)
            n = [text_counts(bytes(held[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            words, dups, repeats, lines, distinct = (np.array(x, np.int64) for x in zip(*n, strict=True))
            columns = {
                "n_words": words,
                "word_chars": _sums(_WORD_CHAR[data], offsets),
                "n_symbols": _sums(_SYMBOL[data], offsets),
                "n_dup_lines": dups,
                "n_repeat_words": repeats,
                "n_upper": _sums(_UPPER[data], offsets),
                "n_other": _sums(_OTHER[data], offsets),
                "n_lines": lines,
                "n_distinct_words": distinct,
            }
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(columns[c]) for c in COUNTS)], names=[part.schema.names[0], *COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every whole text; a row per row of ``docs``.

    A null text counts as an empty one: all counts are 0. Rows may repeat.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal(_count_batches), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(a: str, b: str) -> F.Column:
    return (F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))).cast("double")


#: What the forest splits on.
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "other_share", "line_words")


def features() -> list[F.Column]:
    """Ratios, so that long and short texts compare; each is defined for empty texts."""
    return [
        _share("word_chars", "n_words").alias("word_length"),
        _share("n_symbols", "word_chars").alias("symbol_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"),
        _share("n_repeat_words", "n_words").alias("repeat_share"),
        _share("n_upper", "word_chars").alias("upper_share"),
        _share("n_other", "word_chars").alias("other_share"),
        F.log1p(_share("n_words", "n_lines")).alias("line_words"),
    ]


def _counted_features(n: dict[str, np.ndarray]) -> np.ndarray:
    """``features`` of counts that a task holds, a row for each text."""
    share = lambda a, b: n[a] / np.maximum(n[b], 1)
    pairs = (("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "word_chars"), ("n_other", "word_chars"))
    line_words = [math.log1p(x) for x in share("n_words", "n_lines").tolist()]
    return np.column_stack([*(share(a, b) for a, b in pairs), line_words])


@dataclass
class Forest:
    """Trees as arrays: a node's feature, cut, children (a leaf's are itself) and path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1 by the mean path length; 0.5 and less is usual."""
        if not len(self.roots) or self.size < 2:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / _mean_path(self.size))


def _mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points in a binary search tree."""
    if n < 2:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow_forest(rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Isolation trees, each on ``sample`` of the rows, split at random to the usual depth."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(rows))
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    nodes: list[list[float]] = []

    def grow(x: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, level + _mean_path(len(x))])
        low, high = x.min(axis=0), x.max(axis=0)
        open_to = np.flatnonzero(high > low)
        if level < depth and len(x) > 1 and len(open_to):
            f = int(rng.choice(open_to))
            cut = float(rng.uniform(low[f], high[f]))
            below = x[:, f] < cut
            nodes[me][:2] = [f, cut]
            nodes[me][2] = grow(x[below], level + 1) if below.any() else me
            nodes[me][3] = grow(x[~below], level + 1) if (~below).any() else me
        return me

    roots = [grow(rows[rng.choice(len(rows), sample, replace=False)], 0) for _ in range(trees if sample else 0)]
    feature, cut, left, right, path = zip(*nodes, strict=True) if nodes else ((), (), (), (), ())
    return Forest(np.array(feature, int), np.array(cut, float), np.array(left, int), np.array(right, int), np.array(path, float), np.array(roots, int), depth + 1, sample)


def fit_forest(stats: DataFrame, trees: int = 128, sample: int = 256, fit_rows: int = 20_000, seed: int = 7) -> Forest:
    """Fit on about ``fit_rows`` rows of ``stats`` that pass the base rules, twice as many at most,
    chosen by a hash of their id: the sample is the same on every run and doesn't grow with the table."""
    good = stats.where(~base_failed())
    n = good.count()
    keep = int(min(1.0, fit_rows / max(n, 1)) * 1_000_000)
    some = good.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < keep)
    # rows that repeat an id have one hash and could be many
    rows = some.orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), *COUNTS).limit(2 * fit_rows).select(*features()).toPandas().to_numpy(float).reshape(-1, len(FEATURES))
    rows = rows[np.lexsort(rows.T)]  # whatever order the rows came in
    return grow_forest(rows, trees, sample, seed)


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``score``; the forest has a fixed number of nodes and goes with the task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(forest.score(x))], names=[*kept, "score"])

    kept = stats.columns
    schema = StructType([*stats.schema, StructField("score", DoubleType())])
    return stats.select("*", *features()).mapInArrow(frugal(score), schema)


#: Steps into which scores are counted for the threshold.
STEPS = 2000


def calibrate(scored: DataFrame, labels: DataFrame, loss: float = 0.001) -> float:
    """The threshold of least balanced error, the mean of the shares of good rows (quality 1)
    rejected and of bad rows (quality 0) kept, from histograms of all labelled rows that pass
    the base rules; of equal ones the highest. An id with both labels counts in both.

    Without bad rows it is the least score at which at most ``loss`` of the good rows would be
    rejected. 2.0, which no score reaches, without good rows.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_d"), F.col("quality").alias("_q")).distinct()
    rows = scored.where(~base_failed()).join(known, F.col("doc_id") == F.col("_d"))
    step = F.floor(F.col("score") * STEPS).cast("int").alias("step")
    counts = np.zeros((2, STEPS + 2), np.int64)
    for r in rows.groupBy("_q", step).count().collect():
        counts[r["_q"], r["step"]] = r["count"]
    # rows of each step and over, which a threshold at the step rejects
    bad, good = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    if not good[0]:
        return 2.0
    if not bad[0]:
        return int(np.flatnonzero(good <= loss * good[0])[0]) / STEPS
    error = good * bad[0] + (bad[0] - bad) * good[0]
    return int(np.flatnonzero(error == error.min())[-1]) / STEPS


def _judge(docs: DataFrame, labels: DataFrame, loss: float) -> tuple[DataFrame, Forest, float]:
    stats = written(rule_statistics(docs), "rule-stats")
    forest = fit_forest(stats)
    return stats, forest, calibrate(with_scores(stats, forest), labels, loss)


def quality_rules(docs: DataFrame, labels: DataFrame, loss: float = 0.001) -> DataFrame:
    """``rule_statistics`` with ``base_failed``, ``score`` and ``kept``.

    A document is kept if it passes the base rules (10 words or more, at most a fifth of them
    in repeated windows) and its isolation score is below the threshold that both classes of
    ``labels`` (doc_id, quality) set (``calibrate``); unlabelled and null qualities don't count. Every row gets a verdict,
    also repeated ones; null and empty texts fail the base rules. Empty tables give empty
    results, and without good labels the base rules alone decide.
    """
    stats, forest, threshold = _judge(docs, labels, loss)
    return with_scores(stats, forest).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))


def good_documents(docs: DataFrame, labels: DataFrame, loss: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps. The counts are taken again beside whole
    rows, which costs less than a shuffle of the texts to join the verdicts, and judged by the
    Python worker that took them: a second one a task would stay beside those of later stages."""
    _, forest, threshold = _judge(docs, labels, loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counted in _count_batches(batches):
            n = {c: counted.column(c).to_numpy() for c in COUNTS}
            failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
            good = ~failed & (forest.score(_counted_features(n)) < threshold)
            yield pa.RecordBatch.from_arrays([counted.column(0).filter(pa.array(good))], names=["_row"])

    rows = docs.select(F.struct("*").alias("_row"))
    return rows.mapInArrow(frugal(run), rows.schema).select("_row.*")
