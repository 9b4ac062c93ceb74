"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _groups, read_ranks

_MADE: dict[tuple, object] = {}


def _encoding(tokens: list[bytes], pattern: str):
    """One tokenizer for each Python worker."""
    import tiktoken

    key = (len(tokens), pattern)
    if key not in _MADE:
        _MADE[key] = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return _MADE[key]


def encoded_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every whole text under the ranks in ``path``; null has 0."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value, pattern)
        for batch in batches:
            for a, b in _groups(pc.binary_length(batch.column("text")).fill_null(0).to_pylist(), 4_000_000):
                part = batch.slice(a, b - a)
                n = [len(encoding.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens``, ``n_docs``: a row per length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents and tokens in the texts of
    at least this length (``docs_from``, ``tokens_from``), the total if each text is cut to the
    limit (``truncated_tokens``), and the share of documents that fit (``share_within``), which
    answers quantiles: the q-quantile is the least length whose share reaches q.

    Limits between two rows are answered by ``truncated_total``. The window without a key runs
    over distinct lengths, of which there are at most as many as tokens in the longest text.
    """
    up = Window.partitionBy(F.lit(1)).orderBy("n_tokens")
    whole = Window.partitionBy(F.lit(1))
    tokens = F.col("n_tokens") * F.col("n_docs")
    return (
        histogram.withColumn("below_docs", F.sum("n_docs").over(up) - F.col("n_docs"))
        .withColumn("below_tokens", F.sum(tokens).over(up) - tokens)
        .withColumn("docs", F.sum("n_docs").over(whole))
        .withColumn("tokens", F.sum(tokens).over(whole))
        .select(
            "n_tokens",
            "n_docs",
            (F.col("docs") - F.col("below_docs")).alias("docs_from"),
            (F.col("tokens") - F.col("below_tokens")).alias("tokens_from"),
            (F.col("below_tokens") + F.col("n_tokens") * (F.col("docs") - F.col("below_docs"))).alias("truncated_tokens"),
            ((F.col("below_docs") + F.col("n_docs")).cast("double") / F.col("docs")).alias("share_within"),
        )
    )


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context``, ``n_over``, ``truncated_tokens``, ``total_tokens`` for any limits, from the histogram alone."""
    each = histogram.withColumn("context", F.explode(F.array(*[F.lit(int(x)) for x in limits])))
    return each.groupBy("context").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("n_over"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("truncated_tokens"),
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"),
    )


def quantile(limits: DataFrame, q: float) -> int | None:
    """The least length within which a share ``q`` of the documents lies."""
    return limits.where(F.col("share_within") >= q).agg(F.min("n_tokens")).first()[0]
