"""Fill-in-the-middle: texts cut at units into prefix, middle and suffix, marked and reordered.

The ``tokenizers`` library's ``Split`` finds the units (isolated matches of a pattern; nothing is
trained) and gives their ends in code points. The length of that array is the number of units,
and two entries of it are the ends of prefix and middle; all else are Spark expressions.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line with its end.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Columns that ``fill_in_middle`` adds.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@lru_cache(maxsize=8)
def _cutter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def unit_ends(pattern: str = LINES):
    """A function of a text column: where each unit ends, in code points; empty for an empty text."""

    @F.arrow_udf("array<int>")
    def ends(texts: pa.Array) -> pa.Array:
        cut = _cutter(pattern)
        return pa.array([[end for _, (_, end) in cut.pre_tokenize_str(t.as_py())] for t in texts], pa.list_(pa.int32()))

    return ends


def _draws(doc_id: F.Column, seed: int) -> list[F.Column]:
    """Four whole numbers that the seed and an id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, pattern: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and others) with ``n`` (units), ``form``, ``prefix_chars``,
    ``middle_chars`` (code points) and ``output``; a row per row.

    ``rate`` of 100 texts are cut, ``spm`` of 100 of those put the suffix first; which ones, and
    where, a hash of ``seed`` and ``doc_id`` says, so rows that repeat an id are cut by the same
    draws. A null text counts as an empty one and a null id as an empty one. Empty texts and those
    that hold a mark stay as they are (``plain``, without counts). A column of ``docs`` that is
    named like an added one gives way to it.
    """
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_text", text).withColumn("_ends", unit_ends(pattern)("_text"))
    first, second, third, fourth = _draws(F.col("_row.doc_id"), seed)
    n = F.size("_ends").cast("long")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("_text").contains(mark)
    plain = (F.col("_text") == "") | marked | (third % 100 >= rate)
    form = F.when(plain, "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    cuts = F.array_sort(F.array(first % (n + 1), second % (n + 1)))
    at = lambda i: F.when(cuts[i] == 0, F.lit(0)).otherwise(F.get("_ends", cuts[i].cast("int") - 1))
    placed = rows.select("*", n.alias("_n"), form.alias("_form"), at(0).alias("_a"), at(1).alias("_b"))
    piece = lambda start, size: F.substring(F.col("_text"), start, size)
    head, body, rest = piece(F.lit(1), F.col("_a")), piece(F.col("_a") + 1, F.col("_b") - F.col("_a")), piece(F.col("_b") + 1, F.length("_text"))
    output = (
        F.when(F.col("_form") == "plain", F.col("_text"))
        .when(F.col("_form") == "psm", F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), rest, F.lit(MIDDLE), body))
        .otherwise(F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), head, F.lit(MIDDLE), body))
    )
    cut = F.col("_form") != "plain"
    counts = [F.when(cut, F.col("_a").cast("long")).alias("prefix_chars"), F.when(cut, (F.col("_b") - F.col("_a")).cast("long")).alias("middle_chars")]
    return placed.select(*own, F.col("_n").alias("n"), F.col("_form").alias("form"), *counts, output.alias("output"))


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that an output and its form came from."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
