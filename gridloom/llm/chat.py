"""Chat formatting with a grammar that can be parsed back (DataFrame functions only).

Grammar::

    conversation := turn*
    turn         := "<s>" content "[INST] " content " [/INST]</s>"
    content      := any text without "<s>", "</s>", "[INST]" or "[/INST]"

The first content is the role, the second the text. A control string has ``<`` or
``[`` only as its first character, so none can arise across a boundary between
template and content. Content that the parser would not give back unchanged is
escaped by one more backslash after the first character of every (already escaped
or plain) control string; the parser takes one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, TEXT_END = "<s>", "[INST] ", " [/INST]</s>"
_CONTROL = r"</?s>|\[/?INST\]"
_TURN = r"(?s)<s>(.*?)\[INST\] (.*?) \[/INST\]</s>"


def escape(content: Column) -> Column:
    """One backslash more in each control string of ``content``."""
    return F.regexp_replace(content, r"([<\[])(\\*)(/?s>|/?INST\])", r"$1\\$2$3")


def unescape(content: Column) -> Column:
    return F.regexp_replace(content, r"([<\[])\\(\\*)(/?s>|/?INST\])", "$1$2$3")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), text, F.lit(TEXT_END))


def parse_turns(df: DataFrame, formatted: str, out: str, loss_role: str = "assistant") -> DataFrame:
    """Add ``out``, the ``array<struct<role, text, loss>>`` of a rendered conversation.

    Null if the string isn't a sentence of the grammar: if turns don't cover it
    from end to end, or if a content holds a control string.
    """
    frame = len(OPEN + ROLE_END + TEXT_END)
    shown = F.struct(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("role"), F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("text"))
    taken = lambda part: F.aggregate(F.col("_shown." + part), F.lit(0), lambda n, t: n + F.length(t))
    clean = lambda part: ~F.exists(F.col("_shown." + part), lambda t: t.rlike(_CONTROL))
    plain = lambda part: F.transform(F.col("_shown." + part), unescape).alias(part)
    sentence = (taken("role") + taken("text") + frame * F.size("_shown.role") == F.length(formatted)) & clean("role") & clean("text")
    return (
        df.withColumn("_shown", shown)
        .withColumn("_plain", F.when(sentence, F.arrays_zip(plain("role"), plain("text"))))
        .withColumn(out, F.transform("_plain", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == loss_role).alias("loss"))))
        .drop("_shown", "_plain")
    )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``turns`` (what went
    in, in order) and ``spans`` (per turn: role, start and stop of the shown text in
    ``formatted`` in code points, and whether it is under the loss mask).

    Each turn is first shown as it is, parsed back and compared; if it doesn't come
    back identical its role and text are escaped and the comparison is repeated. One
    escape always suffices (see the module's grammar); the comparison of the whole
    conversation raises if it ever did not.

    Turns are ordered by ``turn`` (null first), then role, then text, so that ties and
    repeated rows have one result; repeated rows stay. Null role or text counts as
    empty. Null ``conv_id`` is one conversation. Extra columns are ignored; an empty
    table gives an empty one. A conversation is one string and so one row.
    """
    shown = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("plain", render_turn(F.col("role"), F.col("text")))
        .transform(parse_turns, "plain", "back", loss_role)
        .withColumn("same", F.coalesce((F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text")), F.lit(False)))
        .withColumn("shown_role", F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"))))
        .withColumn("shown_text", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
        .withColumn("piece", render_turn(F.col("shown_role"), F.col("shown_text")))
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = shown.select(
        "conv_id",
        F.row_number().over(order).alias("i"),
        "role",
        "text",
        "piece",
        F.length("shown_text").alias("n"),
        F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )
    stop = lambda t: t["end"] - len(TEXT_END)
    whole = (
        placed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "piece", "n", "end"))).alias("all"))
        .select(
            "conv_id",
            F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
            F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
            F.transform("all", lambda t: F.struct(t["role"].alias("role"), (stop(t) - t["n"]).alias("start"), stop(t).alias("stop"), (t["role"] == loss_role).alias("loss"))).alias("spans"),
        )
    )
    return parse_turns(whole, "formatted", "parsed", loss_role).select(
        "conv_id",
        "formatted",
        "turns",
        "spans",
        F.when(F.coalesce(F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("turns"), F.lit(False)), F.col("parsed"))
        .otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
        .alias("parsed"),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser reads out of ``formatted``."""
    turns = F.col("parsed")
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
