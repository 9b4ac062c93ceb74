"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text holds all its substrings. A text is
parsed against it from left to right into the longest phrases that occur in the labelled
text; the fewer phrases it needs, the nearer the text. The phrase count times the bits of a
pointer into the reference, per byte, is the cross-parsing entropy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of reference text per language, documents they are drawn from, and most bytes of one.
REFERENCE_BYTES, REFERENCE_DOCS, EXCERPT_CHARS = 32_768, 64, 600
#: Most languages that are learned, those with most documents: each is an automaton in every worker.
LANGUAGES = 512
#: Bytes of all texts that are parsed in step before the next ones are laid out.
BLOCK = 512
#: Texts of more bytes wait for others of their kind, so many at a time, of so many bytes together.
LONG, LONG_TEXTS, LONG_BYTES = 8192, 256, 1 << 24


def _folded(text: str) -> bytes:
    return text.lower().encode()


#: ASCII that isn't a letter is one class, as what separates words; other bytes stay as they are.
_CLASS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``data``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class CrossParser:
    """Counts phrases against one reference text for many blocks at a time."""

    def __init__(self, reference: bytes):
        codes = _CLASS[np.frombuffer(reference, np.uint8)]
        used = np.unique(codes)
        self.codes = np.zeros(256, np.uint8)  # 0: a byte that the reference lacks
        self.codes[used] = np.arange(1, len(used) + 1)
        self.codes = self.codes[_CLASS]
        moves = suffix_automaton(codes.tobytes())
        self.width = len(used) + 1
        place = {int(b): i + 1 for i, b in enumerate(used)}
        # an entry is twice the next state, plus 1 where a phrase ends before this byte
        start = np.ones(self.width, np.int32)
        for c, to in moves[0].items():
            start[place[c]] = 2 * to + 1
        table = np.repeat(start[None, :], len(moves), axis=0)
        for state, out in enumerate(moves):
            for c, to in out.items():
                table[state, place[c]] = 2 * to
        self.table = table.ravel()
        self.bits = math.log2(max(2, len(reference)))

    def advance(self, columns: np.ndarray, sizes: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """columns: a row per step and a column per text, texts in descending size; ``state`` and
        ``count`` (phrases so far) of each text are carried on."""
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        for i, n in enumerate(active.tolist()):
            to = self.table.take(state[:n] * self.width + self.codes[columns[i, :n]])
            count[:n] += to & 1
            state[:n] = to >> 1


def cross_entropies(texts: list[bytes], parsers: list[CrossParser]) -> np.ndarray:
    """Bits per byte of each text against each parser; all texts run in step, each as a whole."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    data = np.frombuffer(b"".join(texts[i] for i in order) + bytes(BLOCK), np.uint8)
    states, counts = np.zeros((len(parsers), len(texts)), np.int64), np.ones((len(parsers), len(texts)), np.int64)
    for at in range(0, int(sizes[0]) if len(sizes) else 0, BLOCK):
        n = int(np.searchsorted(-sizes, -at, side="left"))
        columns = np.ascontiguousarray(data[(base[:n] + at)[:, None] + np.arange(BLOCK)[None, :]].T)
        for k, parser in enumerate(parsers):
            parser.advance(columns, np.minimum(sizes[:n] - at, BLOCK), states[k, :n], counts[k, :n])
    bits = counts.T * np.array([p.bits for p in parsers]) / np.maximum(sizes, 1)[:, None]
    bits[sizes == 0] = 0
    out = np.empty_like(bits)
    out[order] = bits
    return out


_PARSERS: dict[tuple[bytes, ...], list[CrossParser]] = {}


def _parsers(references: tuple[bytes, ...]) -> list[CrossParser]:
    """Built once in each Python worker."""
    if references not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[references] = [CrossParser(r) for r in references]
    return _PARSERS[references]


def is_learning_row() -> F.Column:
    """True where the crc32 of the id as text isn't divisible by 5; a null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(True))


def reference_texts(docs: DataFrame) -> dict[str, bytes]:
    """At most ``REFERENCE_BYTES`` of labelled text per language (of the ``LANGUAGES`` with most
    documents): ``EXCERPT_CHARS`` characters of each of about ``REFERENCE_DOCS`` documents. Which ones,
    and from where in them, a hash of id and text says; rows that repeat both count once. This
    bounded sample is all that the driver sees of the texts."""
    hashed = F.xxhash64("doc_id", "text")
    known = docs.where(is_learning_row() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", hashed.alias("hash"))
    sizes = known.groupBy("lang").agg(F.countDistinct("hash").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in sizes.collect()}
    if not counts:
        return {}
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1_000_000, math.ceil(2e6 * REFERENCE_DOCS / n)))])
    rank, turn = F.pmod("hash", F.lit(1_000_000)), F.shiftright("hash", 20)
    start = F.pmod(turn, F.greatest(F.length("text") - EXCERPT_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = known.where(rank < limit[F.col("lang")]).select("lang", rank.alias("rank"), F.substring("text", start, F.lit(EXCERPT_CHARS)).alias("part")).distinct()
    rows = rows.orderBy("rank", "part").limit(8 * REFERENCE_DOCS * len(counts)).collect()
    out: dict[str, bytes] = {}
    for r in rows:
        out[r["lang"]] = (out.get(r["lang"], b"") + b" " + _folded(r["part"]))[:REFERENCE_BYTES]
    return dict(sorted(out.items()))


def identify(docs: DataFrame, references: dict[str, bytes]) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (how far the second language lies behind, 0 to 1)
    for every row, from its text alone.

    Texts of any length are parsed whole; long ones wait for others, so rows change their order.
    Null texts and texts without a letter are ``und`` with score 0, as all are without
    references. Ties go to the language that comes first by code point.
    """
    langs, texts = list(references), tuple(references.values())

    def judged(ids: pa.Array, data: list[bytes], said: np.ndarray) -> pa.RecordBatch:
        bits = cross_entropies(data, _parsers(texts))
        ordered = np.sort(bits, axis=1)
        best = np.argmin(bits, axis=1)
        second = ordered[:, 1] if len(langs) > 1 else ordered[:, 0] * 2
        score = np.clip(1 - ordered[:, 0] / np.maximum(second, 1e-12), 0, 1)
        named = [langs[b] if s else "und" for b, s in zip(best.tolist(), said.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(named, pa.string()), pa.array(np.where(said, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, list[bytes], np.ndarray]] = []

        def together() -> pa.RecordBatch:
            ids, data, said = zip(*held, strict=True)
            held.clear()
            return judged(pa.concat_arrays(ids), [t for x in data for t in x], np.concatenate(said))

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data = [_folded(t or "") for t in part.column("text").to_pylist()]
                said = np.asarray(part.column("lettered").to_numpy(zero_copy_only=False), bool)
                long = np.array([len(t) > LONG for t in data], bool)
                if long.any():
                    rows = np.flatnonzero(long)
                    held.append((part.column("doc_id").take(pa.array(rows)), [data[i] for i in rows], said[rows]))
                if not long.all():
                    rows = np.flatnonzero(~long)
                    yield judged(part.column("doc_id").take(pa.array(rows)), [data[i] for i in rows], said[rows])
                if sum(len(x[1]) for x in held) >= LONG_TEXTS or sum(len(t) for x in held for t in x[1]) >= LONG_BYTES:
                    yield together()
        if held:
            yield together()

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if not langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and identify all: adds ``held_out``.

    ``lang`` is read only to learn. Repeated rows are each predicted; an empty table gives an
    empty result.
    """
    return identify(docs, reference_texts(docs)).select("doc_id", (~is_learning_row()).alias("held_out"), "lang_pred", "score")
