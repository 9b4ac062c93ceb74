"""Repeated passages by a logarithmic family of suffix arrays.

The arrays hold sampled suffixes: those that start at an anchor, the position of the least
fingerprint within some window of ``length`` bytes. Two equal windows have the same anchor at
the same place, so a passage of ``length`` bytes that occurs twice is found at an anchor that
both occurrences have. An array is in the order of the names of its suffixes' first bytes, a
64-bit fingerprint, so that suffixes that begin alike lie together.

A new batch of documents gets an array of its own. It is merge-scanned against itself and every
existing level for suffixes that begin alike; then levels of equal size are merged, so that a
corpus of n batches has at most log2(n) + 1 levels. The family is a folder that outlives a run.
What the scans found is verified on the text around the anchors: every window there is compared
by a 64-bit hash of all its bytes, with the others of its anchor's name. At 30 GB that are about
10^10 windows with up to some thousands each, so one false match has odds of about 10^-6.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, fresh_path, frugal, quoted, released, shuffles_end, written

#: Bytes that are hashed at once; longer texts are cut so that each window lies in one piece.
PIECE = 1 << 18
_POSITION = np.uint64((1 << 22) - 1)
#: Documents whose windows at one anchor are compared in a task; more are dealt to several.
GROUP = 1000
#: Most windows in a segment, bytes of segments that are compared at once, texts that a worker remembers.
SEGMENT, COMPARED, TEXTS_KNOWN = 1 << 14, 1 << 20, 200_000
#: A key with more than this share of all suffixes is hot: so there are at most as many hot keys as 1 / HOT.
HOT = 0.001
#: Spans that may be broadcast (about 60 bytes each).
SMALL = 200_000
BATCHES = 4
#: Windows of dealt groups of which a task holds the hashes at once.
SHARE = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(PIECE, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Hashes:
    """Hashes of all substrings of at most ``PIECE`` bytes that have a given length."""

    def __init__(self, data: bytes):
        n = len(data)
        grams = np.ndarray((n,), "<u4", data + bytes(4), strides=(1,)).astype(np.uint64)
        powers, self.inverse = _powers()
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(grams + np.uint64(1)) * powers[:n])))

    def of(self, at: np.ndarray | slice, length: int) -> np.ndarray:
        """Of the ``length`` bytes from each position; a slice starts at 0."""
        if isinstance(at, slice):
            stop = at.stop
            return _mix((self.sums[length - 3 : length - 3 + stop] - self.sums[:stop]) * self.inverse[:stop])
        return _mix((self.sums[at + length - 3] - self.sums[at]) * self.inverse[at])


def gram_bytes(length: int) -> int:
    """Bytes of a suffix that its fingerprint covers."""
    return max(4, length // 5)


def sampled_suffixes(data: bytes, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: text number, fingerprint, first window and number
    of windows of each anchor. A run of windows that share their anchor is one row."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gram, n = gram_bytes(length), len(data)
    if n < length or not (sizes >= length).any():
        return none
    hashes = Hashes(data)
    prints = hashes.of(slice(0, n - gram + 1), gram)
    least = (prints & ~_POSITION) | np.arange(len(prints), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    ends = np.repeat(np.cumsum(sizes), sizes)[: n - length + 1]
    at = np.flatnonzero(ends - np.arange(n - length + 1) >= length)
    anchor = (least[at] & _POSITION).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(at)])))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    text = np.searchsorted(begin, at[first], side="right") - 1
    return text, prints[anchor[first]].view(np.int64), at[first] - begin[text], count


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, list[int], list[int]]]:
    """Bytes of about ``PIECE``, sizes of the texts in it, their numbers and where they start."""
    held: list[bytes] = []
    owners: list[int] = []
    starts: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE - length + 1):
            part = text[at : at + PIECE]
            if held and size + len(part) > PIECE:
                yield b"".join(held), np.array([len(x) for x in held]), owners, starts
                held, owners, starts, size = [], [], [], 0
            held.append(part)
            owners.append(i)
            starts.append(at)
            size += len(part)
    if held:
        yield b"".join(held), np.array([len(x) for x in held]), owners, starts


def text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def suffix_entries(docs: DataFrame, length: int) -> DataFrame:
    """``key`` (fingerprint), ``h`` (which text), ``at`` (first window), ``n`` (windows), ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                keys = batch.column("h").to_pylist()
                texts = [b"" if h in seen else t for h, t in zip(keys, _bytes(batch.column("text")), strict=True)]
                if len(seen) > TEXTS_KNOWN:
                    seen.clear()
                seen.update(keys)
                for data, sizes, numbers, starts in _pieces(texts, length):
                    text, key, at, n = sampled_suffixes(data, sizes, length)
                    if len(text):
                        who = pa.array(keys, pa.binary()).take(pa.array(np.array(numbers)[text]))
                        yield pa.RecordBatch.from_arrays([pa.array(key), who, pa.array(at + np.array(starts)[text]), pa.array(n)], names=["key", "h", "at", "n"])

    rows = docs.where(F.octet_length("text") >= length).select(text_key().alias("h"), "text").mapInArrow(frugal(run), "key long, h binary, at long, n long")
    return rows.withColumn("batch", F.pmod(F.xxhash64("h"), F.lit(BATCHES)).cast("int"))


class SuffixFamily:
    """Levels of suffix arrays in a folder, each a table in the order of its keys; a level of size
    2^i holds 2^i batches. A folder that holds a family already is taken up where it was left. Arrays
    that were merged into another go when the family has noted it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "suffix-family")
        self.version = 0
        self.levels: list[tuple[int, str]] = []
        rows = self._known() if path else []
        if rows:
            self.version = max(r["version"] for r in rows)
            self.levels = [(r["size"], r["place"]) for r in sorted(rows, key=lambda r: -r["size"]) if r["version"] == self.version]

    def _known(self) -> list[Row]:
        try:
            return self.spark.read.parquet(f"{self.path}/levels").collect()  # a few rows a batch
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch (key, h, at, n): ``key`` and ``n`` (how often) of its suffixes that begin
        like another one of the batch or of a level."""
        self.version += 1
        # a name of its own, as a lost run may have left one of this version behind
        place = f"array-{self.version}-{uuid.uuid4().hex}"
        array = self._write(entries, place, distinct=True)
        # counts by key are formed before the shuffle, so that a common key is no more than others
        own = array.groupBy("key").agg(F.count("*").alias("n"))
        if self.levels:
            before = self.entries().groupBy("key").agg(F.count("*").alias("m"))
            own = own.join(before, "key", "left").select("key", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        found = written(own.where("n > 1"), "suffix-hits")
        size, merged = 1, [place]
        while self.levels and self.levels[-1][0] == size:
            merged.append(self.levels.pop()[1])
            size *= 2
        if len(merged) > 1:
            for level in merged[1:]:
                array = array.union(self._level(level))
            place = f"merged-{self.version}-{uuid.uuid4().hex}"
            self._write(array, place)
        self.levels.append((size, place))
        rows = self.spark.createDataFrame([(self.version, n, at) for n, at in self.levels], "version long, size long, place string")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/levels")
        released(self.spark, [f"{self.path}/{old}" for old in merged if old != place])
        return found

    def entries(self) -> DataFrame:
        out = self._level(self.levels[0][1])
        for _, place in self.levels[1:]:
            out = out.union(self._level(place))
        return out

    def _level(self, place: str) -> DataFrame:
        return self.spark.read.schema("key long, h binary, at long, n long").parquet(f"{self.path}/{place}")

    def _write(self, entries: DataFrame, place: str, distinct: bool = False) -> DataFrame:
        """In ranges of key, text and position, so that a key that many suffixes have is in several.
        Equal rows are in one range, so that ``distinct`` ones take no shuffle of their own."""
        ranges = entries.repartitionByRange("key", "h", "at")
        with shuffles_end(self.spark):
            (ranges.distinct() if distinct else ranges).sortWithinPartitions("key", "h", "at").write.parquet(f"{self.path}/{place}")
        return self._level(place)


def _segments(docs: DataFrame, anchors: DataFrame, length: int, held: list[str]) -> DataFrame:
    """The text that the windows of ``anchors`` (h, key, at, n, parts) cover; windows that follow
    each other under one key are one segment."""
    lists = written(anchors.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "n", "key", "parts"))).alias("anchors")), "suffix-lists", held)
    long = docs.where(F.octet_length("text") >= length).select(text_key().alias("h"), "text")
    if lists.count() <= SMALL:  # texts without a hit stay where they are
        long = long.join(F.broadcast(lists.select("h")), "h", "left_semi")
    # one row a text, so that a text with many copies is not many rows of one task
    texts = long.groupBy("h").agg(F.first("text").alias("text"))
    joined = texts.join(lists.hint("shuffle_hash"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for h, text, found in zip(batch.column("h"), batch.column("text"), batch.column("anchors"), strict=True):
                h, text = h.as_py(), text.as_py().encode()
                own: list[dict] = []
                for a in found.as_py():
                    if own and own[-1]["key"] == a["key"] and own[-1]["at"] + own[-1]["n"] == a["at"] and own[-1]["n"] + a["n"] <= SEGMENT:
                        own[-1]["n"] += a["n"]
                    else:
                        own.append(a)
                part = xxhash.xxh3_64_intdigest(h)
                for a in own:
                    data = text[a["at"] : a["at"] + a["n"] + length - 1]
                    rows.append(a | {"h": h, "data": data, "part": part % a["parts"]})
                    size += len(data)
                if size > COMPARED:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("h", pa.binary()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    return joined.mapInArrow(frugal(run), "key long, part int, parts int, h binary, at long, n long, data binary")


def repeated_windows(data: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments with so many windows: each window's segment, hash, and whether it has an equal."""
    owner = np.repeat(np.arange(len(data)), counts)
    values, at = [], 0
    while at < len(data):
        stop, size = at, 0
        while stop < len(data) and (stop == at or size + len(data[stop]) <= PIECE):
            size += len(data[stop])
            stop += 1
        n = counts[at:stop]
        begin = np.concatenate(([0], np.cumsum([len(x) for x in data[at:stop]])))[:-1]
        where = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        values.append(Hashes(b"".join(data[at:stop])).of(where, length))
        at = stop
    value = np.concatenate(values)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return owner, value, np.zeros(len(value), bool)
    return owner, value, twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value


def repeated_spans(docs: DataFrame, length: int, batches: int = BATCHES) -> DataFrame:
    """``h``, ``spans`` (array of start, stop in bytes, disjoint and ascending): what strings of
    ``length`` bytes that also start elsewhere cover in each distinct text. Copies of a whole
    text count as one occurrence here."""
    spark = docs.sparkSession
    held: list[str] = []
    entries = written(suffix_entries(docs, length), "suffix-entries", held)
    family, hits = SuffixFamily(spark), None
    for b in range(batches):
        found = family.add(entries.where(F.col("batch") == b).drop("batch"))
        hits = found if hits is None else hits.union(found)
    released(spark, held)
    # the last count of a key is that of all its suffixes
    hits = written(hits.groupBy("key").agg(F.max("n").alias("n")).withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int")), "suffix-keys")
    total = hits.agg(F.sum("n")).first()[0] or 0
    hot, rest = F.col("n") > HOT * total, F.col("n") <= HOT * total
    marked = family.entries().join(F.broadcast(hits.where(hot).select("key", "parts")), "key", "left")
    common = marked.where("parts is not null")
    shared = marked.where("parts is null").drop("parts").join(hits.where(rest).select("key", "parts"), "key")
    anchors = written(common.unionByName(shared).select("h", "key", "at", "n", "parts"), "suffix-shared", held)
    released(spark, [family.path])  # of this run alone

    def verify(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of key and part, as many groups at once as ``COMPARED`` bytes."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches_:
            if not batch.num_rows:
                continue
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
            sizes = np.add.reduceat(pc.binary_length(batch.column("data")).to_numpy(), starts)
            if held and (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (key[0], part[0]) and size > COMPARED:
                yield from compared(held)
                held, size = [], 0
            begin = 0
            for at, n in zip(starts.tolist(), sizes, strict=True):
                if at and size > COMPARED:
                    yield from compared([*held, batch.slice(begin, at - begin)])
                    held, size, begin = [], 0, at
                size += int(n)
            held.append(batch.slice(begin))
        if held:
            yield from compared(held)

    def compared(batches_: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches_, schema=segment)
        hs, at, n, parts = table.column("h").to_pylist(), *(table.column(c).to_numpy() for c in ("at", "n", "parts"))
        data = table.column("data").to_pylist()
        hs = pa.array(hs, pa.binary())
        owner, value, twice = repeated_windows(data, n, length)
        place = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.flatnonzero(twice)
        if len(hit):
            new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
            first = hit[new]
            last = hit[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1]))]
            none = [pa.nulls(len(first), f.type) for f in list(out)[3:]]
            yield pa.RecordBatch.from_arrays([hs.take(pa.array(owner[first])), pa.array(place[first]), pa.array(place[last] + length), *none], schema=out)
        # windows of a group that was dealt to several tasks go on in blocks, one for each share of all hashes
        dealt = parts[owner] > 1
        lone = np.flatnonzero(dealt & ~twice)
        known = np.unique(value[dealt & twice])
        if not len(lone) and not len(known):
            return
        order = np.argsort(value[lone] % np.uint64(shares), kind="stable")
        lone = lone[order]
        cuts = np.searchsorted(value[lone] % np.uint64(shares), np.arange(shares + 1, dtype=np.uint64))
        rows = []
        for share in range(shares):
            own, others = lone[cuts[share] : cuts[share + 1]], known[known % np.uint64(shares) == share]
            if len(own) or len(others):
                texts, which = np.unique(owner[own], return_inverse=True)
                rows.append({"share": share, "texts": b"".join(hs.take(pa.array(texts)).to_pylist()), "which": which.astype(np.int32).tobytes(), "places": place[own].tobytes(), "values": value[own].tobytes(), "known": others.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, schema=out)

    def match(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of blocks in the order of their share: the windows whose hash another block has too."""
        held: list[dict] = []
        for batch in batches_:
            for row in batch.to_pylist():
                if held and held[-1]["share"] != row["share"]:
                    yield from matched(held)
                    held = []
                held.append(row)
        if held:
            yield from matched(held)

    def matched(blocks: list[dict]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(b["values"], np.uint64) for b in blocks]
        ordered = np.sort(np.concatenate(own))
        again = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], np.concatenate([np.frombuffer(b["known"], np.uint64) for b in blocks]))
        if not len(again):
            return
        for b, value in zip(blocks, own, strict=True):
            hit = np.flatnonzero(again[np.minimum(np.searchsorted(again, value), len(again) - 1)] == value)
            if len(hit):
                texts = [b["texts"][i : i + 16] for i in range(0, len(b["texts"]), 16)]
                which, place = np.frombuffer(b["which"], np.int32)[hit], np.frombuffer(b["places"], np.int64)[hit]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).take(pa.array(which)), pa.array(place), pa.array(place + length)], names=["h", "start", "stop"])

    segment = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("h", pa.binary()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    out = pa.schema([("h", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.int32()), *((c, pa.binary()) for c in ("texts", "which", "places", "values", "known"))])
    windows = anchors.where("parts > 1").agg(F.sum("n")).first()[0] or 0
    shares = max(1, -(-windows // SHARE))
    found_at: list[str] = []
    found = written(_segments(docs, anchors, length, held).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(frugal(verify), "h binary, start long, stop long, share int, texts binary, which binary, places binary, values binary, known binary"), "suffix-found", found_at)
    released(spark, held)
    blocks = found.where("share is not null").select("share", "texts", "which", "places", "values", "known")
    more = blocks.repartition("share").sortWithinPartitions("share").mapInArrow(frugal(match), "h binary, start long, stop long")
    spans = found.where("share is null").select("h", "start", "stop").union(more)

    def merge(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            merged = []
            for start, stop in zip(batch.column("start").to_pylist(), batch.column("stop").to_pylist(), strict=True):
                order = np.argsort(start, kind="stable")
                start, reach = np.array(start)[order], np.maximum.accumulate(np.array(stop)[order])
                new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                ends = reach[np.concatenate((new[1:] - 1, [len(reach) - 1]))]
                merged.append([{"start": a, "stop": b} for a, b in zip(start[new].tolist(), ends.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["h", "spans"])

    lists = spans.groupBy("h").agg(F.collect_list(F.struct("start", "stop")).alias("all")).select("h", F.col("all.start").alias("start"), F.col("all.stop").alias("stop"))
    covered = written(lists.mapInArrow(frugal(merge), "h binary, spans array<struct<start:bigint,stop:bigint>>"), "suffix-spans")
    released(spark, found_at)
    return covered


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    """``_row`` (a row of ``docs``) and ``_spans``; every byte of a text that has a copy is in one."""
    spans = repeated_spans(docs, length)
    copied = docs.where(F.octet_length("text") >= length).groupBy(text_key().alias("h"), F.octet_length("text").cast("long").alias("size")).agg(F.count("*").alias("copies")).where("copies > 1")
    whole = copied.select("h", "copies", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))).alias("whole"))
    both = written(spans.join(whole, "h", "full").select(F.col("h").alias("_h"), F.coalesce("whole", "spans").alias("_spans"), "copies"), "suffix-removed")
    rows = docs.select(F.struct("*").alias("_row"), text_key().alias("_h"))
    few = both.agg(F.sum(F.size("_spans"))).first()[0] or 0
    if few <= SMALL:
        return rows.join(F.broadcast(both), "_h", "left").select("_row", "_spans")
    # texts with so many copies are few, and their copies stay where they are
    common = F.coalesce("copies", F.lit(0)) > HOT * docs.count()
    marked = rows.join(F.broadcast(both.where(common).withColumnRenamed("_spans", "_own")), "_h", "left")
    return marked.where("copies is not null").select("_row", F.col("_own").alias("_spans")).union(marked.where("copies is null").select("_row", "_h").join(both.where(~common), "_h", "left").select("_row", "_spans"))


def _outward(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """Moved to where no character is cut."""
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    while stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop += 1
    return start, stop


def without_repeats(docs: DataFrame, length: int = 400, characters: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed`` and ``n_spans``, which
    replace columns of these names.

    Each whole text counts as UTF-8 bytes, null as none, and matches never cross documents. A
    byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the
    table, the same text included; all occurrences go. Rows that repeat a text are copies of it,
    also under one doc_id. Texts shorter than ``length`` stay whole. Extra columns stay; an empty
    table gives an empty result. With ``characters`` a character that a span cuts goes whole, so
    that ``kept`` is valid UTF-8.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    joined = _with_spans(docs, length)
    names = docs.columns
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                kept, removed, counts, sizes = [], [], [], []
                row = batch.column("_row").flatten()
                for text, spans in zip(_bytes(row[text_at]), batch.column("_spans").to_pylist(), strict=True):
                    left, at = [], 0
                    for s in spans or ():
                        start, stop = _outward(text, s["start"], s["stop"]) if characters else (s["start"], s["stop"])
                        left.append(text[at:start])
                        at = stop
                    left.append(text[at:])
                    kept.append(b"".join(left))
                    sizes.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                    counts.append(len(spans or ()))
                yield pa.RecordBatch.from_arrays([*row, pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = columns_of(docs) + "kept binary, n_bytes long, n_removed long, n_spans long"
    return joined.mapInArrow(frugal(cut), schema)


def documents_without_repeats(docs: DataFrame, length: int) -> DataFrame:
    """``docs`` with what remains of each text and its n_chars; rows of whose text only white
    space remains go, unless they had no more to begin with."""
    left = without_repeats(docs, length, characters=True)
    text = F.when(F.col("n_spans") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    worded = F.col("kept").cast("string").rlike(r"[^\x20\x09-\x0D]")
    return left.where((F.col("n_spans") == 0) | worded).withColumn("text", text).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*map(quoted, docs.columns))
