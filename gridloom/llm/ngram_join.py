"""Jaccard self-join of word shingles by PartEnum signatures.

Two sets of which the smaller has n members and whose Jaccard similarity is at least t differ
in at most ``n * (1 - t) / t`` members. Sets are put into bands of nearly equal size, each with
a bound k on that difference. The domain of shingle hashes is cut into n1 * n2 ranges in n1
groups; k differences leave some group with at most k2 of them, and of its n2 parts every
subset that leaves k2 out is enumerated: two similar sets agree in one of these subsets, so
they share a signature. Sets that share one are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import KEPT, frugal, released, written
from .graph import components

#: A band ends at this many times its start.
BAND = 1.3
#: Groups beyond those that k differences can spoil, as a share: a set that has fewer weak and
#: hot groups than that needs neither, as it still shares a good one with each similar set.
SPARE = 0.25
#: A signature of fewer shingles is weak; one that more sets share is hot.
WEAK, HOT = 2, 32
#: Up to this k a group is cut into three parts, of which each two make a signature; beyond it
#: groups aren't cut any further.
CUT_K = 40
#: Members that are compared with one centre in a task, and rows and columns of a comparison block.
STAR, BLOCK = 500, 1024
#: Word hashes and sets' ids that a worker remembers, and bytes of sets that it puts out at once.
WORDS_KNOWN, SETS_KNOWN, SET_BYTES = 150_000, 200_000, 4_000_000
#: Counters of a sketch.
COUNTERS = 512
#: Broadcast at most so many ids (16 bytes each); more are joined by a shuffle.
SMALL = 400_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of the words that a worker has met; forgotten when they are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KNOWN:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_KNOWN = _WordHashes()
KEPT[__name__] = _KNOWN.clear


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words make one
    shingle, none an empty set. A-Z count as a-z; words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    key = np.full(n, width, np.uint64)
    for k in range(width):
        key = (key * _M3) ^ each[k : k + n]
        key ^= key >> np.uint64(29)
    key = np.sort(_mix(key))
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def set_id(members: np.ndarray) -> int:
    """64 bits, signed, that stand for the whole set."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - 2**63


@dataclass(frozen=True)
class Similarity:
    """A Jaccard threshold of ``num / den`` in whole numbers."""

    num: int = 85
    den: int = 100
    width: int = 4

    def tolerance(self, size):
        """Most members in which a set of ``size`` and a similar one that isn't smaller differ."""
        return size * (self.den - self.num) // self.num

    def reaches(self, both: int, either: int) -> bool:
        return self.den * both >= self.num * either


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def need(self) -> int:
        """Groups in which two similar sets surely agree but for k2 parts."""
        return self.n1 - self.k // (self.k2 + 1)


@lru_cache
def bands(sim: Similarity) -> tuple[Band, ...]:
    """From the least size at which two different sets can be similar."""
    out: list[Band] = []
    low = -(-sim.num // (sim.den - sim.num))
    while low < 2**31:
        high = max(low, int(low * BAND))
        k = sim.tolerance(high)
        if k <= 3:
            n1, n2, k2 = 1, k + 3, k
        elif k <= CUT_K:
            n1, n2, k2 = math.ceil((k // 2 + 1) * (1 + SPARE)) + 2, 3, 1
        else:
            n1, n2, k2 = math.ceil((k + 1) * (1 + SPARE)) + 2, 1, 0
        out.append(Band(len(out), low, high, k, n1, n2, k2))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=256)
def _layout(band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts of the hash domain, subsets by part, and a salt for each signature."""
    parts = band.n1 * band.n2
    cuts = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    subsets = np.zeros((band.n2, math.comb(band.n2, band.k2)), np.uint64)
    for i, kept in enumerate(combinations(range(band.n2), band.n2 - band.k2)):
        subsets[list(kept), i] = 1
    salts = _mix((np.arange(band.n1 * subsets.shape[1], dtype=np.uint64) + np.uint64(band.number << 40)) * _M3).reshape(band.n1, -1)
    return cuts, subsets, salts


def homes(size: int, sim: Similarity) -> list[Band]:
    """The bands in which a set meets others: its own, and those below that hold a size to which
    it can be similar."""
    all_bands = bands(sim)
    if size < all_bands[0].low:
        return []
    own = next(b for b in all_bands if b.high >= size)
    least = -(-size * sim.num // sim.den)
    return [b for b in all_bands[: own.number + 1] if b.high >= least]


def signatures(members: np.ndarray, sim: Similarity) -> Iterator[tuple[np.ndarray, int]]:
    """For each home of the set its signatures and slot: the band's number and how many hot
    groups make the set need its hot signatures. Weak signatures are left out, or where too few
    groups were left, those of no shingle at all; of two similar sets the one that leaves out
    more still has a group that both agree in, and what it keeps there the other one keeps too."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(members ^ _M3))))
    for band in homes(len(members), sim):
        cuts, subsets, salts = _layout(band)
        ends = np.concatenate(([0], np.searchsorted(members, cuts), [len(members)]))
        part = (sums[ends[1:]] - sums[ends[:-1]]).reshape(band.n1, band.n2)
        count = np.diff(ends).reshape(band.n1, band.n2) @ subsets.astype(np.int64)
        order = _mix(np.arange(1, band.n2 + 1, dtype=np.uint64)) | np.uint64(1)
        found = _mix(((part * order) @ subsets) ^ salts)
        for least in range(WEAK, -1, -1):
            weak = count < least
            spare = band.need - int(weak.any(axis=1).sum())
            if spare > 0:
                break
        yield found[~weak], (band.number << 20) | max(0, spare)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    for value in batch.column(name).cast(pa.large_string()).cast(pa.large_binary()):
        yield value.as_py() or b""


def shingle_classes(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``cls`` (what stands for the set; null if it is empty) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_id(s) if len(s) else None) for s in (shingle_set(t, sim.width) for t in _texts(batch))]
            n, cls = zip(*sets, strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], names=["doc_id", "n_shingles", "cls"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, cls long")


def signature_rows(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``sig``, ``cls``, ``slot``: the signatures of each set that a task meets, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(s) for s in sigs]
            cls, slot = (np.repeat(np.array(x, kind), sizes) for x, kind in zip(zip(*owners, strict=True), (np.int64, np.int32), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(cls), pa.array(slot)], names=["sig", "cls", "slot"])

        for batch in batches:
            for text in _texts(batch):
                members = shingle_set(text, sim.width)
                cls = set_id(members)
                if not len(members) or cls in met:
                    continue
                if len(met) > SETS_KNOWN:
                    met.clear()
                met.add(cls)
                for found, slot in signatures(members, sim):
                    sigs.append(found)
                    owners.append((cls, slot))
                    held += len(found)
                if held > 100_000:
                    yield flush()
                    sigs, owners, held = [], [], 0
        if held:
            yield flush()

    return docs.where("doc_id is not null").select("text").mapInArrow(frugal(run), "sig long, cls long, slot int")


_FOUND = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("slot", pa.int32())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig and cls: a star (a: the least set, b: another, no sig) for each
    signature that few share, and the rows themselves (a, sig, slot) of hot ones. Holds one
    batch and the group that it broke off in."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    hot_sig = None

    def cut(rows: list[np.ndarray], last: bool) -> tuple[list[pa.RecordBatch], list[np.ndarray], int | None]:
        sig, cls, slot = rows
        if not len(sig):
            return [], rows, hot_sig
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])))
        sig, cls, slot = sig[new], cls[new], slot[new]
        starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(sig)])))
        hot = sizes > HOT
        if hot_sig is not None and sig[0] == hot_sig:
            hot[0] = True
        tail = 0
        keep_hot = None
        if not last:
            if hot[-1]:
                keep_hot = int(sig[-1])
            else:
                tail = int(sizes[-1])
        group = np.repeat(np.arange(len(sizes)), sizes)
        is_hot = hot[group]
        body = np.ones(len(sig), bool)
        if tail:
            body[-tail:] = False
        first = cls[starts][group]
        star = body & ~is_hot & (sizes[group] > 1) & (cls != first)
        out = []
        if star.any():
            pairs = np.unique(np.stack((first[star], cls[star]), axis=1), axis=0)
            n = len(pairs)
            out.append(pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int32())], schema=_FOUND))
        if is_hot.any():
            n = int(is_hot.sum())
            out.append(pa.RecordBatch.from_arrays([pa.array(sig[is_hot]), pa.array(cls[is_hot]), pa.nulls(n, pa.int64()), pa.array(slot[is_hot])], schema=_FOUND))
        at = len(sig) - tail
        return out, [sig[at:], cls[at:], slot[at:]], keep_hot

    for batch in batches:
        rows = [np.concatenate((r, batch.column(i).to_numpy(zero_copy_only=False))) for i, r in enumerate(rest)]
        out, rest, hot_sig = cut(rows, False)
        yield from out
    yield from cut(rest, True)[0]


def candidate_stars(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``a``, ``b``, ``n``: every two similar sets are connected through stars of sets that share a
    signature with the star's centre; nothing is compared yet. ``n`` says how often they do.

    A set that has fewer hot groups than it has groups to spare is left out of hot signatures:
    it shares another with each set that is similar to it.
    """
    sorted_rows = signature_rows(docs, sim).repartition("sig").sortWithinPartitions("sig", "cls")
    found = written(sorted_rows.mapInArrow(frugal(_shared), "sig long, a long, b long, slot int"), "partenum")
    hot = found.where("sig is not null").select("sig", F.col("a").alias("cls"), "slot").distinct()
    needy = hot.groupBy("cls", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("slot").bitwiseAND(F.lit((1 << 20) - 1))).drop("n")
    needed = written(hot.join(needy, ["cls", "slot"]).select("sig", "cls"), "partenum-hot")
    # one centre a signature: as few rows as there are hot signatures, so that the many members stay where they are
    centres = written(needed.groupBy("sig").agg(F.min("cls").alias("a")), "partenum-centres")
    stars = needed.join(F.broadcast(centres) if centres.count() <= SMALL else centres, "sig").where("a <> cls").select("a", F.col("cls").alias("b"))
    both = found.where("sig is null").select("a", "b").union(stars)
    return written(both.groupBy("a", "b").agg(F.count("*").alias("n")), "partenum-stars")


def star_sets(docs: DataFrame, classes: DataFrame, stars: DataFrame, width: int, held: list[str] | None = None) -> DataFrame:
    """``cls``, ``sketch``, ``data`` (the set) of the sets in ``stars`` (a, b), by one more pass over the
    texts; ``classes``: cls, doc_id (a document that has the set). The ids of these documents are
    broadcast where they are few, so that texts stay where they are. ``held``: as for ``written``."""
    members = stars.select(F.col("a").alias("cls")).union(stars.select("b")).distinct()
    ids = written(members.join(classes, "cls").select("doc_id", "cls"), "partenum-wanted")
    few = ids.count() <= SMALL

    def batch_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        cls, sketch, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(data, pa.binary())], names=["cls", "sketch", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, bytes, bytes]] = []
        size = 0
        for batch in batches:
            for text, cls in zip(_texts(batch), batch.column("cls").to_pylist(), strict=True):
                own = shingle_set(text, width)
                if len(own) and set_id(own) == cls:  # else another text under the same id
                    out.append((cls, _sketch(own), own.tobytes()))
                    size += own.nbytes + COUNTERS
                if size > SET_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)
        _KNOWN.clear()

    found = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id").mapInArrow(frugal(run), "cls long, sketch binary, data binary")
    return written(found, "partenum-sets", held)


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """``sets`` of the classes in ``ids`` (cls): where these are few, others stay where they are in a join with them."""
    ids = ids.distinct()
    return sets.join(F.broadcast(ids), "cls", "left_semi") if ids.count() <= SMALL else sets


def _compared(sets: DataFrame, pairs: DataFrame, column: str, similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Those of ``pairs`` (a, b: cls) of which ``similar`` holds for their ``column`` of ``sets``. A
    centre with many members is dealt to several tasks, with ``STAR`` members each."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("n"))
    members = pairs.join(many, "a").select(F.col("b").alias("cls"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), F.lit(1).alias("kind"))
    centres = many.select(F.col("a").alias("cls"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(0).alias("kind"))
    names = ["centre", "part", "kind", "cls", "data"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, at = b"", None
        for batch in batches:
            a, b = [], []
            for who, part, kind, cls, data in zip(*(batch.column(c).to_pylist() for c in names[:-1]), batch.column("data"), strict=True):
                if kind == 0:
                    centre, at = data.as_py(), (who, part)
                elif at == (who, part) and similar(centre, data.as_py()):
                    a.append(who)
                    b.append(cls)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = _only(sets, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")))
    sent = members.union(centres).join(sets.select("cls", F.col(column).alias("data")), "cls").select(*names)
    dealt = sent.repartition("centre", "part").sortWithinPartitions("centre", "part", "kind")
    # a repeated row gave its set again
    return written(dealt.mapInArrow(frugal(compare), "a long, b long").distinct(), "partenum-links")


def may_reach(sim: Similarity) -> Callable[[bytes, bytes], bool]:
    """Whether two sketches leave it open that their sets are similar: counts differ by no more
    than the sets do."""

    def test(a: bytes, b: bytes) -> bool:
        (n, m), (x, y) = _unpacked([a, b])
        return int(np.abs(x - y).sum(dtype=np.int64)) <= sim.tolerance(int(min(n, m)))

    return test


def does_reach(sim: Similarity) -> Callable[[bytes, bytes], bool]:
    def test(a: bytes, b: bytes) -> bool:
        least, most = sorted((len(a) // 8, len(b) // 8))
        if not sim.reaches(least, most):
            return False
        both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
        return sim.reaches(both, least + most - both)

    return test


def _sketch(members: np.ndarray) -> bytes:
    """The number of members, and members counted by hash range: the sum of two sketches' differences
    is at most the number of members in which the sets differ, also where counters are full."""
    counts = np.bincount((_mix(members ^ _M1) >> np.uint64(64 - 9)).astype(np.int64), minlength=COUNTERS)
    return len(members).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def _unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, 8 + COUNTERS)
    return rows[:, :8].copy().view(np.int64).ravel(), rows[:, 8:].astype(np.int16)


def _within_families(sets: DataFrame, families: DataFrame, linked: DataFrame, sim: Similarity, exact: bool) -> DataFrame:
    """``a``, ``b``: pairs that unite the parts that ``linked`` (cls, part) makes of the sets of each
    family (cls, family); others are parts of their own. Pairs: those that sketches can't rule out, or with ``exact`` those that are similar.

    Sets outside the largest part of their family are held against the rest, block by block; a
    block is one task's, whatever the size of the family. Within a block a pair is formed only
    if its sets are not united yet.
    """
    size = BLOCK // 4 if exact else BLOCK
    nodes = written(families.join(linked, "cls", "left").withColumn("part", F.coalesce("part", "cls")), "partenum-nodes")
    parts = nodes.groupBy("family", "part").agg(F.count("*").alias("n"))
    open_ = (
        parts.groupBy("family")
        .agg(F.sum("n").alias("total"), F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("family", F.col("top.part").alias("top"), F.ceil(F.col("total") / size).cast("int").alias("columns"), F.ceil((F.col("total") - F.col("top.n")) / size).cast("int").alias("rows"))
    )
    where = nodes.join(open_, "family")
    place = lambda n: F.pmod(F.xxhash64("cls", F.lit(n)), F.col(n)).cast("int").alias(n[:-1])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
    right = where.select("cls", "family", "part", F.lit(1).alias("side"), place("columns"), every("rows"))
    left = where.where("part <> top").select("cls", "family", "part", F.lit(0).alias("side"), every("columns"), place("rows")).select(*right.columns)
    similar = does_reach(sim)

    def block(rows: pa.Table) -> pa.Table:
        names, united = np.unique(rows.column("part").to_numpy(), return_inverse=True)
        sides = [pc.equal(rows.column("side"), s) for s in (0, 1)]
        (own, n, sketch), (other, other_n, others) = ((united[np.asarray(s)], *_unpacked(rows.column("sketch").filter(s).to_pylist())) for s in sides)
        cls, other_cls = (rows.column("cls").filter(s).to_pylist() for s in sides)
        data, other_data = (rows.column("data").filter(s) if exact else None for s in sides)
        a, b = [], []
        for i in range(len(cls)):
            least = np.minimum(n[i], other_n)
            able = np.flatnonzero((other != own[i]) & (np.abs(n[i] - other_n) <= sim.tolerance(least)))
            if not len(able):
                continue
            apart = np.abs(others[able] - sketch[i]).sum(axis=1, dtype=np.int64)
            for j in able[apart <= sim.tolerance(least[able])].tolist():
                if other[j] != own[i] and (not exact or similar(data[i].as_py(), other_data[j].as_py())):
                    a.append(cls[i])
                    b.append(other_cls[j])
                    gone = other[j]
                    other[other == gone] = own[i]
                    own[own == gone] = own[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    once = _only(sets, where.select("cls")).groupBy("cls").agg(*(F.first(c).alias(c) for c in (("sketch", "data") if exact else ("sketch",))))
    held = left.union(right).join(once, "cls")
    return written(held.groupBy("family", "column", "row").applyInArrow(block, "a long, b long"), "partenum-united")


def _in_stars(stars: DataFrame) -> DataFrame:
    """``cls``, ``family``: the sets of each star, its centre included."""
    return stars.select(F.col("b").alias("cls"), F.col("a").alias("family")).union(stars.select("a", "a").distinct())


def similar_pairs(sets: DataFrame, stars: DataFrame, sim: Similarity) -> DataFrame:
    """``a``, ``b``: similar pairs that connect all sets that similar ones connect.

    Of the candidate stars (a, b, n) each set is compared with the centre with which it has most
    signatures in common. What stays apart in a star is held together by sketches, and the
    families that these leave are compared in full, but for sets that are united. Similar sets are
    in one star at least, while stars that hang together by chance grow with the table.
    """
    first = stars.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b")
    links = _compared(sets, _compared(sets, first, "sketch", may_reach(sim)), "data", does_reach(sim))
    named = lambda edges, name: components(edges).select(F.col("node").alias("cls"), F.col("component").alias(name))
    linked = named(links, "part")
    open_ = _within_families(sets, _in_stars(stars), linked, sim, False)
    if open_.isEmpty():
        return links
    return links.union(_within_families(sets, named(links.union(open_), "family"), linked, sim, True))


def similar_documents(docs: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``: the least doc_id
    that links reach, where documents link if their shingle sets have a Jaccard similarity of at
    least ``sim``.

    Documents with equal sets are one class and are linked. Null and empty texts and texts
    without a word have an empty set and stand alone. Rows with a null doc_id get their count
    and a null component. Rows that share a doc_id are one document: its parts join through
    the id only where their own sets link. Extra columns are ignored; an empty table gives an
    empty result. Sets are identified by 64-bit hashes.
    """
    return _in_components(docs, sim or Similarity()).select("doc_id", "n_shingles", "component_id")


def _in_components(docs: DataFrame, sim: Similarity) -> DataFrame:
    """``similar_documents`` with ``cls`` and ``component``, the least class of a row's component; both
    are null for empty sets."""
    rows = written(shingle_classes(docs, sim), "shingles")
    classes = written(rows.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "shingle-classes")
    stars = candidate_stars(docs, sim)
    held: list[str] = []
    links = similar_pairs(star_sets(docs, classes, stars, sim.width, held), stars, sim)
    released(docs.sparkSession, held)
    named = classes.join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "component").select("cls", "component", "component_id")
    return rows.join(found, "cls", "left").select("doc_id", "n_shingles", "cls", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """One row of each component of ``docs``: one with its least doc_id (where several rows have this
    id, the first by text). Rows that share a doc_id are judged each by its own set. Rows with a null
    doc_id or an empty set stay."""
    sim = sim or Similarity()
    found = written(_in_components(docs, sim), "partenum-components")
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    any_repeated = not repeated.isEmpty()
    if any_repeated:
        repeated = written(repeated, "repeated-ids")
        others = others.union(repeated).distinct()
    kept = docs.join(F.broadcast(others) if others.count() <= SMALL else others, "doc_id", "left_anti")
    if not any_repeated:
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            sets = [shingle_set(t.as_py() or b"", sim.width) for t in rows.field("text").cast(pa.large_string()).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([rows, pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["_row", "cls"])

    rows = docs.join(repeated, "doc_id", "left_semi").select(F.struct("*").alias("_row"))
    rows = written(rows.mapInArrow(frugal(run), StructType([*rows.schema, StructField("cls", LongType())])), "repeated-rows")
    least = found.where("doc_id = component_id and cls is not null").select("doc_id", "cls", "component").distinct()
    first = rows.withColumn("doc_id", F.col("_row.doc_id")).join(least, ["doc_id", "cls"]).groupBy("component").agg(F.min_by("_row", F.col("_row.text")).alias("_row"))
    for part in (rows.where("cls is null"), first):
        kept = kept.unionByName(part.select("_row.*"))
    return kept
