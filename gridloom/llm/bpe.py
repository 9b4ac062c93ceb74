"""Byte-level BPE by DuckDB recursive queries inside each partition.

A text is cut into pretokens. The distinct ones of a batch become token-position rows; a
recursive query joins neighbours with the merge table and contracts the leftmost pair of
least rank of each word until none is left. Decoding joins ids with the vocabulary and
aggregates their bytes in order.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, columns_of, frugal

#: Pieces whose ids a worker remembers; then it forgets those that it has not met since it had
#: half as many.
REMEMBERED = 300_000
#: Bits of a byte's position in its word; words of up to 2^14 bytes go through the recursive query.
#: It writes a word's rows again for each merge, so its time grows with the square of the length:
#: 4.8 s for a random word of 10,000 bytes, and minutes from 100,000. Longer words are contracted
#: by the same rule with a heap.
PLACE_BITS = 20
LONG_WORD = 1 << 14
#: Bytes of distinct words that go into one recursive query, and ids that one query decodes.
QUERY_BYTES, QUERY_IDS = 350_000, 250_000

#: A row is a token at ``place`` (word * 2^20 + position of its first byte). Rows lie in the order
#: of ``place``, so the next row of the same word is the neighbour; ``error`` guards that order.
#: Words without a pair to contract are put out once, as done, and don't go into the next step.
_ENCODE = """
WITH RECURSIVE state(place, token, done) AS (
  SELECT place, token, false FROM start
  UNION ALL
  (WITH near AS (
    SELECT place, token, place >> 20 AS word, lag(place, 1, -1) OVER () AS before,
           lead(place) OVER () AS next, lead(token) OVER () AS after
    FROM state WHERE NOT done
  ), pairs AS MATERIALIZED (
    SELECT n.place, n.word, n.token, n.before, m.merged::BIGINT * 1048576 + (n.place & 1048575) AS found
    FROM (SELECT place, word, token, before,
                 CASE WHEN next <= place THEN error('rows out of order')::INT
                      WHEN (next >> 20) = word THEN after END AS after FROM near) n
    LEFT JOIN merges m ON m.l = n.token AND m.r = n.after
  ), least AS (
    SELECT word, min(found) AS best FROM pairs WHERE found IS NOT NULL GROUP BY word
  )
  SELECT p.place, CASE WHEN (p.place & 1048575) = (b.best & 1048575) THEN (b.best >> 20)::INT ELSE p.token END, b.best IS NULL
  FROM pairs p LEFT JOIN least b ON b.word = p.word
  WHERE b.best IS NULL OR p.before <> (p.word << 20) + (b.best & 1048575))
)
SELECT place, token FROM state WHERE done ORDER BY place
"""

#: Pieces are held with a character of the same number for each byte.
_DECODE = """
SELECT text, string_agg(piece, '') AS piece
FROM (SELECT * FROM ids JOIN vocabulary USING (id) ORDER BY pos) GROUP BY text
"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        ranked = {int(r): base64.b64decode(t) for t, r in (x.split() for x in lines if x.strip())}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


class DuckBpe:
    """An encoder and decoder with the merge table in an own DuckDB connection."""

    def __init__(self, tokens: list[bytes], pattern: str, remembered: int = REMEMBERED, query_bytes: int = QUERY_BYTES):
        self.remembered, self.query_bytes = remembered, query_bytes
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = array("i")
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                if t[:k] in self.rank and t[k:] in self.rank:
                    pairs.extend((self.rank[t[:k]], self.rank[t[k:]], i))
        left, right, merged = np.frombuffer(pairs, np.int32).reshape(-1, 3).T.copy()
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "100MB"})
        merges = pa.table({"l": left, "r": right, "merged": merged})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": np.arange(len(tokens), dtype=np.int32), "piece": [t.decode("latin-1") for t in tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word on its own, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        rows, size = [], 0
        for i, w in enumerate(words):
            if w in self.rank:
                out[i] = self.rank[w].to_bytes(4, "little")
            elif len(w) > LONG_WORD:
                out[i] = np.array(self._contract(w), "<u4").tobytes()
            else:
                rows.append(i)
                size += len(w)
                if size >= self.query_bytes:
                    self._query(words, rows, out)
                    rows, size = [], 0
        if rows:
            self._query(words, rows, out)
        return out

    def _query(self, words: list[bytes], rows: list[int], out: list[bytes]) -> None:
        sizes = np.array([len(words[i]) for i in rows])
        word = np.repeat(np.arange(len(rows)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        place = (word << PLACE_BITS) + np.arange(len(word)) - first[word]
        token = self.byte_rank[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
        self.db.register("start", pa.table({"place": place, "token": token}))
        got = self.db.execute(_ENCODE).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(got["token"]).astype("<u4")
        ends = np.cumsum(np.bincount(np.asarray(got["place"]) >> PLACE_BITS, minlength=len(rows)))
        data, begin = ids.tobytes(), 0
        for i, end in zip(rows, ends.tolist(), strict=True):
            out[i] = data[4 * begin : 4 * end]
            begin = end

    def _contract(self, word: bytes) -> list[int]:
        """The leftmost pair of least rank, again and again, with a heap of pairs."""
        ids = self.byte_rank[np.frombuffer(word, np.uint8)].tolist()
        tokens, rank, n = self.tokens, self.rank, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (r := rank.get(tokens[ids[i]] + tokens[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _learn(self, keys: list[str]) -> None:
        """Remember the ids of pieces, named by their keys, by their distinct pretokens."""
        cut = [self.pattern.findall(k[:-1] if k[-1:] == " " else " " + k) for k in keys]
        words = list({w: None for c in cut for w in c})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        for k, c in zip(keys, cut, strict=True):
            self.known[k] = b"".join([ids[w] for w in c])

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each of ``texts`` (strings, null: none).

        A pretoken never reaches over a space that a character other than white space follows,
        and never depends on what lies beyond one. So texts are cut there and the distinct
        pieces, many of which come again, are encoded once.
        """
        keys, ends = piece_keys(texts)
        coded = keys.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [k for k in distinct if k not in known]
        known.update({k: older[k] for k in missing if k in older})
        new = [k for k in missing if k not in older]
        if new:
            self._learn(new)
        of_piece = [known[k] for k in distinct]
        return _joined(of_piece, coded.indices.to_numpy(), ends)

    def decode_batch(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each text from its packed ids; unknown ids raise."""
        sizes = np.array([len(p) // 4 for p in packed])
        text = np.repeat(np.arange(len(packed), dtype=np.int32), sizes)
        ids = np.frombuffer(b"".join(packed), "<u4")
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise ValueError("an id is not in the vocabulary")
        out: list[list[bytes]] = [[] for _ in packed]
        for at in range(0, len(ids), QUERY_IDS):
            some = slice(at, at + QUERY_IDS)
            self.db.register("ids", pa.table({"text": text[some], "pos": np.arange(at, at + len(ids[some])), "id": ids[some].astype(np.int32)}))
            got = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids")
            for i, piece in zip(got.column("text").to_pylist(), got.column("piece").to_pylist(), strict=True):
                out[i].append(piece.encode("latin-1"))
        return [b"".join(x) for x in out]


def _joined(parts: list[bytes], index: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """``parts`` in the order of ``index``, put together up to each of ``ends``."""
    out, begin = [], 0
    for end in ends.tolist():
        out.append(b"".join([parts[i] for i in index[begin:end].tolist()]))
        begin = end
    return out


def piece_keys(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys of the pieces of all texts, and where each text's end. A key without a space at its
    end stands for a space and the key, another for all but that space."""
    texts = texts.cast(pa.large_string()).fill_null("")
    uneven = pc.match_substring_regex(texts, _SPACES).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(uneven), pa.scalar("", pa.large_string()), texts)
    lists = pc.split_pattern(plain, " ")
    stops = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
    parts = lists.flatten()
    first = np.zeros(len(parts), bool)
    first[stops - np.diff(np.concatenate(([0], stops)))] = True
    keys = pc.if_else(pa.array(first), pc.binary_join_element_wise(parts, *(pa.scalar(x, pa.large_string()) for x in ("", " "))), parts)
    if not uneven.any():
        return keys, stops
    chunks, ends, total, begin = [], [], 0, 0
    for i, (odd, stop) in enumerate(zip(uneven.tolist(), stops.tolist(), strict=True)):
        if odd:
            own = pa.array([p[1:] if p[:1] == " " and " " not in p[1:] else p + " " for p in pieces(texts[i].as_py())], pa.large_string())
        else:
            own = keys.slice(begin, stop - begin)
        chunks.append(own)
        total += len(own)
        ends.append(total)
        begin = stop
    return pa.concat_arrays(chunks), np.array(ends)


_SPACE_RUN = re.compile(r" \s")
#: The same for Arrow: white space of one byte, then that beyond ASCII.
_SPACES = r" [\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def pieces(text: str) -> list[str]:
    """Cut before each space that a character other than white space follows."""
    parts = text.split(" ")
    if not _SPACE_RUN.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


_MADE: dict[tuple, DuckBpe] = {}
KEPT[__name__] = _MADE.clear


def _coder(tokens: list[bytes], pattern: str, remembered: int = REMEMBERED, query_bytes: int = QUERY_BYTES) -> DuckBpe:
    """One for each Python worker and vocabulary."""
    key = (len(tokens), hash(tuple(tokens)), pattern, remembered, query_bytes)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = DuckBpe(tokens, pattern, remembered, query_bytes)
    return _MADE[key]


#: Bytes of text that a task encodes at once, and ids that it decodes at once.
_BATCH_BYTES, _BATCH_IDS = 3_000_000, 500_000


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _encoded(docs: DataFrame, path: str, pattern: str, decode: bool, frugally: bool = False) -> DataFrame:
    docs = docs.drop("ids", "n_tokens", *(["decoded"] if decode else []))
    columns = docs.columns
    share = 3 if frugally else 1
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern, REMEMBERED // share, QUERY_BYTES // share)
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.column("row").flatten(), names=columns)
            for a, b in _groups(pc.binary_length(batch.column("text")).fill_null(0).to_pylist(), _BATCH_BYTES // share):
                part = batch.slice(a, b - a)
                ids = coder.encode_batch(part.column("text"))
                added = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
                if decode:
                    added.append(pa.array(coder.decode_batch(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *added], names=[*columns, "ids", "n_tokens", *(["decoded"] if decode else [])])

    schema = columns_of(docs) + "ids binary, n_tokens long" + ", decoded binary" * decode
    return docs.select(F.struct("*").alias("row")).mapInArrow(frugal(run), schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (packed little-endian unsigned 32-bit integers) and ``n_tokens``;
    columns of these names are replaced.

    Null and empty texts have no ids. Special tokens aren't recognised: their strings are
    ordinary text. The vocabulary, a file of bounded size, is read on the driver and broadcast.
    Repeated rows are encoded each; an empty table gives an empty result.
    """
    return _encoded(docs, path, pattern, False)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, frugally: bool = False) -> DataFrame:
    """``bpe_encode`` with ``decoded``, the bytes that the ids stand for, by one process a task;
    ``frugally`` with batches, queries and a memory of pieces a third as large, for a job that
    other stages ran in before."""
    return _encoded(docs, path, pattern, True, frugally)


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that its packed ``ids`` stand for; null ids stand
    for none."""
    encoded = encoded.drop("decoded")
    columns = encoded.columns
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.column("row").flatten(), names=columns)
            for a, b in _groups([(n or 0) // 4 for n in pc.binary_length(batch.column("ids")).to_pylist()], _BATCH_IDS):
                part = batch.slice(a, b - a)
                out = coder.decode_batch([i or b"" for i in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(out, pa.binary())], names=[*columns, "decoded"])

    schema = columns_of(encoded) + "decoded binary"
    return encoded.select(F.struct("*").alias("row")).mapInArrow(frugal(run), schema)


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
