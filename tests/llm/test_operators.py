"""The corpus operators against brute force on small tables, with nulls, empty texts, ties and copies."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, langid, lengths, mixing, ngram_join, rules, suffixes, vectors, warc
from gridloom.llm.graph import components
from gridloom.llm.queries import vocabulary

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
DOC_COLUMNS = [c.split()[0] for c in DOC.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(90001, None, None, None, None), (90002, "", "en", "a", 0), (90003, "  \n", "en", "a", 3), (90004, "word " * 3000, "en", "a", 15000), (90005, "aa", "en", None, 2), (90005, "aa", "en", None, 2), (None, "no id at all here", "en", "b", 3)]
    return spark.read.parquet(f"{D}/documents.parquet").unionByName(spark.createDataFrame(extra, DOC)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (7, None)], "a long, b long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<\\s> <\\/s>"), (1, 1, "assistant", "<\\s> <\\/s>"), (2, None, None, None), (None, 0, "user", "x")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t.role, t.text) for t in out[1].parsed] == [(r[2], r[3]) for r in rows[:3]]
    assert [(t.role, t.text) for t in out[2].parsed] == [("", "")]
    assert None in out


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "u v", None), (4, "w", ""), (5, "x", "é<p>")], "page_id long, url string, html string")
    out = {r.page_id: r for r in warc.archived(pages).collect()}
    assert out[1].record_type == "revisit" and out[1].refers_to == 2 and out[2].record_type == "response"
    assert out[3].refers_to == 4 and out[3].payload_bytes == 0 and out[5].payload_bytes == 5
    assert out[5].payload_digest == warc.sha1_base32("é<p>".encode())
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_of_all_pages(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    groups = collections.defaultdict(list)
    rows = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for page, payload in rows.items():
        groups[payload].append(page)
    out = warc.archived(pages).collect()
    assert sorted(r.page_id for r in out) == sorted(rows)
    for r in out:
        last = max(groups[rows[r.page_id]])
        assert (r.payload_bytes, r.payload_digest) == (len(rows[r.page_id]), warc.sha1_base32(rows[r.page_id]))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))


def test_warc_damaged():
    """Each damage is named, not read over."""
    import io

    import zstandard

    good = warc.make_record(7, "http://a", b"<p>text</p>", warc.sha1_base32(b"<p>text</p>"), True, None)
    dictionary = warc.train_dictionary([good])
    press = zstandard.ZstdCompressor(dict_data=dictionary)
    archive = warc.dictionary_frame(dictionary) + press.compress(good)
    assert [warc.parse_record(x)["page_id"] for x in warc.read_frames(io.BytesIO(archive).read)] == [7]
    for broken, error in [(archive[:-3], "cut off"), (archive[:20], "cut off"), (b"", "no leading frame"), (press.compress(good), "magic number")]:
        with pytest.raises(ValueError, match=error):
            list(warc.read_frames(io.BytesIO(broken).read))
    for old, new, error in [(b"<p>text", b"<p>tex7", "disagree"), (b"<p>text", b"<p>tex", "Content-Length"), (b"WARC/1.1", b"WARC/9.9", "not a WARC"), (b"WARC-Date:", b"WARC-Other:", "missing"), (b"HTTP/1.1", b"GOPHER/1", "no HTTP")]:
        with pytest.raises(ValueError, match=error):
            warc.parse_record(good.replace(old, new))


def test_cross_parsing():
    """Phrases of whole texts against a search for each longest match."""
    reference = b"the cat sat on the mat and the dog sat on the log "
    parser = langid.CrossParser(reference)
    texts = [b"the cat and the dog zat on the mat" * 40, b"", b"zzz", b"sat on the"]
    got = langid.cross_entropies(texts, [parser])[:, 0]
    for text, bits in zip(texts, got, strict=True):
        phrase, phrases = b"", min(1, len(text))
        for byte in text:
            c = bytes([byte])
            if phrase + c in reference:
                phrase += c
            else:  # a byte that the reference lacks begins a phrase that goes on after it
                phrase, phrases = c if c in reference else b"", phrases + 1
        assert bits == pytest.approx(phrases * parser.bits / max(len(text), 1))


def test_clashing_columns(spark):
    """Names that operators use within, and one with a backtick, stay as they are."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "_hash", "_key", "_n", "_s", "_one", "h", "cls", "a`b", "hash", "row"]
    rows = [(i, ("some words that come again " * 30) + str(i), "en", "s", 3, *["x"] * 10) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names[5:]))
    for out in (mixing.mixed_documents(table), suffixes.documents_without_repeats(table, 50), ngram_join.one_of_each(table), rules.good_documents(table, spark.createDataFrame([], "doc_id long, quality int"))):
        assert out.columns == names
        assert all(set(r[5:]) == {"x"} for r in out.collect())
    coded = bpe.bpe_encode(table, *vocabulary()).collect()
    assert len(coded) == 4 and all(r["a`b"] == "x" for r in coded)


def test_suffix_family_outlives_a_run(spark, tmp_path):
    place = f"file://{tmp_path}/family"
    rows = lambda keys, text: spark.createDataFrame([(k, text, i, 1) for i, k in enumerate(keys)], "key long, h binary, at long, n long")
    found = lambda df: sorted((r.key, r.n) for r in df.collect())
    family = suffixes.SuffixFamily(spark, place)
    assert found(family.add(rows([1, 2, 2], b"a"))) == [(2, 2)]
    assert found(family.add(rows([1, 3], b"b"))) == [(1, 2)] and [n for n, _ in family.levels] == [2]
    again = suffixes.SuffixFamily(spark, place)
    assert again.levels == family.levels
    assert found(again.add(rows([2, 3, 4], b"c"))) == [(2, 3), (3, 2)] and [n for n, _ in again.levels] == [2, 1]
    again.entries().write.parquet(f"{place}/array-4")  # what a run left that was lost before it noted its level
    again.add(rows([5], b"d"))
    assert [n for n, _ in again.levels] == [4] and again.entries().count() == 9


def test_rules(spark, docs, empty):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    out = rules.quality_rules(docs, labels).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out[out.doc_id.notna()].itertuples():
        w = words(texts[int(r.doc_id)])
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        lines = [x for x in (texts[int(r.doc_id)] or "").split("\n") if words(x)]
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in texts[int(r.doc_id)] or ""), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(empty, labels).count() == 0
    kept = rules.good_documents(docs, labels)
    assert kept.count() == out.kept.sum() and kept.columns == docs.columns


def test_rules_by_both_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = rules.quality_rules(docs, labels).where("not base_failed").join(labels, "doc_id").toPandas()
    bad, good = out[out.quality == 0], out[out.quality == 1]
    assert len(bad) > 20 and (~bad.kept).mean() > 0.9 and good.kept.mean() > 0.9


def test_threshold(spark):
    def at(scores, labels):
        rows = [(k, s, 0, 100) for k, s in enumerate(scores)]
        scored = spark.createDataFrame(rows, "doc_id long, score double, n_repeat_words long, n_words long")
        return rules.calibrate(scored, spark.createDataFrame(labels, "doc_id long, quality int"), 0.25)

    scores = [0.1, 0.2, 0.3, 0.6, 0.5, 0.7, 0.8]
    good, bad = [(k, 1) for k in range(4)], [(4, 0), (5, 0), (5, 0), (6, 0), (None, 0), (0, None)]
    assert at(scores, good + bad) == 0.5  # a good row goes, which costs less than a bad one
    assert at(scores, good) == 601 / 2000 and at(scores, bad) == 2.0


def test_language(spark, docs, empty):
    out = langid.language_id(docs).toPandas()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    judged = out[out.held_out & (out.lang_pred != "und") & out.doc_id.notna()]
    assert np.mean([lang[int(r.doc_id)] == r.lang_pred for r in judged.itertuples()]) > 0.9
    assert set(out[out.doc_id.isin([90001, 90002])].lang_pred) == {"und"}
    assert len(out) == docs.count()
    assert langid.language_id(empty).count() == 0


def test_phrases_of_whole_texts(monkeypatch):
    """Against longest matches by search, over texts much longer than a block."""
    monkeypatch.setattr(langid, "BLOCK", 16)
    rng = np.random.default_rng(4)
    say = lambda n, letters: "".join(rng.choice(list(letters), n)).encode()
    references = [say(400, "abcd "), say(300, "abde\u00e9 ")]
    texts = [b"", b"a", references[0][50:180], say(333, "abc "), say(16, "abd"), say(1000, "abcdefg 12"), b"x" * 40] + [say(int(n), "abcd ") for n in rng.integers(0, 90, 30)]
    fold = lambda b: langid._CLASS[np.frombuffer(b, np.uint8)].tobytes()

    def phrases(text, known):
        n, now = min(1, len(text)), b""
        for c in (text[i : i + 1] for i in range(len(text))):
            if c not in known:  # begins a phrase that goes on with what follows
                n, now = n + 1, b""
            elif now + c in known:
                now += c
            else:
                n, now = n + 1, c
        return n

    got = langid.cross_entropies(texts, [langid.CrossParser(r) for r in references])
    for k, r in enumerate(references):
        for t, bits in zip(texts, got[:, k], strict=True):
            assert bits == pytest.approx(phrases(fold(t), fold(r)) * np.log2(len(r)) / max(len(t), 1)), t


def test_language_of_few_ids(spark, monkeypatch):
    """A language whose rows all have one id is learned, and repeated rows count once."""
    monkeypatch.setattr(langid, "LONG", 300)
    rows = spark.read.parquet(f"{D}/documents.parquet").where("lang in ('en', 'es') and length(text) > 400")
    one = rows.where("lang = 'es'").withColumn("doc_id", F.lit(2).cast("long"))
    many = rows.where("lang = 'en'")
    table = many.select(DOC_COLUMNS).unionByName(one.select(DOC_COLUMNS))
    table = table.unionByName(one.orderBy("text").limit(1).select(DOC_COLUMNS).crossJoin(spark.range(3000)).select(DOC_COLUMNS))
    assert set(langid.reference_texts(table)) == {"en", "es"}
    out = langid.identify(rows, langid.reference_texts(table)).join(rows.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and len(out) == rows.count()


def test_mixing(docs, empty):
    out = mixing.mix_sources(docs).toPandas()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(g["size"].max(), 1)
        assert (g.taken <= 3 * g["size"]).all()
    assert mixing.mix_sources(empty).count() == 0


def targets_by_hand(sizes):
    """Shares by weight of all sizes; what is above three times a source's size goes to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        for s in over or open_:
            out[s] = 3.0 * sizes[s] if over else weight[s] * level
        left -= sum(out[s] for s in over)
        open_ = open_ - over if over else set()
    return out


@pytest.mark.parametrize("copies", [1, 40])
def test_mixing_of_equal_rows(spark, copies):
    """A source of equal rows comes as near its target as one row allows; extra columns stay."""
    rows = [(7, "one two three four five six seven eight nine ten", "en", "b", 0)] * copies + [(100 + i, "w " * (3 * i), "en", s, 0) for i in range(1, 30) for s in ("a", "c", None)] + [(9, None, "en", "d", 0)] * 3
    table = spark.createDataFrame(rows, DOC).withColumn("rows", F.lit("x")).repartition(6)
    out = mixing.mix_sources(table).toPandas()
    assert len(out) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = targets_by_hand(sizes)
    for source, g in out.groupby("source", dropna=False):
        key = source if isinstance(source, str) else None
        assert g.target.iloc[0] == pytest.approx(want[key]) and g.source_size.iloc[0] == sizes[key]
        assert (g.taken <= 3 * g["size"]).all()
        assert abs(g.taken.sum() - want[key]) <= (5 if key == "b" else g["size"].max())
    mixed = mixing.mixed_documents(table).toPandas()
    assert set(mixed.rows) <= {"x"} and mixed.columns.tolist() == table.columns
    counts = mixed[mixed.source == "b"].shape[0]
    assert 10 * counts == out[out.source == "b"].taken.sum()


def test_lengths(docs):
    found = lengths.encoded_lengths(docs, *vocabulary())
    n = sorted(r.n_tokens for r in found.collect())
    table = {r.n_tokens: r for r in lengths.context_limits(lengths.length_histogram(found)).collect()}
    for k in (n[0], n[len(n) // 2], n[-1]):
        assert table[k].truncated_tokens == sum(min(x, k) for x in n) and table[k].tokens_from == sum(x for x in n if x >= k)


def test_bpe(docs, empty):
    import tiktoken

    path, pattern = vocabulary()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    for r in bpe.bpe_round_trip(docs, path, pattern).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.bpe_round_trip(empty, path, pattern).count() == 0


def test_bpe_words_of_one_query():
    """Random words of up to 10,000 bytes, ties of equal pairs and a first word without a pair."""
    import random

    import tiktoken

    path, pattern = vocabulary()
    ranks = bpe.read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
    chance = random.Random(5)
    words = [b"\xff\xfe", b"aaaaaaaaaaa", b"ababababab"]
    assert bpe.LONG_WORD > 10_000
    for n in [*range(1, 35)] * 40 + [1000, 10_000]:
        words.append("".join(chance.choice("aeinrst lo\u00e9\u4e2d\U0001f600") for _ in range(n)).encode()[:n])
    coder = bpe.DuckBpe(ranks, pattern)
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_words(words)]
    assert got == [encoding._core_bpe.encode_single_piece(w) for w in words]
    assert coder.decode_batch(coder.encode_words(words)) == words


def brute_components(rows, width, num, den):
    sets = {}
    for doc, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    least = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])) and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return {d: (len(sets[d]), least[d]) for d in sets}


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, empty, width, num):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    near = []
    for k in range(60):  # a family of copies with a few words changed each
        w = list(base)
        for at in rng.integers(0, 120, 1 + k % 5):
            w[at] = f"x{k}"
        near.append((80000 + k, " ".join(w), "en", "a", 0))
    whole = docs.unionByName(spark.createDataFrame(near, DOC)).where("doc_id is not null")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(whole, ngram_join.Similarity(num, 100, width)).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in whole.collect()], width, num, 100)
    assert ngram_join.similar_documents(empty).count() == 0


def test_unlike_sets_share_no_signature():
    """Many sets of few shingles a part have no group to spare; parts without a shingle are no likeness."""
    sim, rng = ngram_join.Similarity(num=80, den=100, width=5), np.random.default_rng(11)
    seen = collections.Counter()
    for size in [*range(62, 81)] * 20:
        members = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for found, _ in ngram_join.signatures(members, sim):
            seen.update(set(found.tolist()))
    assert max(seen.values()) == 1


def test_stars_that_meet_are_compared_apart(spark, monkeypatch):
    """Sets that share no star aren't held together, however long the chain of stars between them."""
    sim, held = ngram_join.Similarity(), []
    compare = ngram_join._within_families

    def seen(sets, families, *more):
        held.append(max(r["count"] for r in families.groupBy("family").count().collect()))
        return compare(sets, families, *more)

    monkeypatch.setattr(ngram_join, "_within_families", seen)
    members = [np.arange(100, dtype=np.uint64) + np.uint64(1000 * (k - (k == 9))) for k in range(12)]  # 8 and 9 are alike
    sets = spark.createDataFrame([(k, ngram_join._sketch(m), m.tobytes()) for k, m in enumerate(members)], "cls long, sketch binary, data binary")
    stars = spark.createDataFrame([(k, k + 1, 1) for k in range(11)], "a long, b long, n long")
    links = {(r.a, r.b) for r in ngram_join.similar_pairs(sets, stars, sim).collect()}
    assert links == {(8, 9)}
    assert held[0] == 2


def test_one_of_each_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (0, b), (1, b), (1, c), (1, c), (3, d), (3, d), (3, None), (1, ""), (None, a), (4, "four")]
    got = ngram_join.one_of_each(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC), ngram_join.Similarity(num=80, den=100, width=5))
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter([(1, a), (0, b), (1, c), (3, d), (3, None), (1, ""), (None, a), (4, "four")])


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + rng.standard_normal(16) * 0.08 * (i % 3)).tolist(), i % 2) for i in range(300)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0] * 16, None), (1004, [1.0, None], 1), (1005, rows[0][1], 0), (1006, [3.0], 0), (1007, [2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [r for r in rows if r[0] < 1000 or r[0] in (1005, 1006, 1007)]
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) else -1
    links = collections.defaultdict(set)
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and cosine(a[1], b[1]) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    for vec, _, _ in rows:
        reach, todo = {vec}, [vec]
        while todo:
            for x in links[todo.pop()] - reach:
                reach.add(x)
                todo.append(x)
        assert got[vec] == (len(links[vec]), min(reach), vec == min(reach))


def test_vectors_in_cells(spark):
    """Several signs, rotations and blocks: every planted link is found, none below the threshold."""
    chance = np.random.default_rng(4)
    dim, rows = 64, []
    for group in range(60):
        centre = chance.standard_normal(dim)
        for k in range(12):
            rows.append(centre + chance.standard_normal(dim) * chance.choice([0.05, 0.12, 0.16]))
    rows += list(chance.standard_normal((400, dim)))
    rows += [np.full(dim, 1e-200), np.full(dim, 2e-200), np.full(dim, 1e200)]
    x = np.array(rows)
    assert vectors.cell_bits(len(x), dim, 16) > 3 and vectors.cell_tables(vectors.cell_bits(len(x), dim, 16), 0.98) > 5
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table, held=16, side=32).collect()}
    unit = x / np.abs(x).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    links = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(x))}
    assert sum(map(len, links.values())) > 1000
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(reach))


def brute_spans(texts, length):
    at = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2000, 3])
def test_suffixes(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    if group == 3:  # many shares of hashes, and texts that no broadcast rules out
        monkeypatch.setattr(suffixes, "SHARE", 300)
        monkeypatch.setattr(suffixes, "SMALL", 0)
    rng = np.random.default_rng(1)
    say = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    shared = say(500)
    rows = [(70000 + k, say(50 * k) + shared[: 380 + 5 * k] + say(200), "en", "a", 0) for k in range(12)] + [(70100, "ab" * 900, "en", "a", 0), (70101, shared + say(30) + shared, "en", "a", 0)]
    whole = docs.where("doc_id is null or doc_id <> 90004").unionByName(spark.createDataFrame(rows, DOC))
    got = suffixes.without_repeats(whole).toPandas()
    texts = [(t or "").encode() for t in got.text]
    want = brute_spans(texts, 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.itertuples()] == want
    assert suffixes.without_repeats(empty).count() == 0
    for r in suffixes.documents_without_repeats(whole, 240).collect():
        assert r.text is None or "�" not in r.text
