import os
import time
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gridloom.llm import bpe, ngram_join, rules, suffixes
from gridloom.llm.common import frugal, released, shared_dir, written
from gridloom.llm.queries import vocabulary


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, d), name)
        assert docs.columns == columns
        if name != "source_mix":
            assert 0 < docs.count() <= before
        before = docs.count()
    out = pipeline.STAGES[-1][1](spark, docs, d)
    texts = sorted((r.text or "") for r in docs.collect())
    back = sorted(bytes(r.decoded).decode() for r in bpe.bpe_decode(out.select("doc_id", "ids"), *vocabulary()).collect())
    assert texts == back


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "repeated_passages", "token_ids"])
def test_workers_get_small_batches(spark, name):
    """4 MB of texts reach a Python worker in parts, once a stage was built."""
    d = "/root/testdata/sf0.001"
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        dict(pipeline.STAGES)[name](spark, spark.read.parquet(f"{d}/documents.parquet").limit(20), d)
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        rows = spark.range(200, numPartitions=1).selectExpr("repeat('x', 20000) AS text")
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 4_000_000 and max(got) < 1_200_000
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_a_worker_frees_what_others_kept():
    """A tokenizer or word hashes of one stage don't stay beside the next stage's tasks."""

    def coding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    coding.__module__ = bpe.__name__
    bpe._MADE[("a",)] = object()
    ngram_join._KNOWN[b"word"] = 1
    assert list(frugal(coding)(iter([]))) == []
    assert ("a",) in bpe._MADE and not ngram_join._KNOWN
    assert list(frugal(rules._count_batches)(iter([]))) == []
    assert not bpe._MADE


def test_good_documents_take_one_worker_a_task(spark):
    """And are those that the two steps of ``quality_rules`` keep."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    good = rules.good_documents(docs, labels)
    assert good._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    judged = rules.quality_rules(docs, labels).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in judged)
    wide = [r[:7] for r in rules.rule_statistics(docs).select(*rules.features()).collect()]
    stats = rules.rule_statistics(docs).toPandas()
    assert abs(rules._counted_features({c: stats[c].to_numpy() for c in rules.COUNTS}) - wide).max() < 1e-15


def tables_in(spark) -> set[str]:
    place = shared_dir(spark).removeprefix("file://") + "/gridloom"
    return {f"{place}/{x}" for x in os.listdir(place)} if os.path.isdir(place) else set()


def test_stages_keep_no_tables_that_nothing_reads(spark):
    """Neither suffix arrays nor sets nor windows stay on the shared disk beside later stages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10**6).withColumn("text", F.concat("text", F.lit(" and more"))))
    before = tables_in(spark)
    ngram_join.one_of_each(docs, pipeline.NEAR)
    out = suffixes.documents_without_repeats(docs, pipeline.PASSAGE_BYTES)
    left = {os.path.basename(x).rsplit("-", 1)[0] for x in tables_in(spark) - before}
    assert not left & {"suffix-entries", "suffix-family", "suffix-lists", "suffix-shared", "suffix-found", "partenum-sets"}
    assert out.count() > 0


def test_a_family_keeps_its_levels_alone(spark, tmp_path):
    family = suffixes.SuffixFamily(spark, f"file://{tmp_path}/family")
    for batch in range(4):
        rows = spark.createDataFrame([(k, bytes([batch]), k, 1) for k in (1, 2, 2, batch)], "key long, h binary, at long, n long")
        family.add(rows)
        assert set(os.listdir(tmp_path / "family")) == {"levels", *(place for _, place in family.levels)}
    assert family.entries().count() == 10  # equal rows once


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, was = [], spark.conf.get(key)
    files = lambda: sum("shuffle_" in str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = files()
    out = written(spark.range(1000).repartition(3, "id"), "kept", held)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == was and out.count() == 1000
    place = held[0].removeprefix("file://")
    assert os.path.isdir(place)
    released(spark, held)
    assert not held and not os.path.exists(place)
