"""The pipeline: each stage against what its operator says, and rows out of the ordinary."""

import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as pipeline
from clicktrail.llm import jaccard, quality, toxicity
from clicktrail.llm.queries import held_out
from clicktrail.sources.scratch import written
from tests.llm.conftest import TABLES
from tests.llm.test_jaccard import plain as plain_links
from tests.llm.test_packing import check as check_packing
from tests.llm.test_secrets import base_spans


@pytest.fixture(scope="module")
def stages(spark, documents):
    made, docs = {}, documents
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, TABLES), f"test-{name}")
        made[name] = docs
    return made


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_are_named_and_keep_the_columns(documents, stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].dtypes == documents.dtypes


def test_rejected_documents_go(documents, labels, stages):
    model = quality.train(documents, labels.filter(~held_out()), cut_score=0.3)
    assert ids(stages["quality"]) == ids(quality.score(documents, model).filter("score >= 0.3"))
    second = toxicity.train(stages["quality"], labels.filter(~held_out()))
    assert ids(stages["toxicity"]) == ids(toxicity.score(stages["quality"], second).filter("score < 0.5"))
    labelled = labels.filter("quality = 1 and toxic = 0").join(documents, "doc_id")
    assert len(ids(labelled) & ids(stages["toxicity"])) > 0.95 * len(ids(labelled))


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    firsts = {int(x.strip("()").split(", ")[2]) for x in plain_links(rows)}
    assert ids(stages["near_duplicates"]) == firsts


def test_secrets_are_masked_and_the_rest_stays(stages):
    before = {r.doc_id: r for r in stages["near_duplicates"].collect()}
    after = {r.doc_id: r for r in stages["secrets"].collect()}
    assert before.keys() == after.keys()
    assert any(base_spans(r.text) for r in before.values()) and not any(base_spans(r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert all(after[i] == r for i, r in before.items() if "[SECRET]" not in after[i].text)


def test_pieces_are_packed(stages):
    check_packing(stages["packing"].collect(), [(r.doc_id, r.text) for r in stages["secrets"].collect()])


def test_odd_rows_and_empty_table(spark, odd, documents):
    like = [F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in documents.dtypes]
    for docs in (documents.unionByName(odd.select(*like)), documents.limit(0)):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, TABLES), f"test-{name}")
            assert n == 0 or docs.count() > 0
        assert n or docs.count() == 0


def test_run_is_registered():
    assert __spark_entry__.queries()["pipeline"] is pipeline.run
    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")]
    assert names == [f"op{i}" for i in range(1, 14)]


def test_workers_get_small_batches(spark, documents):
    """Of a partition of many rows, or of long texts, a worker of a stage holds a bounded part at a time."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)], "bytes": [batch.nbytes]})

    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    try:
        pipeline.packing_stage(spark, documents, "")
        for length, n in ((1, 2_500), (100_000, 200)):
            texts = spark.range(0, n, 1, 1).select(F.repeat(F.lit("x"), length).alias("text"))
            met = texts.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(m.n for m in met) == n and max(m.n for m in met) <= 1_000 and max(m.bytes for m in met) < 2 * pipeline.BATCH_BYTES
    finally:
        for name in names:
            spark.conf.unset(name)


def test_sets_of_few_texts_are_held_at_once():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (0, 3, jaccard.AT_ONCE, 2 * jaccard.AT_ONCE + 1)]
    parts = list(jaccard._stretches(iter(batches)))
    assert [x for p in parts for x in p.column("x").to_pylist()] == [x for b in batches for x in b.column("x").to_pylist()]
    assert max(map(len, parts)) == jaccard.AT_ONCE


def test_freed_memory_goes_back_before_a_stage(spark):
    """What a stage has freed isn't held by the driver's Python while the next one runs."""

    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    blocks = [bytes([i % 251]) * 4_000 for i in range(50_000)]
    last = bytes(blocks[-1][:-1]) + b"!"  # stands above the others, so that they aren't the end of the heap
    del blocks
    before = held()
    pipeline.prepare(spark)
    assert last and held() < before - 100
