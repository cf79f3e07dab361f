import re

import pytest

import corpus_pipeline
from conftest import SF
from tillstream.llm import queries
from tillstream.llm.common import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns on the small tables."""
    folder, docs = ensure_checkpoint_dir(spark) + "/stages", spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_keep_columns_and_take_effect(spark, stages):
    docs, clean, exact, near, mixed, encoded = stages
    for frame in stages[:5]:
        assert frame.columns == COLUMNS
    toxic = {r.doc_id for r in queries.QUERIES["op5_toxicity"](spark, SF).filter("predicted = 1").collect()}
    ids = lambda frame: [r.doc_id for r in frame.select("doc_id").collect()]
    assert set(ids(clean)) == set(ids(docs)) - toxic
    norm = lambda frame: [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in frame.collect()]
    assert sorted(norm(exact)) == sorted(set(norm(clean)))
    assert set(ids(near)) <= set(ids(exact)) and len(ids(near)) == len(set(ids(near)))
    text = {r.doc_id: r.text for r in near.collect()}
    for r in mixed.collect():
        assert text[r.doc_id].lstrip().startswith(r.text.lstrip()[:50]) and r.n_chars == len(r.text)
    assert set(ids(encoded)) == set(ids(mixed))


def test_run_equals_its_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.sample, r.ids)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[-1].collect()))


def test_odd_rows_pass_every_stage(spark, odd):
    docs = odd.select(*COLUMNS)
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
        frame.count()
