"""The pipeline: each stage judged on its own input, by a plain version of its rule."""

import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from strataforge.llm import bpe, queries
from tests.llm.test_operators import lower, linked_plainly, spans_plainly, tiktoken_encoding

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage has read and written."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name.replace(" ", "-"))
        stage(spark, docs, FOLDER).write.parquet(path)
        written = spark.read.parquet(path)
        out.append((docs, written))
        docs = written
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages[0]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = ids(after)
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    long_enough = {i for i, t in texts.items() if len(t.split()) >= 50}
    clean = {i for i, label in labels.items() if label == (1, 0) and i in long_enough}
    assert clean <= kept and kept <= long_enough
    junk = {i for i, (q, _) in labels.items() if q == 0}
    assert len(junk & kept) <= 0.2 * len(junk)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {i for i, _, c in linked_plainly(rows, 5, 80) if i == c}


def test_contaminated_documents_go(spark, stages):
    before, after = stages[2]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words.findall(lower(r.text or ""))
        k = min(13, len(w))
        windows |= {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    want = set()
    for r in before.collect():
        w = words.findall(lower(r.text or ""))
        hit = {x for k in {len(p) for p in windows} for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in windows for x in range(j, j + k)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r.doc_id)
    assert ids(after) == want


def test_personal_data_is_covered(stages):
    before, after = stages[3]
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert not spans_plainly(r.text or "")
        if not re.search("[0-9@]", old[r.doc_id] or ""):
            assert r.text == old[r.doc_id]


def test_tokens(stages):
    before, after = stages[4]
    encoding = tiktoken_encoding()
    texts = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r.ids for r in after.collect()}
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in texts.items()}
    assert [r.decoded.decode() for r in bpe.decode(after, queries.RANKS).where("doc_id = 1").collect()] == [t for i, t in texts.items() if i == 1 and i in got]


def test_all_are_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)
