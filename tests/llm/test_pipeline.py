import importlib.util
import os
import sys

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMOKE_DIR = "/root/testdata/sf0.001"
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from orbitcart.llm import oph, pairwise, queries, raking, randomness  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, as run() writes and rereads them."""
    docs, seen = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMOKE_DIR).write.parquet(path)
        out = spark.read.parquet(path)
        seen[name] = docs, out
        docs = out
    return seen


def test_stages_keep_columns_and_only_lose_rows(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, (before, after) in stages.items():
        assert after.count() <= before.count() and after.count() > 0
        if name != "bpe_encoding":
            assert after.columns == columns


def test_quality_stage_keeps_good_documents(spark, stages):
    before, after = stages["quality_classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMOKE_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    known = [(labels[r.doc_id], r.doc_id in kept) for r in before.select("doc_id").collect() if r.doc_id in labels]
    assert np.mean([bool(a) == b for a, b in known]) > 0.95
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_dedup_stage_keeps_one_of_each_group(stages):
    before, after = stages["minhash_near_dedup"]
    groups = {r.doc_id: r.component_id for r in oph.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))


def test_secret_stage_masks(stages):
    before, after = stages["secret_scan"]
    old, new = ({r.doc_id: r for r in x.collect()} for x in (before, after))
    spans = {r.doc_id: r.spans for r in randomness.find_secrets(before).collect()}
    assert old.keys() == new.keys()
    for i, row in new.items():
        assert (row.text == old[i].text) == (spans[i] == "") and row.n_chars == len(row.text)


def test_mixing_stage_follows_its_probabilities(stages):
    before, after = stages["source_mixing"]
    kept = {r.doc_id for r in raking.mix(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept


def test_encoding_stage_equals_the_library(stages):
    before, after = stages["bpe_encoding"]
    library = Tokenizer.from_file(queries.tokenizer_path())
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.n_chars) == (len(r.ids), len(texts[r.doc_id]))


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SMOKE_DIR)
    assert sorted((r.doc_id, r.n_tokens) for r in rows.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages["bpe_encoding"][1].collect())


def test_stages_on_awkward_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s", 3), (1, text, "en", "s", 3), (2, None, None, None, None), (None, "no id here", "en", "s", 1), (3, "", "en", "s", 0),
            (4, "w " * 30_000, "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SMOKE_DIR)
            assert out.count() <= len(data)
            if name != "bpe_encoding":
                assert out.columns == docs.columns
        assert pairwise.keep_good(docs, pairwise.Model((0.0,) * len(pairwise.FEATURES), 0.0)).count() == len(data)


def test_registered_queries(spark):
    spec = importlib.util.spec_from_file_location("entry_under_test", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries().keys()
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    expected = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.QUERIES[name](spark, SMOKE_DIR).select(*columns).collect()), key=repr) == expected
