"""The stages, one after the other, against what each is to decide."""

from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from loomgraph.llm import pu_toxicity, queries, secret_ledger
from loomgraph.llm.common import stash, table
from test_operators import brute_components, fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages(spark, sf_dir, stages):
    source = table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(s.columns == source.columns for s in stages[:-1])
    toxic, single, masked, mixed, packed = stages
    model = pu_toxicity.train(source, table(spark, sf_dir, "labels"))
    keep = {r.doc_id for r in pu_toxicity.score(source, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in toxic.collect()} == keep
    rows = [(r.doc_id, fingerprint(r.text)) for r in toxic.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(brute_components(rows)))
    assert single.count() == masked.count()
    assert not any(secret_ledger.scan(r.text.encode()) for r in masked.collect())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {r.doc_id for r in masked.collect()} and max(copies.values()) <= 2
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.piece == 0
    assert pieces == copies


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1].count()
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    expected = con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_a_row_for_each_document(spark, sf_dir, name):
    if name != "op7_url_filter":
        ids = {r.doc_id for r in queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()}
        assert ids == {r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect()}
