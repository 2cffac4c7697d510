"""The registered queries against their SQL, and the pipeline against a plain version of each stage."""

import hashlib

import duckdb
import public_tokenizers as T
import pytest
import tiktoken
from test_dedup import slow_fingerprint, want_components
from test_text import want_report

import __spark_entry__
import corpus_pipeline
from amberline.llm import language_id, queries
from amberline.llm.prefix_bpe import load_ranks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall(), key=str)


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline(spark, documents, benchmark_items):
    items = benchmark_items.collect()
    classifier = language_id.Classifier(language_id.learned(documents))
    rows = [r for r in documents.collect() if not classifier.predict(r.text)[2]]
    last = {}
    for r in rows:
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    rows = sorted((r for r in rows if last[r.text] == r.doc_id), key=lambda r: r.doc_id)
    roots = want_components([slow_fingerprint(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    bad = {r[0] for r in want_report(rows, items) if r[5]}
    with open(T.path(queries.BYTE_BPE), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=load_ranks(f.read()), special_tokens={})
    want = []
    for r in rows:
        if r.doc_id not in bad:
            ids = own.encode_ordinary(r.text)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert bad and sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_bear_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, odd.where("false"), SF).count() == 0
