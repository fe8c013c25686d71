"""The registered queries on the small tables, and the pipeline against a plain version of its stages."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tallymark.llm import catalog, language_id
from tests.llm.test_operators import brute_private, brute_similar, brute_targets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_ten_operators_and_the_pipeline_are_registered():
    assert {int(m[1]) for q in catalog.queries() if (m := re.match(r"op(\d+)_", q))} == {*range(1, 11)} and "pipeline" in catalog.queries()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    tidy = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in order) for r in rows)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", [q for q in catalog.queries() if re.match(r"op[2-8]_|op1_", q)])
def test_queries_return_a_row_for_each_document(spark, name):
    df = catalog.queries()[name](spark, SF)
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name.startswith("op3"):
        assert df.select("query_id").distinct().count() == 5 and df.columns == ["query_id", "rank", "vec_id", "score"]
    elif name.startswith("op4"):
        assert {r.doc_id for r in df.collect()} < docs
    else:
        assert {r.doc_id for r in df.collect()} == docs and df.count() == len(docs)


def plain_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]) and model.predict(pa.array([r["text"]]))[1][0] >= model.threshold]
    label = brute_similar([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in words(r["text"]) for i in items)]
    for r in rows:
        at, out = 0, ""
        for a, b, kind in sorted((a, b, k) for k, a, b in brute_private(r["text"])):
            if a >= at:
                out += r["text"][at:a] + f"<{kind}>"
            at = max(at, b)
        r["text"] = out + r["text"][at:]
        r["n_chars"] = len(r["text"])
    return rows


def test_pipeline_equals_a_plain_version(spark):
    got = corpus_pipeline.run(spark, SF)
    rows = plain_pipeline(spark)
    size = {}
    for r in rows:
        r["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    target = brute_targets(size)
    out = {r.doc_id: r for r in got.collect()}
    plain = {r["doc_id"]: r for r in rows}
    assert len(out) == got.count() and set(out) <= set(plain)
    for d, r in out.items():
        assert (r.text, r.lang, r.source, r.n_chars, r.size) == tuple(plain[d][c] for c in ("text", "lang", "source", "n_chars", "size"))
        assert 0 < r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
    taken = {s: sum(r.taken for r in out.values() if r.source == s) for s in size}
    assert np.allclose([taken[s] for s in size], [target[s] for s in size], atol=1)


def test_stages_keep_the_columns_and_stand_odd_rows(spark, documents):
    from tests.llm.conftest import ODD

    docs = documents(ODD + [(100 + i, f"the house number {i} and the water", f"s{i % 3}", "en") for i in range(20)])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
