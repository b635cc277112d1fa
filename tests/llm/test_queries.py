"""The registered corpus queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from tabulon.llm import queries
from tabulon.llm.common import table
from tests.llm.test_operators import brute_kept
from tests.test_queries import TABLES, rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_pipeline_equals_its_operators(spark):
    from tabulon.llm import decontaminate, mixing, quality, secrets

    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.quality_verdicts(docs, table(spark, SF, "labels")).filter("kept").select("doc_id").collect()}
    left = docs.filter(docs.doc_id.isin(*kept))
    kept = brute_kept([(r.doc_id, r.text) for r in left.collect()])
    left = docs.filter(docs.doc_id.isin(*kept))
    kept = {r.doc_id for r in decontaminate.digest(left, table(spark, SF, "benchmark")).filter("not contaminated").collect()}
    left = docs.filter(docs.doc_id.isin(*kept))
    masked = {r.doc_id: secrets.mask_spans(r.text, secrets.scan(r.text)[1], "[SECRET]") for r in left.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and all(r.text == masked[r.doc_id] for r in got)
    want = spark.createDataFrame([(r.doc_id, masked[r.doc_id], r.lang, r.source) for r in left.collect()], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.mixed(want).collect())
