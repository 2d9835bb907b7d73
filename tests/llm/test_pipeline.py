"""The registered queries against their oracles, and the pipeline stage by stage."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faultline.llm import oracles, queries
from faultline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in res.description]
    want = sorted(map(str, res.fetchall()))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_all_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x[:x.index("_") + 1] for x in names if x.startswith("op")}
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark, docs, rows, empty, tmp_path):
    items = " ".join(next(r[1] for r in rows if r[1] and r[0] == 20).split()[:20])
    spark.createDataFrame([(1, items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, nothing, sizes = docs, empty, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now, nothing = stage(spark, now, str(tmp_path)), stage(spark, nothing, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.schema == docs.schema, name
        assert nothing.count() == 0
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] and sizes[2] >= sizes[3] and sizes[3] == sizes[4] == sizes[5] > 0
    assert now.where("not round_trip").count() == 0
    assert {r.doc_id for r in now.collect()} <= {r[0] for r in rows}
