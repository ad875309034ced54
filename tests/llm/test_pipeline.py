"""The pipeline's stages on their own inputs, and the queries that SQL can state."""

from __future__ import annotations

import os

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from vantage import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(llm.oracle_sql()))
def test_against_sql(key, spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    theirs = con.sql(llm.oracle_sql()[key])
    names = sorted(theirs.columns)
    at = [theirs.columns.index(n) for n in names]
    mine = llm.queries()[key](spark, SF).select(*names).collect()
    assert sorted(str(tuple(r)) for r in mine) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_stages_keep_the_columns_and_take_effect(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    row = table.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.lit("12345 !!").alias("text"), "lang", "source", "n_chars")
    copy = table.limit(1).withColumn("doc_id", F.lit(10**6 + 1).cast("long"))
    docs = table.unionByName(row).unionByName(copy)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table.columns, name
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert 10**6 not in ids and len(ids) > 0.97 * table.count()
        if name == "near_copies":
            assert 10**6 + 1 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_nothing_nulls_and_repeats(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL AND length(text) > 300").limit(30)
    first = table.orderBy("doc_id").limit(1)
    no_id = first.withColumn("doc_id", F.lit(None).cast(table.schema["doc_id"].dataType))
    other = first.withColumn("text", F.reverse("text"))  # another text under the same id
    blank = [first.withColumn("doc_id", F.lit(10**6 + i).cast(table.schema["doc_id"].dataType)).withColumn("text", F.lit(t).cast("string")).withColumn("source", F.lit(None).cast("string")) for i, t in enumerate([None, "", " "])]
    odd = table
    for more in (first, no_id, no_id, other, *blank):
        odd = odd.unionByName(more.select(*table.columns))
    odd = odd.coalesce(2).cache()
    for docs in (table.limit(0), odd):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SF)
            rows = got.collect()
            assert (len(rows) > 0) == (n > 0), name
            if name == "near_copies" and n:
                assert sum(r["doc_id"] is None for r in rows) == 2  # rows without an id stay
            if name == "repeated_passages" and n:
                assert len(rows) == n
            if name in ("mixture", "packing") and n:
                assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_entry_module_registers_all_eleven():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
