"""Each query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from facetgraph import graph_queries, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
assert graph_queries


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    wanted = db.sql(queries.oracle_sql()[name])
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(tuple(r[i] for i in places) for r in wanted.fetchall())


def test_budget_keeps_the_first_and_smaller_later_ones(spark):
    from facetgraph.operators.aggregates import budgeted

    rows = spark.createDataFrame([("a", 1, 90), ("a", 2, 20), ("a", 3, 9), ("b", 1, 500), ("b", 2, 1)], "k string, i int, size int")
    assert sorted(map(tuple, budgeted(rows, ["k"], ["i"], "size", 100).collect())) == [("a", 1, 90), ("a", 3, 9), ("b", 1, 500)]


def test_filters_reach_the_scan(spark):
    plan = queries.enum_eq(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "c_acctbal" not in plan.split("ReadSchema")[1]


def test_suggestions_have_five_at_most(spark):
    rows = queries.suggestions(spark, DATA).collect()
    assert rows and all(r["rank"] <= 5 and r["score"] >= 0.5 for r in rows)


def test_checker_results_come_in_parts_and_lose_nothing(spark):
    from pyspark.sql import functions as F

    from facetgraph.sources import files as fl

    many = spark.range(12_000).select(F.lit("a").alias("gate"), F.lit("c").alias("checker"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("issue"), F.lit("x < y").alias("description"))
    copies = many.withColumn("issue", F.lit("same"))
    no_gate = many.withColumn("gate", F.lit(None).cast("string"))
    odd = spark.createDataFrame([("b", None, "i", "d"), ("b", "c", None, "d"), ("b", "c", "i", None), ("b", "c2", "i", "d")], "gate string, checker string, issue string, description string")
    gaps = many.unionByName(copies).unionByName(no_gate).unionByName(odd).cache()
    xml = fl.checker_xml(gaps).select("gate", F.concat(F.lit("<Results>"), "xml", F.lit("</Results>")).alias("value")).cache()
    sizes = xml.select("gate", F.size(F.split("value", "<Issue")) - 1).collect()
    assert sum(n for _, n in sizes) == gaps.count() and max(n for _, n in sizes) <= 10_000
    assert [n for gate, n in sizes if gate == "b"] == [4]
    back = fl.checker_issues(xml).select(F.col("bundle").alias("gate"), "checker", "issue", "description")
    assert back.exceptAll(gaps).isEmpty() and gaps.exceptAll(back).isEmpty()
    one = xml.agg(F.array_join(F.collect_list(F.regexp_replace("value", "</?Results>", "")), "").alias("xml"))
    assert fl.checker_issues(one.select(F.concat(F.lit("<Results>"), "xml", F.lit("</Results>")).alias("value"))).count() == gaps.count()


def test_search_by_shapes_gives_all_rows(spark, db, tmp_path):
    from facetgraph.shape_queries import search_by_shapes

    n = 1_200
    db.sql(f"COPY (SELECT i AS c_custkey, 'c' || i AS c_name, (i % 25)::INTEGER AS c_nationkey, 6000.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range({n * 5}) r(i)) TO '{tmp_path}/customer.parquet'")
    for name in ("nation", "region"):
        db.sql(f"COPY (SELECT * FROM {name}) TO '{tmp_path}/{name}.parquet'")
    wanted = db.sql(queries.oracle_sql()["search_by_shapes"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'"))
    got = search_by_shapes(spark, str(tmp_path)).select(wanted.columns).collect()
    assert len(got) == n and plain(got) == plain(wanted.fetchall())
