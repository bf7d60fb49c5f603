"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph.catalog import Catalog, Domain, Interval, lifted_catalog
from facetgraph.functions import text as tx
from facetgraph.functions.sparql import encode_for_uri, sparql_round, strafter, strbefore
from facetgraph.operators import aggregates as ag
from facetgraph.operators import graph as gr
from facetgraph.operators import validate as vl
from facetgraph.plans.search import count_assets, lower, plan_search
from facetgraph.slots import parse_slots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def search(spark: SparkSession, d: str, request: dict, catalog: Catalog | None = None, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = lower(plan_search(parse_slots(request), catalog or lifted_catalog()), lambda n: t(spark, d, n), limit)
    return rows.select(columns) if columns else rows


# scans, filters


@query("SELECT c_custkey AS asset, c_name AS name FROM customer")
def domain_scan(spark, d):
    return search(spark, d, {"domains": ["customer"]})


@query("SELECT c_custkey AS asset, c_name AS name, c_mktsegment AS mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def enum_eq(spark, d):
    return search(spark, d, {"domains": ["Customer"], "filters": {"mktsegment": "BUILDING"}})


@query("SELECT o_orderkey AS asset, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def enum_in(spark, d):
    return search(spark, d, {"domains": ["orders"], "filters": {"orderpriority": ["1-URGENT", "2-HIGH"]}})


@query("SELECT p_partkey AS asset, p_name AS name, p_name AS \"partName\" FROM part WHERE contains(lower(p_name), 'widget')")
def ci_contains(spark, d):
    return search(spark, d, {"domains": ["part"], "filters": {"partName": "WIDGET"}})


@query("SELECT p_partkey AS asset, p_name AS name, p_name AS \"partName\" FROM part WHERE lower(p_name) IN ('small ring', 'red widget')")
def ci_in(spark, d):
    return search(spark, d, {"domains": ["part"], "filters": {"partName": ["Small Ring", "RED widget"]}})


@query("SELECT c_custkey AS asset, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal >= 5000")
def numeric_range_min(spark, d):
    return search(spark, d, {"domains": ["customer"], "ranges": {"acctbal": {"min": 5000}}})


@query("SELECT c_custkey AS asset, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal <= 0")
def numeric_range_max(spark, d):
    return search(spark, d, {"domains": ["customer"], "ranges": {"acctbal": {"max": 0}}})


@query("SELECT p_partkey AS asset, p_name AS name, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 20")
def numeric_range_both(spark, d):
    return search(spark, d, {"domains": ["part"], "ranges": {"size": {"min": 10, "max": 20}}})


@query("SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k >= 50")
def try_cast_range(spark, d):
    rows = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return rows.where("k >= 50")


@query("SELECT c_custkey AS asset, c_name AS name, c_acctbal AS acctbal FROM customer WHERE false")
def literal_against_number(spark, d):
    return search(spark, d, {"domains": ["customer"], "filters": {"acctbal": "0.1"}})


def _spans(spark, d):
    catalog = Catalog({"shipment": Domain("shipment", "shipments", "o", "o", intervals=(Interval("quantity", "low", "high"),))})
    spans = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return lower(plan_search(parse_slots({"domains": ["shipment"], "ranges": {"quantity": {"min": 45, "max": 48}}}), catalog), lambda n: spans)


@query("SELECT o AS asset, CAST(o AS VARCHAR) AS name, low AS quantity FROM (SELECT l_orderkey o, min(l_quantity) low, max(l_quantity) high FROM lineitem GROUP BY 1) WHERE high >= 45 AND low <= 48")
def interval_overlap(spark, d):
    return _spans(spark, d)


@query("SELECT c_custkey AS asset, c_name AS name FROM customer")
def empty_value_drop(spark, d):
    return search(spark, d, {"domains": ["customer"], "filters": {"mktsegment": "", "nation": []}})


# joins


@query("SELECT c_custkey AS asset, c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def deep_path_filter(spark, d):
    return search(spark, d, {"domains": ["customer"], "filters": {"region": "ASIA"}})


@query("SELECT c_custkey AS asset, c_name AS name, r_name AS region, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_name IN ('NATION_2', 'NATION_7', 'NATION_12')")
def shared_prefix(spark, d):
    return search(spark, d, {"domains": ["customer"], "filters": {"region": "ASIA", "nation": ["NATION_2", "NATION_7", "NATION_12"]}})


FLAGSHIP = {
    "domains": ["orders"],
    "filters": {"orderstatus": "F"},
    "ranges": {"totalprice": {"min": 100000}},
    "references": [{"domain": "customer", "filters": {"region": "ASIA"}}],
}


@query(
    "SELECT o_orderkey AS asset, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS orderstatus, o_totalprice AS totalprice, c_custkey AS \"refAsset\", c_name AS \"refName\", r_name AS ref_region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND r_name = 'ASIA'"
)
def reference_scoped(spark, d):
    return search(spark, d, FLAGSHIP)


@query("SELECT o_orderkey AS asset, CAST(o_orderkey AS VARCHAR) AS name, c_custkey AS \"refAsset\", c_name AS \"refName\" FROM orders JOIN customer ON o_custkey = c_custkey")
def reference_join(spark, d):
    return search(spark, d, {"domains": ["orders"], "references": [{"domain": "customer"}]})


@query("SELECT l_orderkey AS asset, CAST(l_orderkey AS VARCHAR) AS name, p_partkey AS \"refAsset\", p_name AS \"refName\", p_brand AS ref_brand, s_suppkey AS \"refAsset1\", s_name AS \"refName1\" FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand = 'Brand#2'")
def reference_two(spark, d):
    return search(spark, d, {"domains": ["lineitem"], "references": [{"domain": "part", "filters": {"brand": "Brand#2"}}, {"domain": "supplier"}]})


@query("SELECT l_orderkey AS asset, CAST(l_orderkey AS VARCHAR) AS name, l_returnflag AS returnflag, o_orderkey AS \"refAsset\", CAST(o_orderkey AS VARCHAR) AS \"refName\", c_custkey AS \"refAsset_0_0\", c_name AS \"refName_0_0\", c_mktsegment AS \"ref_0_0_mktsegment\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND c_mktsegment = 'MACHINERY'")
def reference_nested(spark, d):
    return search(spark, d, {"domains": ["lineitem"], "filters": {"returnflag": "R"}, "references": [{"domain": "orders", "references": [{"domain": "customer", "filters": {"mktsegment": "MACHINERY"}}]}]})


@query("SELECT o_orderkey AS asset, CAST(o_orderkey AS VARCHAR) AS name, c_custkey AS \"refAsset\", c_name AS \"refName\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_name), '00001')")
def reference_label(spark, d):
    return search(spark, d, {"domains": ["orders"], "references": [{"domain": "customer", "label": "00001"}]})


@query("SELECT o_orderkey AS asset, CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS orderstatus, c_custkey AS \"refAsset\", c_name AS \"refName\", c_mktsegment AS ref_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'AUTOMOBILE'")
def implicit_reference(spark, d):
    return search(spark, d, {"domains": ["customer", "orders"], "filters": {"orderstatus": "O", "mktsegment": "AUTOMOBILE"}})


@query("SELECT e.event_id, e.user_id, c.c_name AS name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def optional_join(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return t(spark, d, "events").join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_unresolved(spark, d):
    return vl.unresolved(t(spark, d, "customer"), "c_custkey", t(spark, d, "orders").where("o_totalprice > 400000"), "o_custkey").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_3')")
def values_join(spark, d):
    v = spark.createDataFrame([("NATION_1",), ("NATION_3",)], "n_name string")
    return t(spark, d, "nation").join(F.broadcast(v), "n_name").select("n_nationkey", "n_name")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark, d):
    return vl.duplicates(t(spark, d, "part").select(F.col("p_name").alias("name")), "name")


@query("SELECT a.n_name AS source, b.n_name AS target FROM nation a CROSS JOIN nation b WHERE a.n_name <> b.n_name")
def open_leaf_fanout(spark, d):
    n = t(spark, d, "nation")
    return n.select(F.col("n_name").alias("source")).crossJoin(n.select(F.col("n_name").alias("target"))).where("source <> target")


NAMESPACES = {"http://www.": "www", "http://": "plain", "https://blog.": "blog", "https://": "secure", "https://www.": "wwws"}


@query(
    "SELECT page_id, CASE WHEN starts_with(url, 'https://blog.') THEN 'https://blog.' WHEN starts_with(url, 'https://www.') THEN 'https://www.' WHEN starts_with(url, 'http://www.') THEN 'http://www.' WHEN starts_with(url, 'https://') THEN 'https://' WHEN starts_with(url, 'http://') THEN 'http://' END AS namespace, CASE WHEN starts_with(url, 'https://blog.') THEN 'blog' WHEN starts_with(url, 'https://www.') THEN 'wwws' WHEN starts_with(url, 'http://www.') THEN 'www' WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' END AS prefix_domain FROM pages"
)
def longest_namespace(spark, d):
    return gr.longest_prefix(t(spark, d, "pages").select("page_id", "url"), "url", NAMESPACES).drop("url")


# unions, cross-domain, limits, counts


@query(
    "SELECT c_custkey AS asset, c_name AS name, n_name AS nation, 'customer' AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5' UNION ALL SELECT s_suppkey, s_name, n_name, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_5'"
)
def peer_union(spark, d):
    return search(spark, d, {"domains": ["customer", "supplier"], "filters": {"nation": "NATION_5"}})


@query("SELECT c_custkey AS asset, c_name AS name, c_mktsegment AS mktsegment FROM customer WHERE c_mktsegment = 'FURNITURE'")
def peer_union_pruned(spark, d):
    return search(spark, d, {"domains": ["customer", "supplier"], "filters": {"mktsegment": "FURNITURE"}}, columns=["asset", "name", "mktsegment"])


@query(
    "SELECT 'nation' AS domain, n_nationkey AS asset, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' UNION ALL SELECT 'customer', c_custkey, c_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' UNION ALL SELECT 'supplier', s_suppkey, s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"
)
def cross_domain_optional(spark, d):
    return search(spark, d, {"domains": [], "filters": {"region": "EUROPE"}})


@query("SELECT asset, name FROM (SELECT l_orderkey AS asset, CAST(l_orderkey AS VARCHAR) AS name FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 100)) ORDER BY 1, 2 LIMIT 500")
def distinct_asset_limit(spark, d):
    return search(spark, d, {"domains": ["lineitem"]}, limit=100)


def _plan(request):
    return plan_search(parse_slots(request), lifted_catalog())


@query("SELECT 'customer' AS domain, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5' UNION ALL SELECT 'supplier', count(DISTINCT s_suppkey) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_5' HAVING count(DISTINCT s_suppkey) > 0")
def count_by_domain(spark, d):
    return count_assets(_plan({"domains": ["customer", "supplier"], "filters": {"nation": "NATION_5"}}), lambda n: t(spark, d, n))


@query("SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS BIGINT) AS total")
def total_assets(spark, d):
    parts = [count_assets(_plan({"domains": [n]}), lambda x: t(spark, d, x)) for n in ("region", "nation", "customer", "supplier", "part", "orders")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(F.sum("n").alias("total"))


@query("SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3'")
def match_count(spark, d):
    return search(spark, d, {"domains": ["lineitem"], "references": [{"domain": "part", "filters": {"brand": "Brand#3"}}]}).agg(F.countDistinct("asset").alias("n"))


# facets and aggregates

_FACETS = "SELECT property, value, datatype, count(*) AS n FROM (SELECT 'c_mktsegment' AS property, c_mktsegment AS value, 'string' AS datatype FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), 'int' FROM customer) WHERE value IS NOT NULL GROUP BY 1, 2, 3"


@query(_FACETS)
def facet_values(spark, d):
    return ag.facets(t(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(
    f"WITH f AS ({_FACETS}), r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY n DESC, value, datatype) AS k FROM f) SELECT property, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_values, CASE WHEN bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN min(TRY_CAST(value AS DOUBLE)) END AS min_value, CASE WHEN bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN max(TRY_CAST(value AS DOUBLE)) END AS max_value, string_agg(value || '=' || n, ',' ORDER BY k) FILTER (k <= 12) AS top FROM r GROUP BY 1"
)
def facet_distribution(spark, d):
    return ag.distribution(ag.facets(t(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"]))


@query("SELECT p_brand AS brand, p_type AS type, n, rank FROM (SELECT p_brand, p_type, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank FROM part GROUP BY 1, 2) WHERE rank <= 2")
def facet_topk(spark, d):
    counts = t(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(F.count("*").alias("n"))
    return ag.top_per_key(counts, ["brand"], 2, F.col("n").desc(), "type")


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders")
def numeric_range_stats(spark, d):
    return t(spark, d, "orders").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_p50_p95(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(ag.nearest_rank("value", 0.5).alias("p50"), ag.nearest_rank("value", 0.95).alias("p95"))


@query("WITH m AS (SELECT event_type, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1) SELECT e.event_type, any_value(m.median) AS median, round(quantile_disc(abs(e.value - m.median), 0.5), 6) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1")
def mad(spark, d):
    return ag.median_deviation(t(spark, d, "events"), ["event_type"], "value").withColumn("mad", F.round("mad", 6))


@query(
    "SELECT d.source, round(sum(CASE WHEN quality = 1 AND n_chars > 1000 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END), 0), 6) AS \"precision\", round(sum(CASE WHEN quality = 1 AND n_chars > 1000 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0), 6) AS recall FROM labels l JOIN documents d USING (doc_id) GROUP BY 1"
)
def precision_recall(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    said, good = F.col("n_chars") > 1000, F.col("quality") == 1
    counts = rows.select("source", (said & good).cast("int").alias("tp"), (said & ~good).cast("int").alias("fp"), (~said & good).cast("int").alias("fn"))
    return ag.precision_recall(counts, ["source"]).select("source", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT word, round(avg(p_retailprice), 6) AS mean, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_retailprice FROM part) GROUP BY 1")
def category_means(spark, d):
    rows = t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"), "p_retailprice")
    return rows.groupBy("word").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.count("*").alias("n"))


@query("WITH b AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k FROM b WHERE best - p_retailprice <= 50 + 1e-12) SELECT p_brand, p_partkey, p_retailprice, p_size FROM r WHERE k = 1")
def tier_winner(spark, d):
    return ag.shortlist_winner(t(spark, d, "part"), "p_brand", "p_retailprice", "p_size", "p_partkey", 50)


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS second FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type)) SELECT user_id, event_type, n, n - coalesce(second, 0) AS margin FROM r WHERE k = 1")
def runner_up_margin(spark, d):
    counts = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ag.runner_up_margin(counts, ["user_id"], "event_type", "n")


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def consecutive_gap(spark, d):
    rows = ag.consecutive(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"])
    return rows.select("event_id", "user_id", F.round(F.col("value") - F.col("prev_value"), 6).alias("step"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_per_key(spark, d):
    return ag.first_per_key(t(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query()
def cumulative_budget(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_partkey", F.length("p_name").cast("bigint").alias("size"))
    return ag.budgeted(rows, ["p_brand"], ["p_partkey"], "size", 200)


@query("SELECT r_name, repetition FROM region CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS repetition)")
def round_robin(spark, d):
    return ag.round_robin(t(spark, d, "region").select("r_name"), 3)


@query("SELECT n_regionkey, mode_value FROM (SELECT n_regionkey, c_mktsegment AS mode_value, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE k = 1")
def mode_per_group(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy("n_regionkey", F.col("c_mktsegment").alias("mode_value")).agg(F.count("*").alias("n"))
    return ag.first_per_key(counts, ["n_regionkey"], F.col("n").desc(), "mode_value").select("n_regionkey", "mode_value")


# sets


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def minus_shared(spark, d):
    return ag.minus(t(spark, d, "customer").select(F.col("c_custkey").alias("k")), t(spark, d, "events").select(F.col("user_id").alias("k")))


@query("SELECT r_name FROM region")
def minus_disjoint(spark, d):
    return ag.minus(t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


# graphs: documents of one source follow each other; nations lie in regions

_HIERARCHY = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"


def hierarchy(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"))
    r = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("src"), F.lit("world").alias("dst"))
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return n.unionByName(r).unionByName(c)


_CLOSURE = f"WITH RECURSIVE e AS ({_HIERARCHY}), p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)"


@query(f"{_CLOSURE} SELECT src, dst FROM p UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e")
def closure_reflexive(spark, d):
    return gr.closure(hierarchy(spark, d))


@query(f"{_CLOSURE} SELECT src AS node, count(*) AS ancestors FROM p GROUP BY 1")
def ancestor_closure(spark, d):
    return gr.closure(hierarchy(spark, d), reflexive=False).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ancestors"))


@query(f"{_CLOSURE} SELECT DISTINCT c_custkey, c_name FROM customer WHERE 'n' || c_nationkey IN (SELECT src FROM p WHERE dst = 'r2')")
def semi_closure(spark, d):
    inside = gr.closure(hierarchy(spark, d)).where("dst = 'r2'").select("src")
    return t(spark, d, "customer").join(F.broadcast(inside), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")) == F.col("src"), "left_semi").select("c_custkey", "c_name")


@query(f"WITH e AS ({_HIERARCHY}) SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src")
def sequence_path(spark, d):
    e = hierarchy(spark, d)
    return gr.sequence(e, e)


@query(f"{_CLOSURE} SELECT DISTINCT p.dst AS root, p.src AS leaf FROM p WHERE p.src NOT IN (SELECT dst FROM e) UNION SELECT src, src FROM e WHERE src NOT IN (SELECT dst FROM e)")
def leaf_descendants(spark, d):
    return gr.leaf_descendants(hierarchy(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(
    f"WITH e AS (SELECT DISTINCT * FROM ({_HIERARCHY})), l0 AS (SELECT src AS root, src AS node, 0 AS depth FROM e WHERE starts_with(src, 'c')), l1 AS (SELECT root, dst AS node, 1 AS depth FROM l0 JOIN e ON node = src), l2 AS (SELECT root, dst AS node, 2 AS depth FROM l1 JOIN e ON node = src), u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) SELECT root, node, depth, depth = 2 AND node IN (SELECT src FROM e) AS truncated FROM u"
)
def lineage_depth2(spark, d):
    e = hierarchy(spark, d)
    return gr.lineage(e, e.where("src like 'c%'").select(F.col("src").alias("n")), 2).select("root", "node", "depth", "truncated")


@query(f"{_CLOSURE}, l AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src UNION ALL SELECT src, src, 0 FROM e) SELECT src AS root, dst AS node, min(depth) AS depth FROM l WHERE starts_with(src, 'c') GROUP BY 1, 2")
def lineage_shallowest(spark, d):
    e = hierarchy(spark, d)
    return gr.shallowest(gr.lineage(e, e.where("src like 'c%'").select(F.col("src").alias("n")), 3)).select("root", "node", "depth")


@query("SELECT 'L' || conv_id AS head, CAST(turn AS INTEGER) AS position, role AS value FROM conversations")
def list_members(spark, d):
    c = t(spark, d, "conversations")
    cell = lambda turn: F.when(turn == 0, F.concat(F.lit("L"), F.col("conv_id").cast("string"))).otherwise(F.concat_ws("_", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string")))
    rest = c.where("turn > 0").select(cell(F.col("turn") - 1).alias("src"), cell(F.col("turn")).alias("dst"))
    first = c.select(cell(F.col("turn")).alias("cell"), F.col("role").alias("value"))
    return gr.list_members(rest, first).where("head like 'L%'")


@query("SELECT source, target, edge, length FROM (SELECT s.source, s.target, s.edge, s.length, row_number() OVER (PARTITION BY s.source, s.target ORDER BY CASE WHEN s.edge = 'o_custkey' THEN 1 ELSE 0 END DESC, CASE WHEN s.edge IN ('o_custkey', 'l_suppkey', 'l_partkey') THEN 1 ELSE 0 END DESC, s.length, s.edge) AS k FROM (VALUES ('orders', 'customer', 'o_clerk', 1), ('orders', 'customer', 'o_custkey', 2), ('lineitem', 'party', 'l_broker', 1), ('lineitem', 'party', 'l_suppkey', 3), ('lineitem', 'party', 'l_partkey', 3)) s(source, target, edge, length)) WHERE k = 1")
def live_edge_pick(spark, d):
    candidates = spark.createDataFrame([("orders", "customer", "o_clerk", 1), ("orders", "customer", "o_custkey", 2), ("lineitem", "party", "l_broker", 1), ("lineitem", "party", "l_suppkey", 3), ("lineitem", "party", "l_partkey", 3)], "source string, target string, edge string, length int")
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    used = o.agg(F.count("o_custkey").alias("o_custkey")).crossJoin(li.agg(F.count("l_suppkey").alias("l_suppkey"), F.count("l_partkey").alias("l_partkey"))).unpivot([], ["o_custkey", "l_suppkey", "l_partkey"], "edge", "n").where("n > 0")
    hits = o.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("o_custkey").alias("edge"), F.lit("customer").alias("target"))
    return gr.pick_edge(candidates, used, hits)


@query("SELECT 'lineitem' AS source, 'l_partkey' AS edge, count(l_partkey) AS n, count(DISTINCT l_partkey) AS targets FROM lineitem UNION ALL SELECT 'orders', 'o_custkey', count(o_custkey), count(DISTINCT o_custkey) FROM orders")
def edge_usage(spark, d):
    use = lambda table, edge: t(spark, d, table).agg(F.count(edge).alias("n"), F.countDistinct(edge).alias("targets")).select(F.lit(table).alias("source"), F.lit(edge).alias("edge"), "n", "targets")
    return use("lineitem", "l_partkey").unionByName(use("orders", "o_custkey"))


@query("SELECT c_custkey AS asset, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'")
def concept_expand_filter(spark, d):
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()  # a catalog: nations
    concepts: dict[str, list[str]] = {}
    for r in rows:
        concepts.setdefault(r[0].lower(), []).append(r[1])
    base = lifted_catalog()
    catalog = Catalog(base.domains, {"nation": {k: tuple(sorted(v)) for k, v in concepts.items()}}, base.parents)
    return search(spark, d, {"domains": ["customer"], "filters": {"nation": "Africa"}}, catalog)


# text

_TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ('a','an','and','are','for','in','is','of','on','or','the','to','with'))"
_TRI = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"
_DICE = "2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1}))"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY 1")
def tokenize_count(spark, d):
    return t(spark, d, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 3), lambda x: CASE WHEN x LIKE '%s' AND length(x) > 3 THEN [x, x[:-2]] ELSE [x] END)))) AS token FROM part) GROUP BY 1")
def stem_tokens(spark, d):
    return t(spark, d, "part").select(F.explode(tx.stem_tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, {_TRI.format('p_name')} AS a, {_TRI.format(chr(39) + 'red widget' + chr(39))} AS b FROM p) SELECT p_name, round({_DICE.format('a', 'b')}, 6) AS dice FROM w")
def trigram_dice(spark, d):
    return t(spark, d, "part").select("p_name").distinct().select("p_name", F.round(tx.dice(F.col("p_name"), F.lit("red widget")), 6).alias("dice"))


@query("SELECT p_name, levenshtein(p_name, 'red widgets') AS distance, round(1 - levenshtein(p_name, 'red widgets')::DOUBLE / greatest(length(p_name), 11), 6) AS similarity FROM (SELECT DISTINCT p_name FROM part)")
def levenshtein_sim(spark, d):
    words = t(spark, d, "part").select("p_name").distinct()
    return words.select("p_name", F.levenshtein("p_name", F.lit("red widgets")).cast("bigint").alias("distance"), F.round(tx.similarity(F.col("p_name"), F.lit("red widgets")), 6).alias("similarity"))


@query(
    f"WITH q AS (SELECT unnest(['red', 'widgt']) AS t), f AS (SELECT DISTINCT p_name, unnest({_TOKENS.format('p_name')}) AS w FROM part), m AS (SELECT p_name, t, max(CASE WHEN t = w THEN 1.0 WHEN length(t) >= 3 AND length(w) >= 3 AND (starts_with(w, t) OR starts_with(t, w)) THEN 0.7 WHEN {_DICE.format(_TRI.format('t'), _TRI.format('w'))} >= 0.5 THEN 0.7 * ({_DICE.format(_TRI.format('t'), _TRI.format('w'))}) ELSE 0.0 END) AS s FROM f CROSS JOIN q GROUP BY 1, 2), s AS (SELECT p_name, round(avg(s), 6) AS score FROM m GROUP BY 1) SELECT p_name, score FROM s ORDER BY score DESC, p_name LIMIT 10"
)
def lexical_rank(spark, d):
    words = t(spark, d, "part").select("p_name").distinct()
    return lexical_ranking(words, "p_name", "red widgt", 10)


def lexical_ranking(rows: DataFrame, label: str, text: str, k: int) -> DataFrame:
    """The k best labels: the mean over the query's tokens of the best match of any token of the label."""
    q = tx.tokens(F.lit(text))
    best = F.transform(q, lambda a: F.coalesce(F.array_max(F.transform(tx.tokens(F.col(label)), lambda b: tx.token_match(a, b))), F.lit(0.0)))
    score = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q)
    return rows.select(label, F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), label).limit(k)


@query("WITH v AS (SELECT DISTINCT p_name AS allowed FROM part), q(query) AS (VALUES ('RED WIDGET'), ('redd widget'), ('zzz')), s AS (SELECT query, allowed, CASE WHEN lower(query) = lower(allowed) THEN 1.0 ELSE 1 - levenshtein(lower(query), lower(allowed))::DOUBLE / greatest(length(query), length(allowed)) END AS sim FROM q CROSS JOIN v), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, allowed) AS k FROM s) SELECT query, CASE WHEN sim >= 0.8 THEN allowed END AS matched, round(CASE WHEN sim >= 0.8 THEN sim ELSE 0.0 END, 6) AS similarity, CASE WHEN sim = 1 THEN 'high' WHEN sim >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1")
def best_match(spark, d):
    asked = spark.createDataFrame([("RED WIDGET",), ("redd widget",), ("zzz",)], "query string")
    return vl.best_match(asked, t(spark, d, "part").select(F.col("p_name").alias("allowed"))).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH v AS (SELECT DISTINCT p_name AS suggestion FROM part), q(query) AS (VALUES ('red widgit'), ('smal rings'), ('of a')),
k AS (SELECT query, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('a','an','the','and','or','of','for','from','to','in','on','at','by','with','without','is','are','was','were','be','that','this','these','those','der','die','das','und','oder','mit','ohne','aus','von','zu')) AS toks FROM q),
p AS (SELECT query, unnest(CASE WHEN len(toks) = 0 THEN [lower(query)] ELSE toks END) AS tok, len(toks) > 0 AS stems FROM k),
c AS (SELECT query, tok, stems, regexp_replace(tok, '(ies|es|s)$', '') AS stem, suggestion, lower(suggestion) AS w FROM p CROSS JOIN v),
s AS (SELECT query, suggestion, max(greatest(1 - levenshtein(tok, w)::DOUBLE / greatest(length(tok), length(w)), CASE WHEN stems AND (contains(w, stem) OR contains(stem, w)) THEN least(length(stem), length(w))::DOUBLE / greatest(length(stem), length(w)) ELSE 0.0 END)) AS score FROM c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, suggestion) AS INTEGER) AS rank FROM s WHERE score >= 0.5)
SELECT query, suggestion, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)
def suggestions(spark, d):
    asked = spark.createDataFrame([("red widgit",), ("smal rings",), ("of a",)], "query string")
    found = vl.suggestions(asked, t(spark, d, "part").select(F.col("p_name").alias("suggestion")))
    return found.withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    e = t(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine")).orderBy(F.col("cosine").desc(), "vec_id").limit(20)


@query("SELECT vec_id, round(0.5 * (1.0 / (1 + label)) + 0.5 * list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 5) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 15")
def hybrid_rerank(spark, d):
    e = t(spark, d, "embeddings")
    probe = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    score = 0.5 * (1.0 / (1 + F.col("label"))) + 0.5 * tx.cosine(F.col("embedding"), F.col("q"))
    return e.crossJoin(F.broadcast(probe)).select("vec_id", F.round(score, 5).alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(15)


@query(r"SELECT page_id, regexp_extract(url, '([^#/]*)$', 1) AS local, regexp_extract(url, '^(.*[#/])', 1) AS ns, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\x22{}|\\^`]*$') AS plain FROM pages")
def iri_parts(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", tx.local_name(u).alias("local"), tx.namespace(u).alias("ns"), tx.is_plain_iri(u).alias("plain"))


@query(r"SELECT DISTINCT p_type, lower(regexp_replace(regexp_replace(trim(p_type), '([a-z0-9])([A-Z])', '\1-\2', 'g'), '[\s_]+', '-', 'g')) AS kebab, list_aggregate(list_transform(list_filter(regexp_split_to_array(p_type, '[-_\s]+'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS pascal, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS graphql FROM part")
def name_forms(spark, d):
    p = t(spark, d, "part")
    return p.select("p_type", tx.kebab(F.col("p_type")).alias("kebab"), tx.pascal(F.col("p_type")).alias("pascal"), tx.graphql_name(F.col("p_brand")).alias("graphql")).distinct()


@query("SELECT event_id, round(value - 2 * pi() * ceil((value - pi()) / (2 * pi())), 6) AS angle FROM events")
def normal_angle(spark, d):
    return t(spark, d, "events").select("event_id", F.round(tx.normal_angle(F.col("value")), 6).alias("angle"))


@query("SELECT DISTINCT p_name, CASE WHEN strpos(p_name, ' ') > 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS before, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS after, replace(p_name, ' ', '%20') AS encoded, md5(p_name) AS md5, sha256(p_name) AS sha256, CAST(floor(length(p_name) / 2.0 + 0.5) AS BIGINT) AS half FROM part")
def sparql_strings(spark, d):
    p = F.col("p_name")
    return t(spark, d, "part").select("p_name", strbefore(p, F.lit(" ")).alias("before"), strafter(p, F.lit(" ")).alias("after"), encode_for_uri(p).alias("encoded"), F.md5(p).alias("md5"), F.sha2(p, 256).alias("sha256"), sparql_round(F.length(p) / 2.0).cast("bigint").alias("half")).distinct()


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi FROM events")
def sparql_dates(spark, d):
    return t(spark, d, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"))


@query("SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 1), '[=+@\\t\\r\\n-]') THEN '''' || text ELSE text END AS safe FROM documents")
def csv_safe(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.csv_safe(F.col("text")).alias("safe"))


# validation

_SHAPES = {
    ("customer", "c_mktsegment"): vl.Shape(allowed=("BUILDING", "MACHINERY")),
    ("supplier", "c_mktsegment"): vl.Shape(allowed=("HOUSEHOLD",)),
    ("customer", "c_name"): vl.Shape(pattern="^Customer#[0-9]{8}[02468]$"),
}


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS conforms FROM customer")
def shacl_in(spark, d):
    return t(spark, d, "customer").select("c_custkey", vl.conforms(F.col("c_mktsegment"), vl.Shape(allowed=("BUILDING", "MACHINERY"))).alias("conforms"))


@query("SELECT p_partkey, regexp_matches(p_brand, '^Brand#[1-9]$') AS conforms FROM part")
def shacl_pattern(spark, d):
    return t(spark, d, "part").select("p_partkey", vl.conforms(F.col("p_brand"), vl.Shape(pattern="^Brand#[1-9]$")).alias("conforms"))


@query("SELECT DISTINCT v AS value, regexp_matches(v, '^[+-]?[0-9]+$') AS as_integer, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN NULL ELSE 'decimal' END AS viable FROM (SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) || '.5' FROM part)")
def shacl_datatype(spark, d):
    p = t(spark, d, "part").select(F.col("p_size").cast("string").alias("value"))
    both = p.unionByName(p.select(F.concat("value", F.lit(".5")).alias("value"))).distinct()
    return both.select("value", vl.conforms(F.col("value"), vl.Shape(datatype="integer")).alias("as_integer"), vl.viable_datatype(F.col("value"), ("integer", "decimal")).alias("viable"))


@query("SELECT p_partkey, p_size >= 5 AND p_size < 30 AND NOT p_size = 7 AS conforms FROM part")
def shacl_range(spark, d):
    shape = vl.Shape(min_inclusive=5, max_exclusive=30, none_of=(vl.Shape(allowed=("7",)),))
    return t(spark, d, "part").select("p_partkey", vl.conforms(F.col("p_size").cast("string"), shape).alias("conforms"))


@query("SELECT p_partkey, (length(p_name) >= 10) <> (p_name LIKE 'red%') AS one_of, length(p_name) >= 10 OR p_name LIKE 'red%' AS any_of FROM part")
def shacl_logic(spark, d):
    parts = (vl.Shape(min_length=10), vl.Shape(pattern="^red"))
    return t(spark, d, "part").select("p_partkey", vl.conforms(F.col("p_name"), vl.Shape(one_of=parts)).alias("one_of"), vl.conforms(F.col("p_name"), vl.Shape(any_of=parts)).alias("any_of"))


@query("SELECT o_custkey, count(o_orderkey) AS n, count(o_orderkey) BETWEEN 5 AND 15 AS conforms FROM orders GROUP BY 1")
def shacl_cardinality(spark, d):
    return vl.cardinality(t(spark, d, "orders"), "o_custkey", "o_orderkey", 5, 15)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax")
def shacl_less_than(spark, d):
    return vl.ordered_pair(t(spark, d, "lineitem"), "l_discount", "l_tax").select("l_orderkey", "l_linenumber")


@query("SELECT 'c_mktsegment' AS property, c_mktsegment AS value, c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS conforms FROM customer UNION ALL SELECT 'c_name', c_name, regexp_matches(c_name, '^Customer#[0-9]{8}[02468]$') FROM customer UNION ALL SELECT 'other', c_name, true FROM customer")
def batch_validate(spark, d):
    c = t(spark, d, "customer")
    part = lambda name, column: c.select(F.lit(name).alias("property"), F.col(column).alias("value"))
    return vl.validate(part("c_mktsegment", "c_mktsegment").unionByName(part("c_name", "c_name")).unionByName(part("other", "c_name")), _SHAPES)


@query("SELECT event_type AS property, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def gap_report(spark, d):
    return vl.gap_report(t(spark, d, "events").select(F.col("event_type").alias("property")), spark.createDataFrame([("click",), ("view",)], "property string"))


@query("SELECT event_id, concat_ws(',', CASE WHEN value > 50 THEN 'high' END, CASE WHEN user_id < 10 THEN 'low_user' END) AS reasons FROM events")
def comparability(spark, d):
    return t(spark, d, "events").select("event_id", vl.comparability({"high": F.col("value") > 50, "low_user": F.col("user_id") < 10}).alias("reasons"))


@query(
    "WITH g AS (SELECT user_id, event_id, value / 10 AS hdg, 0.0 AS c0, value / 1000 AS c1 FROM events), p AS (SELECT user_id, event_id, hdg - lag(hdg + (c0 + c1) / 2 * 2.0) OVER w AS bend, abs(c0 - lag(c1) OVER w) AS kink FROM g WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(abs(bend - 2 * pi() * ceil((bend - pi()) / (2 * pi()))), 6) AS g1_gap, round(kink, 6) AS g2_gap, abs(bend - 2 * pi() * ceil((bend - pi()) / (2 * pi()))) > 0.001 AS g1_break, kink > 0.001 AS g2_break FROM p WHERE bend IS NOT NULL"
)
def continuity_gate(spark, d):
    g = t(spark, d, "events").select("user_id", "event_id", (F.col("value") / 10).alias("hdg"), F.lit(0.0).alias("curv_start"), (F.col("value") / 1000).alias("curv_end"), F.lit(2.0).alias("length"))
    return vl.continuity(g, "user_id", "event_id")


# shapes of results


@query("SELECT o_custkey AS asset, min(o_orderstatus) AS status, count(DISTINCT l_partkey) AS parts, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def group_asset_tree(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("asset")).agg(F.min("o_orderstatus").alias("status"), F.countDistinct("l_partkey").alias("parts"), F.array_join(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))), ",").alias("orders"))


@query("SELECT c_custkey AS asset, concat_ws(' > ', c_name, n_name, r_name) AS trail FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def breadcrumb(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(F.col("c_custkey").alias("asset"), F.concat_ws(" > ", "c_name", "n_name", "r_name").alias("trail"))


@query("SELECT column_name, CASE WHEN kind IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN kind = 'DOUBLE' THEN 'float' WHEN n <= 5 THEN 'enum' ELSE 'string' END AS vocabulary FROM (VALUES ('c_custkey', 'BIGINT', (SELECT count(DISTINCT c_custkey) FROM customer)), ('c_name', 'VARCHAR', (SELECT count(DISTINCT c_name) FROM customer)), ('c_nationkey', 'INTEGER', 0), ('c_acctbal', 'DOUBLE', 0), ('c_mktsegment', 'VARCHAR', (SELECT count(DISTINCT c_mktsegment) FROM customer))) v(column_name, kind, n)")
def vocabulary_projection(spark, d):
    c = t(spark, d, "customer")
    kinds = F.create_map(*[F.lit(x) for pair in c.dtypes for x in pair])
    counts = c.agg(*[F.countDistinct(n).alias(n) for n in c.columns]).unpivot([], c.columns, "column_name", "n")
    kind = F.element_at(kinds, F.col("column_name"))
    return counts.select("column_name", F.when(kind.isin("int", "bigint"), "integer").when(kind == "double", "float").when(F.col("n") <= 5, "enum").otherwise("string").alias("vocabulary"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return reference_scoped(spark, d)
