"""Registered queries of ranking, routing and choice, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetgraph.operators import ranking as rk
from facetgraph.queries import _DICE, _TOKENS, _TRI, query, t

_MATCH = f"CASE WHEN t = w THEN 1.0 WHEN length(t) >= 3 AND length(w) >= 3 AND (starts_with(w, t) OR starts_with(t, w)) THEN 0.7 WHEN {_DICE.format(_TRI.format('t'), _TRI.format('w'))} >= 0.5 THEN 0.7 * ({_DICE.format(_TRI.format('t'), _TRI.format('w'))}) ELSE 0.0 END"
_ASKED = _TOKENS.format("'economy red widgt brand'")
_CARDS = f"""WITH c AS (SELECT p_type AS domain, p_name AS iri, p_brand AS brand, min(p_size) AS place FROM part GROUP BY 1, 2, 3),
q AS (SELECT unnest({_ASKED}) AS t),
f AS (SELECT domain, iri, brand, unnest({_TOKENS.format('iri')}) AS w, 1.0 AS wt FROM c UNION ALL SELECT domain, iri, brand, unnest({_TOKENS.format('brand')}), 0.7 FROM c UNION ALL SELECT domain, iri, brand, unnest({_TOKENS.format('domain')}), 0.4 FROM c),
m AS (SELECT domain, iri, brand, t, max(wt * ({_MATCH})) AS s FROM f CROSS JOIN q GROUP BY 1, 2, 3, 4),
r AS (SELECT domain, iri, brand, sum(s) / (SELECT count(*) FROM q) AS score FROM m GROUP BY 1, 2, 3)"""


def cards(spark, d):
    rows = t(spark, d, "part").groupBy(F.col("p_type").alias("domain"), F.col("p_name").alias("iri"), F.col("p_brand").alias("brand")).agg(F.min("p_size").alias("place"))
    return rows.select("domain", "iri", "brand", "place", F.array("iri").alias("labels"), F.array("brand").alias("allowed"), F.col("domain").alias("description"))


@query(f"{_CARDS} SELECT domain, iri, brand, round(score, 6) AS score FROM r WHERE score > 0.2")
def rank_cards(spark, d):
    return rk.rank_cards(cards(spark, d), "economy red widgt brand", 0.2).select("domain", "iri", "brand", F.round("score", 6).alias("score"))


@query(f"{_CARDS}, k AS (SELECT domain, 'property' AS kind, iri || brand AS iri, 0 AS tier, -round(score, 6) AS a, 0.0 AS b FROM r WHERE score > 0.4 AND domain IN ('ECONOMY', 'PROMO') UNION ALL SELECT domain, 'property', iri || brand, 1, CASE domain WHEN 'PROMO' THEN 1 ELSE 2 END, place FROM c WHERE domain IN ('PROMO', 'ECONOMY')), o AS (SELECT *, row_number() OVER (PARTITION BY domain, kind, iri ORDER BY tier, a, b) AS n FROM k) SELECT domain, kind, iri, CAST(row_number() OVER (ORDER BY tier, a, b, domain, iri) AS INTEGER) AS position FROM o WHERE n = 1 ORDER BY tier, a, b, domain, iri LIMIT 60")
def budgeted_cards(spark, d):
    named = cards(spark, d).withColumn("kind", F.lit("property"))
    ranked = rk.rank_cards(named, "economy red widgt brand", 0.4).withColumn("score", F.round("score", 6))
    whole = F.concat("iri", "brand")
    return rk.select_cards(ranked.withColumn("iri", whole), named.withColumn("iri", whole), ["PROMO", "ECONOMY"], 60)


@query(f"WITH q AS (SELECT unnest({_TOKENS.format(chr(39) + 'asia nation rings' + chr(39))}) AS t), f AS (SELECT r_name AS domain, unnest({_TOKENS.format('r_name')}) AS w, 1.0 AS wt FROM region UNION ALL SELECT r_name, unnest({_TOKENS.format('n_name')}), 0.7 FROM region JOIN nation ON n_regionkey = r_regionkey), m AS (SELECT domain, t, max(wt * ({_MATCH})) AS s FROM f CROSS JOIN q GROUP BY 1, 2) SELECT domain, round(sum(s) / (SELECT count(*) FROM q), 6) AS score FROM m GROUP BY 1 HAVING sum(s) > 0")
def rank_domains(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("samples"))
    catalog = t(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("domain"), F.lit(None).cast("array<string>").alias("labels"), "samples")
    return rk.rank_domains(catalog, "asia nation rings").withColumn("score", F.round("score", 6))


_PREFER = "WITH q AS (SELECT ['economies', 'economie', 'for', 'promotion', 'rings', 'ring'] AS asked), d AS (SELECT DISTINCT p_type AS domain FROM part), s AS (SELECT domain, CAST(CASE WHEN list_contains(asked, lower(domain)) THEN 3 WHEN len(list_filter(asked, lambda x: contains(x, lower(domain)) OR contains(lower(domain), x))) > 0 THEN 2 ELSE 0 END AS INTEGER) AS score FROM d, q), b AS (SELECT list(score ORDER BY score DESC) AS l FROM s)"


@query(f"{_PREFER} SELECT domain, score, NOT (l[1] > 0 AND l[1] - l[2] >= 2) OR score = l[1] AS kept FROM s, b")
def prefer_domains(spark, d):
    return rk.prefer_domains(t(spark, d, "part").select(F.col("p_type").alias("domain")), "economies for promotion rings")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'seg:' || c_mktsegment WHEN c_custkey % 3 = 1 THEN 'base:other' || c_custkey ELSE '<http://ex.test/ns/v1/' || c_name || '>' END AS short FROM customer")
def compact_iris(spark, d):
    iri = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("http://ex.test/ns/v1/seg/"), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("http://ex.test/ns/v1/other"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("http://ex.test/ns/v1/"), "c_name"))
    return t(spark, d, "customer").select("c_custkey", rk.compact_iri(iri, {"http://ex.test/ns/v1/": "base", "http://ex.test/ns/v1/seg/": "seg"}).alias("short"))


_AXES = ", ".join(f"min({c}) AS min_{n}, max({c}) AS max_{n}, round((min({c}) + max({c})) / 2, 4) AS center_{n}, round(max({c}) - min({c}), 4) AS size_{n}, round(avg({c}), 4) AS mean_{n}" for c, n in (("value", "x"), ("user_id::DOUBLE", "y"), ("event_id::DOUBLE", "z")))


@query(f"SELECT event_type, {_AXES} FROM events GROUP BY 1")
def bounds_by_type(spark, d):
    points = t(spark, d, "events").select("event_type", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("event_id").cast("double").alias("z"))
    found = rk.bounds(points, ["event_type"])
    return found.select(*[F.round(c, 4).alias(c) if c[:4] in ("cent", "size", "mean") else c for c in found.columns])


@query("SELECT user_id, bool_or(value > 60) AS large, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS kind FROM events GROUP BY 1")
def flags_by_user(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", (F.col("value") > 60).alias("large"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return rk.roll_up(rows, "user_id", "event_id", ["large"], ["kind"])


_EDGES = "e AS (SELECT p_type AS parent, p_brand AS target, min(p_size % 4)::INTEGER AS path_length, count(*) AS samples, min(p_partkey) AS place FROM part GROUP BY 1, 2)"


@query(f"WITH {_EDGES}, a AS (SELECT DISTINCT p_type AS parent, 'Brand#1' || (length(p_type) % 9) AS excluded FROM part), m AS (SELECT *, row_number() OVER (PARTITION BY parent, excluded ORDER BY target = excluded, path_length, samples DESC, place) AS k FROM a JOIN e USING (parent)) SELECT parent, excluded, target, path_length, samples, place FROM m WHERE k = 1")
def sibling_edge_pick(spark, d):
    p = t(spark, d, "part")
    edges = p.groupBy(F.col("p_type").alias("parent"), F.col("p_brand").alias("target")).agg(F.min(F.col("p_size") % 4).alias("path_length"), F.count("*").alias("samples"), F.min("p_partkey").alias("place"))
    asked = p.select(F.col("p_type").alias("parent"), F.concat(F.lit("Brand#1"), (F.length("p_type") % 9).cast("string")).alias("excluded")).distinct()
    return rk.sibling_edges(edges, asked)


@query("WITH c AS (SELECT o_custkey AS parent, CASE WHEN o_orderkey % 3 = 0 THEN 'iri' ELSE 'class' END AS kind, o_orderpriority AS child, o_orderkey AS place FROM orders), a AS (SELECT c_custkey AS parent, '1-URGENT' AS wanted FROM customer), m AS (SELECT *, row_number() OVER (PARTITION BY parent, wanted ORDER BY CASE WHEN kind = 'class' AND child = wanted THEN 0 WHEN kind = 'iri' THEN 1 ELSE 2 END, place) AS k FROM a JOIN c USING (parent)) SELECT parent, wanted, kind, child, place FROM m WHERE k = 1")
def reference_chain_pick(spark, d):
    chains = t(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 3 == 0, "iri").otherwise("class").alias("kind"), F.col("o_orderpriority").alias("child"), F.col("o_orderkey").alias("place"))
    return rk.reference_chains(chains, t(spark, d, "customer").select(F.col("c_custkey").alias("parent"), F.lit("1-URGENT").alias("wanted")))


@query("WITH c AS (SELECT p_brand AS domain, p_name AS class, p_name AS local, min(p_partkey) AS place, (max(p_size) % 5)::DOUBLE AS score FROM part GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY starts_with(class, 'small'), score DESC, place) AS k FROM c) SELECT domain, class, local, place, score FROM m WHERE k = 1")
def primary_class_pick(spark, d):
    classes = t(spark, d, "part").groupBy(F.col("p_brand").alias("domain"), F.col("p_name").alias("class")).agg(F.min("p_partkey").alias("place"), (F.max("p_size") % 5).cast("double").alias("score")).withColumn("local", F.col("class"))
    return rk.primary_classes(classes, classes.where("class like 'small%'").select("class"))
