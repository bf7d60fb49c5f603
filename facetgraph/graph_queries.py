"""Registered queries that read the test tables as quads: SPARQL, shapes, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgraph import schema as sc
from facetgraph.operators import aggregates as ag
from facetgraph.queries import query, t
from facetgraph.sources import files as fl
from facetgraph.sources import rdf
from facetgraph.sources.lifting import lift
from facetgraph.sparql.execute import run_query
from facetgraph.sparql.policy import check, schema_sandbox

PREFIX = "PREFIX t: <urn:t:> "


def quads(spark: SparkSession, d: str) -> DataFrame:
    n = lift(t(spark, d, "nation"), "nation", "n_nationkey", links={"n_regionkey": "region"})
    r = lift(t(spark, d, "region"), "region", "r_regionkey")
    c = lift(t(spark, d, "customer"), "customer", "c_custkey", links={"c_nationkey": "nation"})
    schema = rdf.quads_of(spark, "@prefix t: <urn:t:> . @prefix s: <urn:s:> . t:customer s:sub t:party . t:supplier s:sub t:party . t:party s:sub t:thing . t:region s:sub t:place . t:nation s:sub t:place . t:place s:sub t:thing .", "urn:graph:schema")
    return n.unionByName(r).unionByName(c).unionByName(schema)


def ask(spark, d, text: str) -> DataFrame:
    return run_query(quads(spark, d), PREFIX + text)


@query("SELECT 'urn:t:customer:' || c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sparql_bgp(spark, d):
    return ask(spark, d, "SELECT ?c ?name WHERE { ?c a t:customer ; t:c_name ?name ; t:c_mktsegment 'BUILDING' }")


@query("SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 9000")
def sparql_path_filter(spark, d):
    return ask(spark, d, "SELECT ?name ?region WHERE { ?c t:c_name ?name ; t:c_acctbal ?b ; t:c_nationkey/t:n_regionkey/t:r_name ?region FILTER(<http://www.w3.org/2001/XMLSchema#float>(?b) >= 9000) }")


@query("SELECT n_name AS name, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) > 2")
def sparql_group_having(spark, d):
    return ask(spark, d, "SELECT ?name (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c t:c_nationkey ?k . ?k t:n_name ?name } GROUP BY ?name HAVING(COUNT(DISTINCT ?c) > 2)").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT r_name AS region, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN n_name END AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name IN ('NATION_1', 'NATION_2')")
def sparql_optional_filter(spark, d):
    return ask(spark, d, "SELECT ?region ?nation WHERE { ?r t:r_name ?region OPTIONAL { ?n t:n_regionkey ?r ; t:n_name ?nation FILTER(?nation IN ('NATION_1', 'NATION_2')) } }")


@query("SELECT 'urn:t:nation:' || n_nationkey AS x, n_name AS a, NULL AS b FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'urn:t:region:' || r_regionkey, NULL, r_name FROM region")
def sparql_union(spark, d):
    return ask(spark, d, "SELECT ?x ?a ?b WHERE { { ?x t:n_name ?a ; t:n_nationkey ?k FILTER(?k < 3) } UNION { ?x t:r_name ?b } }")


@query("SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def sparql_not_exists(spark, d):
    return ask(spark, d, "SELECT ?name WHERE { ?n t:n_name ?name FILTER NOT EXISTS { ?c t:c_nationkey ?n ; t:c_acctbal ?b FILTER(?b > 9900) } }")


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 1")
def sparql_minus(spark, d):
    return ask(spark, d, "SELECT ?name WHERE { ?n t:n_name ?name MINUS { ?n t:n_regionkey <urn:t:region:1> } }")


@query("SELECT n_name AS name, 'R' || upper(substr(r_name, 1, 2)) AS code FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def sparql_bind_values(spark, d):
    return ask(spark, d, "SELECT ?name ?code WHERE { VALUES ?rn { 'ASIA' 'EUROPE' } ?n t:n_name ?name ; t:n_regionkey ?r . ?r t:r_name ?rn BIND(CONCAT('R', UCASE(SUBSTR(?rn, 1, 2))) AS ?code) }")


@query("SELECT * FROM (VALUES ('urn:t:customer'), ('urn:t:supplier'), ('urn:t:party')) v(c)")
def sparql_closure(spark, d):
    return ask(spark, d, "SELECT ?c WHERE { ?c <urn:s:sub>* t:party }")


@query("SELECT * FROM (VALUES ('urn:t:party'), ('urn:t:place')) v(c)")
def sparql_graph(spark, d):
    return ask(spark, d, "SELECT ?c WHERE { GRAPH <urn:graph:schema> { ?c <urn:s:sub> t:thing } }")


@query("SELECT n_name AS name FROM nation")
def sparql_minus_unbound(spark, d):
    return ask(spark, d, "SELECT ?name WHERE { ?n t:n_name ?name OPTIONAL { ?n t:nothing ?z } MINUS { ?c t:c_acctbal ?z } }")


@query("SELECT c_mktsegment AS seg, count(DISTINCT n_regionkey) AS regions, string_agg(DISTINCT n_regionkey::VARCHAR, ',' ORDER BY n_regionkey::VARCHAR) AS list, min(c_name) AS sample, sum(c_custkey)::BIGINT AS keys, round(avg(DISTINCT n_nationkey), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sparql_aggregates(spark, d):
    found = ask(spark, d, "SELECT ?seg (COUNT(DISTINCT ?r) AS ?regions) (GROUP_CONCAT(DISTINCT ?rk; SEPARATOR=',') AS ?list) (SAMPLE(?name) AS ?sample) (SUM(?k) AS ?keys) (AVG(DISTINCT ?nk) AS ?mean) WHERE { ?c t:c_mktsegment ?seg ; t:c_custkey ?k ; t:c_name ?name ; t:c_nationkey ?n . ?n t:n_nationkey ?nk ; t:n_regionkey ?r . ?r t:r_regionkey ?rk } GROUP BY ?seg")
    return found.withColumns({"regions": F.col("regions").cast("bigint"), "keys": F.col("keys").cast("bigint"), "mean": F.round(F.col("mean").cast("double"), 6)})


@query("SELECT 'true' AS result")
def sparql_ask(spark, d):
    return ask(spark, d, "ASK { ?n t:n_name 'NATION_7' }")


@query("SELECT c_name AS name, 'number' AS kind FROM customer WHERE c_custkey = 1")
def sparql_term_equality(spark, d):
    return ask(spark, d, "SELECT ?name ?kind WHERE { { ?c t:c_name ?name ; t:c_custkey '1' BIND('text' AS ?kind) } UNION { ?c t:c_name ?name ; t:c_custkey 1 BIND('number' AS ?kind) } }")


@query("SELECT c_name AS name FROM customer WHERE regexp_matches(c_name, '000[0-4]$') ORDER BY 1 DESC LIMIT 7")
def sparql_regex_order(spark, d):
    return ask(spark, d, "SELECT ?name WHERE { ?c t:c_name ?name FILTER(REGEX(?name, '000[0-4]$', 'i')) } ORDER BY DESC(?name) LIMIT 7")


@query("SELECT CASE WHEN is_float THEN 'http://www.w3.org/2001/XMLSchema#double' ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS dt, n FROM (VALUES (true, (SELECT count(c_acctbal) FROM customer)), (false, (SELECT count(c_mktsegment) FROM customer))) v(is_float, n)")
def sparql_datatype_count(spark, d):
    rows = ask(spark, d, "SELECT ?dt (COUNT(?v) AS ?n) WHERE { { ?c t:c_acctbal ?v } UNION { ?c t:c_mktsegment ?v } BIND(DATATYPE(?v) AS ?dt) } GROUP BY ?dt")
    return rows.withColumn("n", F.col("n").cast("bigint"))


@query("SELECT r_name AS name, CAST(n AS BIGINT) AS n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) JOIN region ON n_regionkey = r_regionkey WHERE n > 1")
def sparql_subquery(spark, d):
    return ask(spark, d, "SELECT ?name ?n WHERE { { SELECT ?r (COUNT(?x) AS ?n) WHERE { ?x t:n_regionkey ?r } GROUP BY ?r } ?r t:r_name ?name FILTER(?n > 1) }").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT * FROM (VALUES ('ask', false), ('from', false), ('limit', false), ('plain', true), ('prefix', false), ('service', false)) v(name, allowed)")
def policy_verdicts(spark, d):
    cases = {
        "plain": "SELECT ?s WHERE { ?s ?p ?o } LIMIT 10",
        "ask": "ASK { ?s ?p ?o }",
        "from": "SELECT ?s FROM <urn:g> WHERE { ?s ?p ?o }",
        "limit": "SELECT ?s WHERE { ?s ?p ?o } LIMIT 501",
        "service": "SELECT ?s WHERE { { SELECT ?s WHERE { SERVICE <urn:x> { ?s ?p ?o } } } }",
        "prefix": "PREFIX x: <urn:evil:> SELECT ?s WHERE { ?s x:p ?o }",
    }
    return spark.createDataFrame([(k, check(v, {"urn:t:"}).allowed) for k, v in cases.items()], "name string, allowed boolean")


@query("SELECT * FROM (VALUES ('urn:t:customer'), ('urn:t:supplier'), ('urn:t:party'), ('urn:t:region'), ('urn:t:nation'), ('urn:t:place')) v(s)")
def schema_sandbox_rows(spark, d):
    return run_query(quads(spark, d), schema_sandbox("SELECT DISTINCT ?s WHERE { ?s ?p ?o }", "urn:graph:schema").query)


# sources and sinks

TURTLE = """@prefix ex: <http://example.test/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:Car ; ex:name "One"@en , "Eins"@de ; ex:size 4 ; ex:width 1.5 ; ex:part [ ex:name "Wheel" ] ; ex:list ( "x" "y" ) . # a comment
ex:b a ex:Car ; ex:name \"\"\"Two
lines\"\"\" ; ex:ok true ; ex:when "2024-01-01"^^xsd:date ."""


@query("SELECT * FROM (VALUES ('literal', 10), ('uri', 3), ('bnode', 3)) v(o_kind, n)")
def turtle_terms(spark, d):
    return rdf.quads_of(spark, TURTLE).groupBy("o_kind").agg(F.count("*").alias("n"))


JSONLD = """{"@context": {"@vocab": "http://example.test/", "size": {"@type": "http://www.w3.org/2001/XMLSchema#integer"}, "next": {"@type": "@id"}},
"@graph": [{"@id": "urn:a", "@type": "Car", "name": "One", "size": "4", "next": "urn:b"}, {"@id": "urn:b", "@type": "Car", "name": ["Two", {"@value": "Zwei", "@language": "de"}]}]}"""


@query("SELECT * FROM (VALUES ('http://example.test/name', 3), ('http://example.test/next', 1), ('http://example.test/size', 1), ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 2)) v(p, n)")
def jsonld_terms(spark, d):
    return rdf.quads_of(spark, JSONLD, jsonld=True).groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3)")
def graph_update(spark, d):
    q = lift(t(spark, d, "nation"), "nation", "n_nationkey").where("p = 'urn:t:n_name'")
    gone = q.where("s = 'urn:t:nation:3'")
    return rdf.apply_update(q, q.where("s = 'urn:t:nation:4'"), gone).agg(F.count("*").alias("n"))


@query("SELECT '<urn:t:nation:' || n_nationkey || '> <urn:t:n_name> \"' || n_name || '\" .' AS fragment FROM nation")
def turtle_export(spark, d):
    return rdf.turtle_fragments(lift(t(spark, d, "nation"), "nation", "n_nationkey").where("p = 'urn:t:n_name'")).select("fragment")


@query("SELECT s_suppkey, '{\"@context\":{\"@vocab\":\"http://example.test/\"},\"@id\":\"' || s_suppkey || '\",\"s_name\":\"' || s_name || '\"}' AS jsonld FROM supplier")
def jsonld_export(spark, d):
    return fl.jsonld_rows(t(spark, d, "supplier"), "s_suppkey", "http://example.test/", ["s_name"])


@query("SELECT o_orderkey::VARCHAR AS road_id, o_totalprice AS length, CAST(0 AS INTEGER) AS piece, 0.25::DOUBLE AS hdg, CASE WHEN o_custkey % 2 = 0 THEN 0.01 ELSE 0.0 END::DOUBLE AS curv_start FROM orders")
def xml_roads(spark, d):
    o = t(spark, d, "orders")
    arc = F.when(F.col("o_custkey") % 2 == 0, F.lit('<arc curvature="0.01"/>')).otherwise(F.lit("<line/>"))
    xml = F.concat(F.lit('<OpenDRIVE><road id="'), F.col("o_orderkey").cast("string"), F.lit('" length="'), F.col("o_totalprice").cast("string"), F.lit('"><planView><geometry s="0" hdg="0.25" length="2">'), arc, F.lit("</geometry></planView></road></OpenDRIVE>"))
    return fl.roads(o.select(xml.alias("value"))).select("road_id", "length", "piece", "hdg", "curv_start")


@query("SELECT event_type AS bundle, 'c1' AS checker, 'i' || event_id AS issue FROM events")
def xml_checker_issues(spark, d):
    e = t(spark, d, "events")
    gaps = e.select(F.col("event_type").alias("gate"), F.lit("c1").alias("checker"), F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("issue"), F.lit("x < y").alias("description"))
    xml = fl.checker_xml(gaps).select(F.concat(F.lit("<Results>"), "xml", F.lit("</Results>")).alias("value"))
    return fl.checker_issues(xml).select("bundle", "checker", "issue")


@query("SELECT c_custkey AS asset, c_name AS label, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS refs FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def asset_tree(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_custkey").alias("asset"), F.col("c_name").alias("label"), F.lit(None).cast("bigint").alias("up"), "o_orderkey", F.col("o_orderstatus").alias("s"))
    tree = fl.asset_tree(rows, "asset", ["label"], "up", "o_orderkey", "s")
    return tree.select("asset", "label", F.array_join(F.transform("references", lambda x: x["child"].cast("string")), ",").alias("refs"))


@query("SELECT 'customer' AS domain, c_custkey AS k, c_acctbal AS bal, NULL AS p_size FROM customer UNION ALL SELECT 'part', p_partkey, NULL, p_size FROM part")
def tagged_union(spark, d):
    return ag.union_with_tag({"customer": t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "part": t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")})


# schemas

SCHEMA = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix e: <http://e/v1/> . @prefix f: <http://f/v1/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
e:MapShape sh:targetClass e:Map ; sh:property [ sh:path e:format ; sh:in ( "xodr" "lanelet" ) ; sh:name "file format" ] , [ sh:path e:length ; sh:datatype xsd:float ] .
e:SceneShape sh:targetClass f:Scene ; sh:property [ sh:path e:format ; sh:datatype xsd:string ] , [ sh:path f:uses ; sh:class e:Map ] , [ sh:path f:low ; sh:datatype xsd:integer ; sh:lessThanOrEquals f:high ] .
e:Map rdfs:subClassOf e:Asset . f:Scene rdfs:subClassOf e:Asset .
e:places skos:narrower e:europe . e:europe skos:narrower e:de , e:fr . e:de skos:notation "DE" . e:fr skos:prefLabel "France" .
e:Kind owl:oneOf ( "xodr" "osm" ) ."""


def schema(spark: SparkSession) -> DataFrame:
    return rdf.quads_of(spark, SCHEMA)


@query("SELECT * FROM (VALUES ('format', 'Map,Scene'), ('length', 'Map'), ('uses', 'Scene'), ('low', 'Scene')) v(name, domains)")
def schema_property_domains(spark, d):
    return sc.property_domains(schema(spark))


@query("SELECT * FROM (VALUES ('http://e/v1/format', 0, 'xodr'), ('http://e/v1/format', 1, 'lanelet')) v(path, position, value)")
def schema_enumerations(spark, d):
    return sc.enumerations(schema(spark))


@query("SELECT * FROM (VALUES ('http://e/v1/length', 'float'), ('http://f/v1/low', 'integer')) v(path, kind)")
def schema_numeric(spark, d):
    return sc.numeric_properties(schema(spark))


@query("SELECT 'http://e/v1/SceneShape' AS shape, 'http://f/v1/low' AS low, 'http://f/v1/high' AS high")
def schema_intervals(spark, d):
    return sc.intervals(schema(spark))


@query("SELECT 'http://f/v1/Scene' AS source, 'http://f/v1/uses' AS predicate, 'http://e/v1/Map' AS target")
def schema_references(spark, d):
    return sc.references(schema(spark))


@query("SELECT * FROM (VALUES ('places', 'DE'), ('places', 'France'), ('europe', 'DE'), ('europe', 'France'), ('de', 'DE'), ('france', 'France')) v(key, value)")
def schema_concepts(spark, d):
    return sc.concept_values(schema(spark))


@query("SELECT * FROM (VALUES ('http://e/v1/Asset')) v(base)")
def schema_shared_bases(spark, d):
    return sc.shared_bases(schema(spark))


@query("SELECT * FROM (VALUES ('http://f/v1/Scene', 1), ('http://e/v1/Map', 0)) v(class, score)")
def schema_composition(spark, d):
    return sc.composition_scores(schema(spark))


@query("SELECT 'http://e/v1/' AS namespace, 1 AS n")
def schema_namespace(spark, d):
    return sc.domain_namespaces(schema(spark))


@query("SELECT * FROM (VALUES ('Map', 'format', 2), ('Map', 'length', 0), ('Scene', 'format', 2), ('Scene', 'uses', 0), ('Scene', 'low', 0)) v(domain, label, allowed)")
def schema_term_cards(spark, d):
    return sc.term_cards(schema(spark)).select("domain", F.get("labels", F.lit(0)).alias("label"), F.size("allowed_values").alias("allowed"))


@query("SELECT * FROM (VALUES ('http://e/v1/Kind', 'osm')) v(class, value)")
def schema_one_of_drift(spark, d):
    return sc.one_of_drift(schema(spark))


@query("SELECT * FROM (VALUES ('urn:s:format/lanelet', 'lanelet'), ('urn:s:format/xodr', 'xodr')) v(s, o)")
def schema_skos_export(spark, d):
    return sc.concepts_of_enumerations(schema(spark), "urn:s:").where("p like '%prefLabel'").select("s", "o")
