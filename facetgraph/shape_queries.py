"""Registered queries over shapes that are made from the tables, and a search by a catalog read from Turtle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph import schema as sc
from facetgraph.plans.search import lower, plan_search
from facetgraph.queries import query, t
from facetgraph.slots import parse_slots
from facetgraph.sources import rdf

SHAPES = """
@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix t: <urn:t:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
t:CustomerShape sh:targetClass t:customer ; sh:and ( t:Named [ sh:property [ sh:path t:c_nationkey ; sh:node t:NationShape ] ] ) .
t:Named sh:property [ sh:path t:c_mktsegment ; sh:datatype xsd:string ] , [ sh:path t:c_acctbal ; sh:datatype xsd:double ] .
t:NationShape sh:targetClass t:nation ; sh:property [ sh:path t:n_name ; sh:datatype xsd:string ] , [ sh:path t:n_regionkey ; sh:node t:RegionShape ] .
t:RegionShape sh:targetClass t:region ; sh:property [ sh:path t:r_name ; sh:datatype xsd:string ] .
"""
TABLES = {"customer": ("customer", "c_custkey", "c_name"), "nation": ("nation", "n_nationkey", "n_name"), "region": ("region", "r_regionkey", "r_name")}


def shapes(spark, d) -> DataFrame:
    """A class for each brand with a property for each name, under the class's shape or a part of it; brands refer to types."""
    part = t(spark, d, "part")
    cls = lambda c: F.concat(F.lit("urn:c/"), c)
    brand, kind, name = F.col("p_brand"), F.col("p_type"), F.regexp_replace("p_name", " ", "_")
    shape, prop = F.concat(F.lit("urn:s/"), brand), F.concat(F.lit("urn:p/"), brand, F.lit("/"), name)
    fact = lambda rows, s, p, o: rows.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    own, link = part.select("p_brand", "p_name").distinct(), part.groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    to = F.concat(F.lit("urn:l/"), brand)
    rows = [
        fact(link, shape, sc.SH + "targetClass", cls(brand)),
        fact(own, shape, sc.SH + "property", prop),
        fact(own, prop, sc.SH + "path", F.concat(F.lit("urn:n/"), name)),
        fact(own, prop, sc.SH + "datatype", F.lit("http://www.w3.org/2001/XMLSchema#integer")),
        fact(link, shape, sc.SH + "property", to),
        fact(link, to, sc.SH + "path", F.lit("urn:n/kind")),
        fact(link, to, sc.SH + "node", F.concat(F.lit("urn:s/"), kind)),
    ]
    types = part.select("p_type", "p_size").distinct()
    size = F.concat(F.lit("urn:p/"), kind, F.lit("/size"), F.col("p_size").cast("string"))
    rows += [
        fact(types, F.concat(F.lit("urn:s/"), kind), sc.SH + "targetClass", cls(kind)),
        fact(types, F.concat(F.lit("urn:s/"), kind), sc.SH + "property", size),
        fact(types, size, sc.SH + "path", F.concat(F.lit("urn:n/size"), F.col("p_size").cast("string"))),
        fact(types, size, sc.SH + "minInclusive", F.col("p_size").cast("string")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


@query(
    "WITH own AS (SELECT DISTINCT p_brand, replace(p_name, ' ', '_') AS name FROM part), link AS (SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY 1), size AS (SELECT DISTINCT p_type, 'size' || p_size AS name FROM part) SELECT 'urn:c/' || p_brand AS asset, name, 'urn:n/' || name AS steps, 'literal' AS kind FROM own UNION ALL SELECT 'urn:c/' || p_brand, name, 'urn:n/kind urn:n/' || name, 'literal' FROM link JOIN size USING (p_type) UNION ALL SELECT 'urn:c/' || p_type, name, 'urn:n/' || name, 'literal' FROM size"
)
def shape_paths(spark, d):
    return sc.property_paths(shapes(spark, d)).select("asset", "name", F.array_join("steps", " ").alias("steps"), "kind")


@query("SELECT 'urn:n/' || name AS path, dt AS datatypes, least FROM (SELECT DISTINCT replace(p_name, ' ', '_') AS name, 'http://www.w3.org/2001/XMLSchema#integer' AS dt, NULL::DOUBLE AS least FROM part UNION ALL SELECT DISTINCT 'size' || p_size, '', p_size::DOUBLE FROM part UNION ALL SELECT 'kind', '', NULL)")
def shape_constraints(spark, d):
    return sc.constraint_index(shapes(spark, d)).select("path", F.array_join("datatypes", ",").alias("datatypes"), "least")


@query("SELECT c_custkey AS asset, c_name AS name, c_mktsegment, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal >= 5000 AND c_mktsegment = 'BUILDING'")
def search_by_shapes(spark, d):
    catalog = sc.catalog_of_shapes(rdf.quads_of(spark, SHAPES, "urn:graph:schema"), TABLES)
    slots = parse_slots({"domains": ["customer"], "filters": {"r_name": "ASIA", "c_mktsegment": "BUILDING"}, "ranges": {"c_acctbal": {"min": 5000}}})
    found = lower(plan_search(slots, catalog), lambda name: t(spark, d, name))
    return found.select("asset", "name", "c_mktsegment", "r_name")
