"""Schema facts derived from shape and concept quads, each as a DataFrame: domains, properties, enumerations, intervals,
references, concepts, and the cards that a request's words are ranked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetgraph.catalog import Catalog, Domain, Hop, Property, Reference, normalize_domain
from facetgraph.functions.text import local_name, namespace
from facetgraph.operators.aggregates import first_per_key
from facetgraph.operators.graph import closure, cut, leaf_descendants, list_members
from facetgraph.sources.rdf import RDF

# fixed values: vocabularies
SH, RDFS, OWL, SKOS = "http://www.w3.org/ns/shacl#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#"


def pairs(quads: DataFrame, predicate: str, subject: str = "s", obj: str = "o") -> DataFrame:
    """Distinct subjects and objects of a predicate."""
    return quads.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(obj)).distinct()


def shape_properties(quads: DataFrame) -> DataFrame:
    """class, shape, prop, path, datatype, node of the property shapes of shapes with a target class."""
    target = pairs(quads, SH + "targetClass", "shape", "class")
    prop = pairs(quads, SH + "property", "shape", "prop")
    path = pairs(quads, SH + "path", "prop", "path")
    datatype = pairs(quads, SH + "datatype", "prop", "datatype")
    node = pairs(quads, SH + "node", "prop", "node").unionByName(pairs(quads, SH + "class", "prop", "node"))
    return target.join(prop, "shape").join(path, "prop").join(datatype, "prop", "left").join(node, "prop", "left").select("class", "shape", "prop", "path", "datatype", "node")


def property_domains(quads: DataFrame) -> DataFrame:
    """name, domains: the local name of each path with the sorted local names of the classes that have it."""
    rows = shape_properties(quads).select(local_name(F.col("path")).alias("name"), local_name(F.col("class")).alias("domain"))
    return rows.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


def enumerations(quads: DataFrame) -> DataFrame:
    """path, position, value of the lists under sh:in."""
    cells = pairs(quads, SH + "in", "prop", "head").join(pairs(quads, SH + "path", "prop", "path"), "prop")
    rest = pairs(quads, RDF + "rest", "src", "dst").where(F.col("dst") != RDF + "nil")
    first = quads.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("value"))
    return list_members(rest, first).join(cells, "head").select("path", "position", "value")


def numeric_properties(quads: DataFrame) -> DataFrame:
    """path, kind: integer or float, of paths with a numeric datatype."""
    kind = local_name(F.col("datatype"))
    whole = kind.isin("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")
    return shape_properties(quads).where(whole | kind.isin("decimal", "float", "double")).select("path", F.when(whole, "integer").otherwise("float").alias("kind")).distinct()


def intervals(quads: DataFrame) -> DataFrame:
    """shape, low, high of shapes in which one property must not exceed another."""
    bound = pairs(quads, SH + "lessThanOrEquals", "prop", "high").join(pairs(quads, SH + "path", "prop", "low"), "prop")
    return bound.join(pairs(quads, SH + "property", "shape", "prop"), "prop").select("shape", "low", "high").distinct()


def subclasses(quads: DataFrame) -> DataFrame:
    """src, dst of the reflexive closure of rdfs:subClassOf."""
    return closure(pairs(quads, RDFS + "subClassOf", "src", "dst"))


def references(quads: DataFrame) -> DataFrame:
    """source, predicate, target: classes whose shapes point at another target class or one of its superclasses."""
    asset = pairs(quads, SH + "targetClass", "shape", "class").select(F.col("class").alias("target")).distinct()
    below = subclasses(quads).select(F.col("src").alias("target"), F.col("dst").alias("above"))
    pointed = shape_properties(quads).where("node is not null").select(F.col("class").alias("source"), F.col("path").alias("predicate"), "node")
    exact = pointed.join(asset, F.col("node") == F.col("target"))
    wider = pointed.join(below, F.col("node") == F.col("above")).join(asset, "target").select("source", "predicate", "node", "target")
    return exact.unionByName(wider).where("source <> target").select("source", "predicate", "target").distinct()


def concept_values(quads: DataFrame) -> DataFrame:
    """key, value: concepts by lower-cased name with the values of the leaves below: notation, else label, else local name."""
    narrower = pairs(quads, SKOS + "narrower", "src", "dst").unionByName(pairs(quads, SKOS + "broader", "dst", "src").select("src", "dst")).distinct()
    names = narrower.select(F.col("src").alias("c")).unionByName(narrower.select(F.col("dst").alias("c"))).distinct()
    notation = pairs(quads, SKOS + "notation", "c", "notation").groupBy("c").agg(F.min("notation").alias("notation"))
    label = pairs(quads, SKOS + "prefLabel", "c", "label").groupBy("c").agg(F.min("label").alias("label"))
    value = names.join(notation, "c", "left").join(label, "c", "left").select("c", F.coalesce("notation", "label", local_name(F.col("c"))).alias("value"))
    found = leaf_descendants(narrower).join(value.select(F.col("c").alias("root"), F.lower("value").alias("key")), "root").join(value.select(F.col("c").alias("leaf"), F.col("value")), "leaf")
    return found.select("key", "value").distinct()


def domain_namespaces(quads: DataFrame) -> DataFrame:
    """namespace, n: of target classes, the most frequent first; ties by IRI (rank 1 is the registry's)."""
    counts = pairs(quads, SH + "targetClass", "shape", "class").groupBy(namespace(F.col("class")).alias("namespace")).agg(F.count("*").alias("n"))
    return first_per_key(counts.withColumn("all", F.lit(1)), ["all"], F.col("n").desc(), "namespace").drop("all")


def shared_bases(quads: DataFrame) -> DataFrame:
    """base: superclasses of target classes of two namespaces or more that have no superclass themselves."""
    target = pairs(quads, SH + "targetClass", "shape", "class").select("class").distinct()
    up = pairs(quads, RDFS + "subClassOf", "class", "base").join(target, "class")
    wide = up.groupBy("base").agg(F.countDistinct(namespace(F.col("class"))).alias("n")).where("n >= 2")
    return wide.join(pairs(quads, RDFS + "subClassOf", "base", "over").select("base"), "base", "left_anti").select("base")


def composition_scores(quads: DataFrame) -> DataFrame:
    """class, score: other target classes that a target class reaches through its references."""
    edges = references(quads).select(F.col("source").alias("src"), F.col("target").alias("dst"))
    reach = closure(edges, reflexive=False).where("src <> dst").groupBy(F.col("src").alias("class")).agg(F.countDistinct("dst").alias("score"))
    target = pairs(quads, SH + "targetClass", "shape", "class").select("class").distinct()
    return target.join(reach, "class", "left").select("class", F.coalesce("score", F.lit(0)).alias("score"))


def term_cards(quads: DataFrame) -> DataFrame:
    """path, domain, labels, allowed_values, kind: what is known of each property, for ranking and listing."""
    label = quads.where(F.col("p").isin(RDFS + "label", SH + "name")).groupBy(F.col("s").alias("path")).agg(F.array_sort(F.collect_set("o")).alias("named"))
    allowed = enumerations(quads).groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("allowed"))
    rows = shape_properties(quads).select("path", local_name(F.col("class")).alias("domain"), local_name(F.col("datatype")).alias("kind")).distinct()
    cards = rows.join(label, "path", "left").join(allowed, "path", "left")
    names = F.array_distinct(F.concat(F.array(local_name(F.col("path"))), F.coalesce("named", F.array().cast("array<string>"))))
    return cards.select("path", "domain", names.alias("labels"), F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed_values"), "kind")


def concepts_of_enumerations(quads: DataFrame, scheme: str) -> DataFrame:
    """s, p, o of SKOS concepts made from the enumerated values: one scheme, a concept a value."""
    value = enumerations(quads).select(local_name(F.col("path")).alias("name"), "value").distinct()
    iri = F.concat(F.lit(scheme), "name", F.lit("/"), F.regexp_replace("value", r"[^A-Za-z0-9_\-]", "_"))
    facts = F.array(F.struct(F.lit(RDF + "type").alias("p"), F.lit(SKOS + "Concept").alias("o")), F.struct(F.lit(SKOS + "prefLabel").alias("p"), F.col("value").alias("o")), F.struct(F.lit(SKOS + "inScheme").alias("p"), F.concat(F.lit(scheme), "name").alias("o")))
    return value.select(iri.alias("s"), F.explode(facts).alias("x")).select("s", "x.p", "x.o")


def one_of_drift(quads: DataFrame) -> DataFrame:
    """class, value of owl:oneOf members that no sh:in list has."""
    rest = pairs(quads, RDF + "rest", "src", "dst").where(F.col("dst") != RDF + "nil")
    first = quads.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("value"))
    members = list_members(rest, first).join(pairs(quads, OWL + "oneOf", "class", "head"), "head").select("class", "value")
    return members.join(enumerations(quads).select("value").distinct(), "value", "left_anti").select("class", "value")


def shape_owners(quads: DataFrame) -> DataFrame:
    """shape, owner: a shape's target class; parts of a shape under sh:and, sh:or, sh:xone or sh:node belong to the same.

    Combinators may be nested to any depth. A shape that no target class reaches is its own owner.
    """
    rest = pairs(quads, RDF + "rest", "src", "dst").where(F.col("dst") != RDF + "nil")
    first = quads.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("value"))
    heads = quads.where(F.col("p").isin(SH + "and", SH + "or", SH + "xone")).select(F.col("s").alias("src"), F.col("o").alias("head"))
    listed = heads.join(list_members(rest, first), "head").select("src", F.col("value").alias("dst"))
    property_shapes = pairs(quads, SH + "path", "src", "path").select("src")
    nested = pairs(quads, SH + "node", "src", "dst").join(property_shapes, "src", "left_anti")
    parts = listed.unionByName(nested).distinct()
    target = pairs(quads, SH + "targetClass", "src", "owner")
    owned = target.select(F.col("src").alias("shape"), "owner").unionByName(closure(parts).join(target, "src").select(F.col("dst").alias("shape"), "owner")).distinct()
    shapes = pairs(quads, SH + "property", "shape", "prop").select("shape").distinct()
    return cut(owned.unionByName(shapes.join(owned.select("shape"), "shape", "left_anti").select("shape", F.col("shape").alias("owner"))))


def shape_leaves(quads: DataFrame) -> DataFrame:
    """owner, path, kind, child, datatype of all property shapes. kind: edge (to the owner ``child``), class, iri or literal."""
    owners = shape_owners(quads)
    prop = pairs(quads, SH + "property", "shape", "prop").join(pairs(quads, SH + "path", "prop", "path"), "prop").join(owners, "shape")
    node = pairs(quads, SH + "node", "prop", "shape_of").join(owners.select(F.col("shape").alias("shape_of"), F.col("owner").alias("child_of")), "shape_of").select("prop", "child_of")
    kind = pairs(quads, SH + "class", "prop", "class_of")
    iri = pairs(quads, SH + "nodeKind", "prop", "node_kind")
    rows = prop.join(node, "prop", "left").join(kind, "prop", "left").join(iri, "prop", "left").join(pairs(quads, SH + "datatype", "prop", "datatype"), "prop", "left")
    named = F.when(F.col("child_of").isNotNull(), "edge").when(F.col("class_of").isNotNull(), "class").when(F.col("node_kind") == SH + "IRI", "iri").otherwise("literal")
    return cut(rows.select("owner", "path", named.alias("kind"), F.coalesce("child_of", "class_of").alias("child"), "datatype").distinct())


def property_paths(quads: DataFrame, depth: int = 6) -> DataFrame:
    """asset, name, iri, kind, datatype, child, steps: each leaf that a target class reaches, by its shortest path.

    steps are predicates with the leaf's last; walks follow edges between shapes, from the class and its superclasses, of
    at most ``depth`` edges. Of equally short paths the first by text is taken.
    """
    leaves = shape_leaves(quads)
    edges = leaves.where("kind = 'edge' and owner <> child").select(F.col("owner").alias("at"), F.col("path").alias("step"), "child").distinct()
    asset = pairs(quads, SH + "targetClass", "shape", "asset").select("asset").distinct()
    above = subclasses(quads).select(F.col("src").alias("asset"), F.col("dst").alias("node"))
    none = F.array().cast("array<string>")
    front = cut(asset.withColumn("node", F.col("asset")).unionByName(above.join(asset, "asset")).distinct().withColumn("steps", none))
    reached = front
    for _ in range(depth):
        onward = front.join(edges, F.col("node") == F.col("at")).select("asset", F.col("child").alias("node"), F.array_append("steps", F.col("step")).alias("steps"))
        new = onward.groupBy("asset", "node").agg(F.min("steps").alias("steps"))
        front = cut(new.join(reached.select("asset", "node"), ["asset", "node"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    ends = leaves.where("kind <> 'edge'").withColumnRenamed("owner", "node").join(reached, "node")
    rows = ends.select("asset", local_name(F.col("path")).alias("name"), F.col("path").alias("iri"), "kind", "datatype", "child", F.array_append("steps", F.col("path")).alias("steps"))
    return first_per_key(rows, ["asset", "iri"], F.size("steps"), F.array_join("steps", " "), "kind").select(rows.columns)


def reference_chains(paths: DataFrame) -> DataFrame:
    """The property paths that end at another entity: leaves of kind class or iri."""
    return paths.where(F.col("kind").isin("class", "iri"))


def constraint_index(quads: DataFrame) -> DataFrame:
    """path, datatypes, allowed, patterns, least, most: what shapes ask of a path's values, of all its property shapes."""
    bound = lambda name, out: pairs(quads, SH + name, "prop", out)
    path = pairs(quads, SH + "path", "prop", "path")
    allowed = enumerations(quads).groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("allowed"))
    rows = path.join(bound("datatype", "datatype"), "prop", "left").join(bound("pattern", "pattern"), "prop", "left")
    low = bound("minInclusive", "low").unionByName(bound("minExclusive", "low"))
    high = bound("maxInclusive", "high").unionByName(bound("maxExclusive", "high"))
    rows = rows.join(low, "prop", "left").join(high, "prop", "left")
    found = rows.groupBy("path").agg(
        F.array_sort(F.collect_set("datatype")).alias("datatypes"),
        F.array_sort(F.collect_set("pattern")).alias("patterns"),
        F.min(F.col("low").try_cast("double")).alias("least"),
        F.max(F.col("high").try_cast("double")).alias("most"),
    )
    return found.join(allowed, "path", "left").select("path", "datatypes", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"), "patterns", "least", "most")


def catalog_of_shapes(quads: DataFrame, tables: dict[str, tuple[str, str, str]]) -> Catalog:
    """The catalog of the target classes that are tables: class name -> (table, key, label).

    Predicates are named after columns. An edge to a class that is a table is a join on the table's key and, from a
    target class, a reference. The driver holds the schema's paths, whose number the schema bounds, not the data.
    """
    leaf_rows = property_paths(quads).where("kind = 'literal'").collect()
    edge_rows = shape_leaves(quads).where("kind = 'edge'").select("owner", "path", "child").distinct().collect()
    short = lambda iri: iri.rstrip("/#").replace("#", "/").replace(":", "/").rsplit("/", 1)[-1]
    child = {(short(r["owner"]), short(r["path"])): short(r["child"]) for r in edge_rows}

    def hops(owner: str, steps: list[str]) -> tuple[Hop, ...] | None:
        out = []
        for step in steps:
            owner = child.get((owner, short(step)), "")
            if owner not in tables:
                return None
            out.append(Hop(short(step), tables[owner][0], tables[owner][1]))
        return tuple(out)

    domains = {}
    for name, (table, key, label) in sorted(tables.items()):
        made = []
        for r in sorted(leaf_rows, key=lambda r: (len(r["steps"]), r["steps"])):
            if short(r["asset"]) == name and (way := hops(name, r["steps"][:-1])) is not None:
                kind = "numeric" if short(r["datatype"] or "") in ("integer", "decimal", "double", "float", "int", "long") else "literal"
                made.append(Property(short(r["iri"]), short(r["iri"]), way, kind))
        links = tuple(Reference(normalize_domain(c), (Hop(p, tables[c][0], tables[c][1]),)) for (o, p), c in sorted(child.items()) if o == name and c in tables)
        domains[normalize_domain(name)] = Domain(normalize_domain(name), table, key, label, tuple(made), references=links)
    return Catalog(domains, parents={d.name: tuple(r.target for r in d.references) for d in domains.values()})
