"""Constraint checks in the style of SHACL Core, value repair with gaps, and quality gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgraph.functions.text import local_name, similarity, suggestion_score

# fixed values: lexical forms of XSD datatypes
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$",
    "double": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "float": r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$",
    "boolean": r"^(true|false|1|0)$",
    "date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "anyURI": r"^[^\s<>\"{}|\\^`]*$",
    "string": r"(?s)^.*$",
}


@dataclass(frozen=True)
class Shape:
    """Constraints on a property's values; what isn't given isn't asked. any_of, all_of, one_of and none_of nest."""

    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    datatype: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None
    node_kind: str | None = None
    has_value: str | None = None
    languages: tuple[str, ...] = ()
    any_of: tuple[Shape, ...] = field(default=())
    all_of: tuple[Shape, ...] = field(default=())
    one_of: tuple[Shape, ...] = field(default=())
    none_of: tuple[Shape, ...] = field(default=())


def conforms(value: Column, shape: Shape, lang: Column | None = None) -> Column:
    """Whether a value (as text) meets the shape; false for null."""
    tests: list[Column] = []
    number = value.try_cast("double")
    if shape.allowed:
        tests.append(value.isin(*shape.allowed))
    if shape.pattern is not None:
        tests.append(value.rlike(shape.pattern))
    if shape.datatype is not None:
        tests.append(value.rlike(LEXICAL[shape.datatype]))
    if shape.min_length is not None:
        tests.append(F.length(value) >= shape.min_length)
    if shape.max_length is not None:
        tests.append(F.length(value) <= shape.max_length)
    for bound, test in ((shape.min_inclusive, lambda b: number >= b), (shape.max_inclusive, lambda b: number <= b), (shape.min_exclusive, lambda b: number > b), (shape.max_exclusive, lambda b: number < b)):
        if bound is not None:
            tests.append(test(float(bound)))
    iri = value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$")
    if shape.node_kind is not None:
        tests.append({"IRI": iri & ~value.startswith("_:"), "BlankNode": value.startswith("_:"), "Literal": ~iri}[shape.node_kind])
    if shape.languages and lang is not None:
        tests.append(F.lower(lang).isin(*[x.lower() for x in shape.languages]))
    each = lambda shapes: [conforms(value, s, lang) for s in shapes]
    if shape.any_of:
        tests.append(F.greatest(*each(shape.any_of), F.lit(False)))
    tests += each(shape.all_of)
    if shape.one_of:
        hits = F.lit(0)
        for t in each(shape.one_of):
            hits = hits + t.cast("int")
        tests.append(hits == 1)
    tests += [~t for t in each(shape.none_of)]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out & value.isNotNull()


def validate(values: DataFrame, shapes: dict[tuple[str, str], Shape]) -> DataFrame:
    """values (property, value) with ``conforms``: under any class that has a shape for the property; unknown ones do.

    shapes: (class, property) -> Shape. Each distinct value is judged once.
    """
    verdict = F.lit(True)
    for prop in sorted({p for _, p in shapes}):
        some = F.lit(False)
        for (_, p), shape in sorted(shapes.items(), key=lambda x: x[0]):
            if p == prop:
                some = some | conforms(F.col("value"), shape)
        verdict = F.when(F.col("property") == prop, some).otherwise(verdict)
    judged = values.select("property", "value").distinct().withColumn("conforms", verdict)
    return values.join(judged.select(F.col("property").alias("p"), F.col("value").alias("v"), "conforms"), (F.col("property") == F.col("p")) & F.col("value").eqNullSafe(F.col("v"))).drop("p", "v")


def validate_by_name(values: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """values (name, value) with ``conforms``: under every property IRI whose local name is the name."""
    verdict = F.lit(True)
    names: dict[str, list[Shape]] = {}
    for iri, shape in sorted(shapes.items()):
        names.setdefault(iri.replace("#", "/").rsplit("/", 1)[-1], []).append(shape)
    for name, all_ in names.items():
        every = F.lit(True)
        for shape in all_:
            every = every & conforms(F.col("value"), shape)
        verdict = F.when(F.col("name") == name, every).otherwise(verdict)
    return values.withColumn("conforms", verdict)


def cardinality(rows: DataFrame, entity: str, value: str, least: int = 0, most: int | None = None, unique_lang: str | None = None) -> DataFrame:
    """entity, n, conforms: number of values within bounds, languages at most once each if asked."""
    lang_once = F.lit(True) if unique_lang is None else F.count(unique_lang) == F.countDistinct(unique_lang)
    n = F.count(value)
    within = (n >= least) & (F.lit(True) if most is None else n <= most)
    return rows.groupBy(entity).agg(n.alias("n"), (within & lang_once).alias("conforms"))


def ordered_pair(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows where the lower value exceeds the higher one (sh:lessThanOrEquals)."""
    return rows.where(F.col(low) > F.col(high))


def viable_datatype(value: Column, declared: tuple[str, ...]) -> Column:
    """The one declared datatype whose lexical form the value has; null if none or several."""
    hits = F.array_compact(F.array(*[F.when(value.rlike(LEXICAL[d]), F.lit(d)) for d in declared]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def best_match(values: DataFrame, vocabulary: DataFrame, floor: float = 0.8) -> DataFrame:
    """query, matched, similarity, confidence for distinct queries (column query) against allowed (column allowed).

    Equal without case, on the value or its IRI's local name: high. Else the most similar of at least ``floor``, ties
    by value: medium. Else null and low. The vocabulary is a catalog; it is broadcast only if Spark sees it is small.
    Blocking by length keeps pairs that the floor allows: the shorter is at least floor times the longer.
    """
    queries = values.select("query").distinct().withColumn("q", F.lower("query"))
    words = vocabulary.select("allowed").distinct().withColumn("a", F.lower("allowed")).withColumn("l", F.lower(local_name(F.col("allowed"))))
    exact = queries.join(words.select("allowed", F.explode(F.array_distinct(F.array("a", "l"))).alias("form")), F.col("q") == F.col("form"))
    exact = exact.groupBy("query").agg(F.min("allowed").alias("matched")).withColumns({"similarity": F.lit(1.0), "confidence": F.lit("high")})
    open_ = queries.join(exact.select("query"), "query", "left_anti")
    sized = open_.withColumn("len", F.explode(F.sequence(F.ceil(F.length("q") * floor - 1e-9).cast("int"), F.floor(F.length("q") / floor + 1e-9).cast("int"))))
    near = sized.join(words, F.col("len") == F.length("a")).withColumn("similarity", similarity(F.col("q"), F.col("a"))).where(F.col("similarity") >= floor)
    order = W.partitionBy("query").orderBy(F.col("similarity").desc(), "allowed")
    near = near.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("query", F.col("allowed").alias("matched"), "similarity", F.lit("medium").alias("confidence"))
    found = exact.select("query", "matched", "similarity", "confidence").unionByName(near)
    missing = queries.join(found.select("query"), "query", "left_anti").select("query", F.lit(None).cast("string").alias("matched"), F.lit(0.0).alias("similarity"), F.lit("low").alias("confidence"))
    return found.unionByName(missing)


def suggestions(queries: DataFrame, vocabulary: DataFrame, k: int = 5, floor: float = 0.5, most: int = 10_000) -> DataFrame:
    """query, suggestion, score, rank: for each of at most ``most`` queries the k best values (``suggestion``).

    The queries go to the values, which may be any number and stay where they are; each task keeps its k best.
    """
    asked = queries.select("query").distinct()
    if asked.limit(most + 1).count() > most:
        raise ValueError(f"suggestions takes at most {most} queries at a time")
    pairs = vocabulary.select("suggestion").distinct().crossJoin(F.broadcast(asked))
    scored = pairs.withColumn("score", suggestion_score(F.col("query"), F.col("suggestion"), floor)).where("score > 0")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "suggestion")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unresolved(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key, as text, is no key of ``known``."""
    targets = known.select(F.col(known_key).cast("string").alias("__known")).distinct()
    return rows.join(targets, F.col(key).cast("string") == F.col("__known"), "left_anti")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """key, n for keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def gap_report(asked: DataFrame, known: DataFrame) -> DataFrame:
    """property, n of asked properties that the catalog doesn't have."""
    return asked.join(known.select("property").distinct(), "property", "left_anti").groupBy("property").agg(F.count("*").alias("n"))


def continuity(geometry: DataFrame, key: str, order: str, tolerance: float = 1e-3) -> DataFrame:
    """Breaks between successive pieces of a line: G1 by heading, G2 by curvature.

    geometry: key, order, hdg, curv_start, curv_end, length. A piece's end heading is its start plus the turned angle.
    """
    window = W.partitionBy(key).orderBy(order)
    turned = F.col("hdg") + (F.col("curv_start") + F.col("curv_end")) / 2 * F.col("length")
    rows = geometry.withColumn("end_hdg", turned).withColumns({"prev_hdg": F.lag("end_hdg").over(window), "prev_curv": F.lag("curv_end").over(window)})
    from facetgraph.functions.text import normal_angle

    bend = F.abs(normal_angle(F.col("hdg") - F.col("prev_hdg")))
    kink = F.abs(F.col("curv_start") - F.col("prev_curv"))
    return rows.where("prev_hdg is not null").select(key, order, F.round(bend, 6).alias("g1_gap"), F.round(kink, 6).alias("g2_gap"), (bend > tolerance).alias("g1_break"), (kink > tolerance).alias("g2_break"))


def comparability(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(flags.items())])), ",")
