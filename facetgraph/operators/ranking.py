"""Ranking and routing over a catalog's cards, and choices between edges, chains and classes, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgraph.functions.text import pascal, stem_tokens, token_match, tokens

# fixed values: weights of a card's fields, and what a domain's name counts in a query
LABEL_WEIGHT, VALUE_WEIGHT, DESCRIPTION_WEIGHT = 1.0, 0.7, 0.4
EXACT_TOKEN, PARTIAL_TOKEN, MARGIN, SHORTEST = 3, 2, 2, 3


def tokens_of(texts: Column) -> Column:
    """Tokens of all texts of an array; none for null."""
    return F.coalesce(F.flatten(F.transform(texts, lambda x: tokens(x))), F.array().cast("array<string>"))


def field_score(query: str, fields: list[tuple[Column, float]]) -> Column:
    """Mean over the query's tokens of the best match with any token of any field, times the field's weight; 0 without tokens."""
    asked = tokens(F.lit(query))

    def best(token: Column) -> Column:
        return F.greatest(F.lit(0.0), *[F.coalesce(F.array_max(F.transform(f, lambda x: token_match(token, x))) * w, F.lit(0.0)) for f, w in fields])

    return F.when(F.size(asked) == 0, 0.0).otherwise(F.aggregate(F.transform(asked, best), F.lit(0.0), lambda a, x: a + x) / F.size(asked))


def rank_cards(cards: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """``cards`` (labels, allowed: arrays, description) with score, those over ``least``."""
    fields = [(tokens_of(F.col("labels")), LABEL_WEIGHT), (tokens_of(F.col("allowed")), VALUE_WEIGHT), (tokens_of(F.array("description")), DESCRIPTION_WEIGHT)]
    return cards.withColumn("score", field_score(query, fields)).where(F.col("score") > least)


def rank_domains(catalog: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """domain, score of ``catalog`` (domain, labels, samples: arrays) by name and labels, then sample terms."""
    names = tokens_of(F.concat(F.array("domain"), F.coalesce("labels", F.array().cast("array<string>"))))
    scored = catalog.withColumn("score", field_score(query, [(names, LABEL_WEIGHT), (tokens_of(F.col("samples")), VALUE_WEIGHT)]))
    return scored.where(F.col("score") > least).select("domain", "score")


def prefer_domains(domains: DataFrame, query: str) -> DataFrame:
    """domain, score, kept: the one domain that the query names by a clear margin is kept alone; else all are."""
    asked = stem_tokens(F.lit(query))
    spaced = F.regexp_replace("domain", "([a-z0-9])([A-Z])", "$1 $2")
    parts = F.array_distinct(F.concat(F.array(F.lower("domain")), F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower)))
    own = F.filter(parts, lambda p: F.length(p) >= SHORTEST)

    def points(token: Column) -> Column:
        partly = F.exists(asked, lambda q: F.contains(token, q) | F.contains(q, token))
        return F.when(F.array_contains(asked, token), EXACT_TOKEN).when(partly, PARTIAL_TOKEN).otherwise(0)

    scored = domains.select("domain").distinct().withColumn("score", F.aggregate(F.transform(own, points), F.lit(0), lambda a, x: a + x))
    two = scored.orderBy(F.col("score").desc(), "domain").limit(2).agg(F.max("score").alias("best"), F.min("score").alias("second"), F.count("*").alias("n"))
    clear = (F.col("n") == 2) & (F.col("best") > 0) & (F.col("best") - F.col("second") >= MARGIN)
    return scored.crossJoin(F.broadcast(two)).select("domain", "score", (~clear | (F.col("score") == F.col("best"))).alias("kept"))


def select_cards(ranked: DataFrame, cards: DataFrame, routed: list[str], most: int) -> DataFrame:
    """At most ``most`` cards (domain, kind, iri, position) of the routed domains: ranked ones, then others by domain and place."""
    inside = F.col("domain").isin(*routed)
    first = ranked.where(inside).select("domain", "kind", "iri", F.struct(F.lit(0).alias("tier"), (-F.col("score")).alias("a"), F.lit(0.0).alias("b"), F.col("domain").alias("c"), F.col("iri").alias("d")).alias("o"))
    turn = F.array_position(F.array(*map(F.lit, routed)), F.col("domain")).cast("double")
    rest = cards.where(inside).select("domain", "kind", "iri", F.struct(F.lit(1).alias("tier"), turn.alias("a"), F.col("place").cast("double").alias("b"), F.col("domain").alias("c"), F.col("iri").alias("d")).alias("o"))
    once = first.unionByName(rest).groupBy("domain", "kind", "iri").agg(F.min("o").alias("o"))
    top = once.orderBy("o").limit(most)
    return top.withColumn("position", F.row_number().over(W.orderBy("o"))).drop("o")  # at most ``most`` rows


def compact_iri(iri: Column, namespaces: dict[str, str]) -> Column:
    """prefix:local by the longest namespace that leaves a plain local name; <iri> otherwise."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for space, prefix in sorted(namespaces.items(), key=lambda x: (len(x[0]), x[0])):
        local = F.substring(iri, F.lit(len(space) + 1), F.length(iri))
        out = F.when(F.startswith(iri, F.lit(space)) & F.regexp_like(local, F.lit(r"^[A-Za-z_][\w.-]*$")), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def bounds(points: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """keys and, for each axis, its least, greatest, middle, extent and mean."""
    made = []
    for c in axes:
        low, high = F.min(c), F.max(c)
        made += [low.alias(f"min_{c}"), high.alias(f"max_{c}"), ((low + high) / 2).alias(f"center_{c}"), (high - low).alias(f"size_{c}"), F.avg(c).alias(f"mean_{c}")]
    return points.groupBy(*keys).agg(*made)


def roll_up(rows: DataFrame, key: str, order: str, flags: list[str], firsts: list[str]) -> DataFrame:
    """key, each flag (true in any row) and each first (the first that isn't null, by ``order``)."""
    any_ = [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]
    return rows.groupBy(key).agg(*any_, *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in firsts])


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("k = 1").drop("k")


def sibling_edges(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (parent, excluded) the parent's edge of the shortest path, then of most samples, then the first.

    edges: parent, target, path_length, samples, place. Edges to the excluded domain count only where there is no other.
    """
    met = asked.join(edges, "parent")
    out = F.coalesce(F.col("target") == F.col("excluded"), F.lit(False))
    return _best(met, ["parent", "excluded"], out, F.col("path_length"), F.col("samples").desc(), F.col("place"))


def reference_chains(chains: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (parent, wanted) a chain (parent, kind, child, place): of the wanted class, else the first by IRI, else the first."""
    met = asked.join(chains, "parent")
    direct = F.coalesce((F.col("kind") == "class") & (F.col("child") == F.col("wanted")), F.lit(False))
    return _best(met, ["parent", "wanted"], F.when(direct, 0).when(F.col("kind") == "iri", 1).otherwise(2), F.col("place"))


def primary_classes(classes: DataFrame, components: DataFrame) -> DataFrame:
    """Of each domain's classes (domain, class, local, place, score) the primary one.

    That whose name is the domain's in Pascal case; else, among those that aren't ``components`` (class) unless all are,
    the one of the highest score, then the first.
    """
    marked = classes.join(components.select(F.col("class").alias("c")).distinct(), F.col("class") == F.col("c"), "left")
    return _best(marked, ["domain"], (F.col("local") == pascal(F.col("domain"))).desc(), F.col("c").isNotNull(), F.coalesce("score", F.lit(0.0)).desc(), F.col("place")).drop("c")
