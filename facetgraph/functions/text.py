"""Text functions as Column expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no meaning in a search
STOPWORDS = ("a", "an", "and", "are", "for", "in", "is", "of", "on", "or", "the", "to", "with")
# fixed values: words of a gap that suggest nothing
SUGGESTION_STOPWORDS = ("a", "an", "the", "and", "or", "of", "for", "from", "to", "in", "on", "at", "by", "with", "without", "is", "are", "was", "were", "be", "that", "this", "these", "those", "der", "die", "das", "und", "oder", "mit", "ohne", "aus", "von", "zu")


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Camel case split, lower-cased runs of a-z0-9 of two characters or more, without stopwords; a list."""
    spaced = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    parts = F.split(F.lower(spaced), r"[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def stem_tokens(text: Column) -> Column:
    """Lower-case tokens of three characters or more, each with its form without a plural s; distinct."""
    parts = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    both = F.transform(parts, lambda t: F.when(t.endswith("s") & (F.length(t) > 3), F.array(t, F.substring(t, F.lit(1), F.length(t) - 1))).otherwise(F.array(t)))
    return F.array_distinct(F.flatten(both))


def trigrams(token: Column) -> Column:
    """The set of three-character pieces of the token between two blanks before and one after."""
    padded = F.concat(F.lit("  "), token, F.lit(" "))
    starts = F.sequence(F.lit(1), F.length(padded) - 2)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(padded, i, F.lit(3))))


def dice(a: Column, b: Column) -> Column:
    """Twice the common trigrams over all of both."""
    x, y = trigrams(a), trigrams(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def token_match(query: Column, other: Column) -> Column:
    """1 for equal tokens, 0.7 for a prefix (both of three characters or more), 0.7 of a Dice of 0.5 or more, else 0."""
    long = (F.length(query) >= 3) & (F.length(other) >= 3)
    prefix = long & (F.startswith(other, query) | F.startswith(query, other))
    alike = dice(query, other)
    return F.when(query == other, 1.0).when(prefix, 0.7).when(alike >= 0.5, 0.7 * alike).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def suggestion_score(query: Column, candidate: Column, floor: float = 0.5) -> Column:
    """The best of the query's tokens against the whole candidate; 0 under the floor.

    A token counts by its edit similarity, or, where its stem and the candidate contain one another, by the share of the
    longer one covered, if that is more. A query without tokens of three characters is compared as it stands.
    """
    whole = F.lower(candidate)
    parts = F.filter(F.split(F.lower(query), r"[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*SUGGESTION_STOPWORDS))

    def one(token: Column) -> Column:
        stem = F.regexp_replace(token, "(ies|es|s)$", "")
        covered = F.least(F.length(stem), F.length(whole)) / F.greatest(F.length(stem), F.length(whole))
        return F.greatest(similarity(token, whole), F.when(F.contains(whole, stem) | F.contains(stem, whole), covered).otherwise(0.0))

    score = F.coalesce(F.array_max(F.transform(parts, one)), similarity(F.lower(query), whole))
    return F.when(score >= floor, score).otherwise(0.0)


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def namespace(iri: Column) -> Column:
    """What stands up to and with the last # or /; empty if there is none."""
    return F.regexp_extract(iri, r"^(.*[#/])", 1)


def domain_of_iri(iri: Column) -> Column:
    """The path segment before /vN/; empty without one."""
    return F.regexp_extract(iri, r"/([^/]+)/v\d+(?:[/#]|$)", 1)


def kebab(name: Column) -> Column:
    spaced = F.regexp_replace(F.trim(name), r"([a-z0-9])([A-Z])", "$1-$2")
    return F.lower(F.regexp_replace(spaced, r"[\s_]+", "-"))


def pascal(name: Column) -> Column:
    """Words between -, _ or blanks, capitalised and joined."""
    parts = F.filter(F.split(name, r"[-_\s]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")


def graphql_name(name: Column) -> Column:
    """Letters, digits and _ only; a name that begins with a digit gets a _ before it."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def csv_safe(value: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote before it."""
    return F.when(value.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def normal_angle(x: Column) -> Column:
    """The angle in (-pi, pi]."""
    return x - 2 * F.pi() * F.ceil((x - F.pi()) / (2 * F.pi()))


def is_plain_iri(value: Column) -> Column:
    """An absolute IRI with a scheme, without blanks or brackets; no blank node."""
    return value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for an empty or zero one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))
