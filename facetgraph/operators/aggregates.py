"""Facets, distributions, evaluation measures and ordered-sequence operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facets(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """property, value, datatype, n: how often each value of each column occurs, all columns in one pass."""
    kinds = dict(rows.dtypes)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value"), F.lit(kinds[c]).alias("datatype")) for c in columns]))
    return rows.select(cells.alias("x")).select("x.*").where("value is not null").groupBy("property", "value", "datatype").agg(F.count("*").alias("n"))


def distribution(counts: DataFrame, samples: int = 12) -> DataFrame:
    """property, total, distinct_values, min_value, max_value, top: of facets' counts.

    Bounds only where all values are of numeric datatypes, of those that are numbers. top has the most frequent values, ties by value. distinct_values counts
    pairs of value and datatype.
    """
    # fixed values: SQL types and XSD names of numbers
    numeric = r"(tinyint|smallint|int|bigint|float|double|decimal(\(.*\))?|(.*#)?(integer|decimal|float|double|long|int|short|byte|nonNegativeInteger|positiveInteger|unsignedInt|unsignedLong))"
    number = F.when(F.regexp_like("datatype", F.lit(f"^{numeric}$")), F.col("value").try_cast("double"))
    order = W.partitionBy("property").orderBy(F.col("n").desc(), "value", "datatype")
    ranked = counts.withColumn("rank", F.row_number().over(order)).withColumn("number", number)
    all_numbers = F.bool_and(F.regexp_like("datatype", F.lit(f"^{numeric}$")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= samples, F.struct("rank", "value", "n"))))
    return ranked.groupBy("property").agg(
        F.sum("n").alias("total"),
        F.count("*").alias("distinct_values"),
        F.when(all_numbers, F.min("number")).alias("min_value"),
        F.when(all_numbers, F.max("number")).alias("max_value"),
        F.array_join(F.transform(top, lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ",").alias("top"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null over nothing."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def nearest_rank(column: str, q: float) -> Column:
    """The percentile at rank ceil(q n), a value that occurs; an aggregate."""
    return F.expr(f"percentile_disc({q}) within group (order by {column})")


def median_deviation(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, median, mad: nearest-rank median, and that of the distances from it."""
    middle = rows.groupBy(*keys).agg(nearest_rank(column, 0.5).alias("median"))
    away = rows.join(middle, keys).withColumn("away", F.abs(F.col(column) - F.col("median")))
    return away.groupBy(*keys).agg(F.first("median").alias("median"), nearest_rank("away", 0.5).alias("mad"))


def precision_recall(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, precision, recall of summed tp, fp, fn."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return counts.groupBy(*keys).agg(ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def shortlist_winner(rows: DataFrame, tier: str, score: str, weight: str, name: str, within: float = 0.02) -> DataFrame:
    """Of each tier's rows whose score is within ``within`` of the best, the lightest; ties by name."""
    best = F.max(score).over(W.partitionBy(tier))
    near = rows.withColumn("best", best).where(F.col("best") - F.col(score) <= within + 1e-12)
    order = W.partitionBy(tier).orderBy(weight, name)
    return near.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(tier, name, score, weight)


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def top_per_key(rows: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def runner_up_margin(rows: DataFrame, keys: list[str], name: str, score: str) -> DataFrame:
    """keys, the best name, its score and its lead over the second (its whole score if it is alone)."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), name)
    ranked = rows.withColumn("second", F.lead(score).over(order)).withColumn("rank", F.row_number().over(order))
    return ranked.where("rank = 1").select(*keys, name, score, (F.col(score) - F.coalesce("second", F.lit(0))).alias("margin"))


def consecutive(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows with their predecessor's columns as prev_<column>; the first of a key has nulls."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})


def budgeted(rows: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows kept while their sizes fit the budget: the first always, later smaller ones still may. Sequential in a key."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        left, kept = budget, []
        for i, n in enumerate(group[size].tolist()):
            if i == 0 or n <= left:
                kept.append(i)
                left -= n
        return group.iloc[kept]

    return rows.groupBy(*keys).applyInPandas(keep, rows.schema)


def round_robin(items: DataFrame, repetitions: int) -> DataFrame:
    """repetition, place and the items: all items in order, again and again."""
    return items.select("*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition"))


def union_with_tag(parts: dict[str, DataFrame]) -> DataFrame:
    """A bag union of arms; columns an arm lacks are null, ``domain`` names the arm."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn("domain", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """SPARQL's MINUS: rows of left that agree with none of right; without common columns nothing is taken away."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*shared).distinct(), shared, "left_anti") if shared else left


def token_overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives, false negatives of two sets."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
