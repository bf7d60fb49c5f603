"""Mixing sources to target weights: Efraimidis-Spirakis sampling, whole epochs before a fraction.

All of it is DataFrame work. Sorting within a source is spread: keys are cut into ranges, ranges are summed, and only
the one range of a source that its budget ends in is sorted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgraph.llm.common import GAP, word_count, written


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns' text."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def label_quality(labels: DataFrame) -> DataFrame:
    """doc_id, weight of each labelled document: 4 where all its labels call it good, 1 where none does, else 2."""
    good = F.avg("quality")
    weight = F.when(good == 1, 4.0).when(good == 0, 1.0).otherwise(2.0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(weight.alias("weight"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3) -> DataFrame:
    """source, source_size -> the same with target.

    Sources by code point (null last) get the weights in turn. Targets share the sum of all sizes by weight, but stop
    at ``ceiling`` times a source's size; what is over is shared again. The level of water L with
    sum(min(ceiling * size, weight * L)) = total is found in one pass over the sources sorted by ceiling * size / weight.
    The input is one row a source, so its single sorted pass is small whatever the corpus.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    options = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(options, turn.cast("int")))
    most = F.col("source_size") * F.lit(float(ceiling))
    ranked = ranked.withColumn("most", most).withColumn("ratio", most / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(all_rows).cast("double")
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    # the first source that the level doesn't reach the ceiling of fixes the level of all
    fixed = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)
    target = F.least(F.col("most"), F.col("weight") * F.coalesce(fixed["level"], F.lit(0.0)))
    return levelled.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(target)).select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: DataFrame | None = None,
    plain_quality: float = 1.0,
    weights: tuple[float, ...] = (5, 2, 1),
    ceiling: int = 3,
    ranges: int = 4096,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, mix_key.

    A source's target over its size is so many complete epochs of all its documents and a fraction. The fraction is
    drawn by keys -ln(u) / quality, least first, until their sizes fill the budget; the document the budget ends in is
    taken in part, its first words, so that a source's taken words are its target, rounded down. u comes from a hash
    of the id and the text's length, so reruns agree. ``quality`` has one positive weight a document (columns named as
    ``doc_id`` and weight); a document without one gets ``plain_quality``. Null and empty texts have size 0 and take
    nothing; a null source is a source; repeated rows each count, and equal keys are ordered by id and size, so equal
    rows may swap. Other columns are not read; an empty table gives no rows. Texts are read once and never moved.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        uniform(F.col(doc_id), F.length(text)).alias("u"),
    )
    if quality is None:
        rows = rows.withColumn("weight", F.lit(plain_quality))
    else:
        # sizes are written first, so the join moves no text whatever its strategy
        known = quality.select(F.col(doc_id).alias("weighed"), "weight")
        rows = written(rows, "sizes").join(known, F.col("doc_id") == F.col("weighed"), "left").drop("weighed")
        rows = rows.withColumn("weight", F.coalesce("weight", F.lit(plain_quality)))
    rows = rows.withColumn("mix_key", -F.log("u") / F.col("weight")).drop("u", "weight")
    # 1 - exp(-key) is uniform for weight 1 and rises with the key: its ranges keep the order
    cut = F.least(F.floor((1 - F.exp(-F.col("mix_key"))) * ranges).cast("int"), F.lit(ranges - 1)).alias("range")
    rows = written(rows.select("*", cut), "mix")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, ceiling)
    share = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("bigint")
    targets = targets.withColumn("epochs", share).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    # what a whole range gives: all of it before the budget's end, none after; the range it ends in is sorted by row
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = sums.withColumn("before", before).withColumnRenamed("source", "s").withColumnRenamed("range", "r").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    chosen = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    return _draw(chosen)


def _draw(chosen: DataFrame) -> DataFrame:
    """Adds what the fraction takes of each row; only the ranges in which a budget ends are sorted."""
    inside = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget"))
    whole = F.when(F.col("before") + F.col("n") <= F.col("budget"), F.col("size")).otherwise(F.lit(0))
    order = W.partitionBy("source").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.col("budget") - reached, F.lit(0)))
    out = chosen.where(~inside).withColumn("extra", whole).unionByName(chosen.where(inside).withColumn("extra", part))
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("bigint")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", taken.alias("taken"), "mix_key")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of so many words; blanks between them become one."""
    parts = F.filter(F.split(text, GAP), lambda w: w != "")
    return F.array_join(F.slice(parts, F.lit(1), words.cast("int")), " ")


def cut_to_mix(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: taken / size whole copies, then the first taken % size words.

    ``mixed`` is what mix_sources gave for the same rows. Rows with one id, size and source share what these rows
    together take: copies go round them as evenly as they can. Rows that nothing is taken of are dropped. Columns stay.
    """
    row_id = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), row_id.alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), F.col(text).alias("text"))
    mixed_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = mixed.groupBy(mixed_id.alias("i"), F.col("source").alias("s"), F.col("size").alias("z")).agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    same = (F.col("id") == F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    both = rows.join(plan.where("taken > 0"), same)
    once = both.where("rows = 1").withColumn("mine", F.col("taken"))
    turn = F.row_number().over(W.partitionBy("id", "source", "size").orderBy("text")) - 1
    copies = F.floor(F.col("taken") / F.col("z"))
    rest = F.when(turn == F.pmod(copies, F.col("rows")), F.col("taken") - copies * F.col("z")).otherwise(F.lit(0))
    share = F.floor((copies + F.col("rows") - 1 - turn) / F.col("rows"))
    several = both.where("rows > 1").withColumn("mine", share * F.col("z") + rest)
    every = once.unionByName(several).where("mine > 0")
    copy = every.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("mine") / F.col("z")).cast("int"))))
    words = F.least(F.col("z"), F.col("mine") - (F.col("copy") - 1) * F.col("z"))
    cut = F.when(words == F.col("z"), F.col("text")).otherwise(first_words(F.col("text"), words))
    return copy.select(F.col("row").withField(text, cut).alias("row")).select("row.*")
