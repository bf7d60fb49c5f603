"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

For each term of weight w and each sample i, hashing the term gives r and c from Gamma(2, 1) and b from U(0, 1);
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The sample keeps the term and t of the least a. Two documents
keep the same with a chance that is their generalised Jaccard similarity, sum of min over sum of max of the weights.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetgraph.llm.common import GAP, written

#: ln a is kept as a 31-bit number: offset, then steps of 2**-24.
OFFSET, STEPS = 64.0, float(1 << 24)


TABLE_BITS = 12


def gamma2_quantile(p: float) -> float:
    """x with 1 - (1 + x) exp(-x) = p, by bisection."""
    low, high = 0.0, 64.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
    return (low + high) / 2


@lru_cache(1)
def gamma_table() -> list[float]:
    """Gamma(2, 1) at the middles of equal parts of probability, 2 ** TABLE_BITS of them."""
    n = 1 << TABLE_BITS
    return [gamma2_quantile((j + 0.5) / n) for j in range(n)]


def term_weight(word: Column, count: Column) -> Column:
    """Count times the square of the length over two, for words of three letters or more; short words count little."""
    extra = F.greatest(F.length(word) - 2, F.lit(0)).cast("double")
    return count.cast("double") * (F.lit(0.25) + extra * extra)


def sample(x: Column, log_weight: Column, gamma: Column, log_gamma: Column) -> Column:
    """One bigint from the term's hash x for a sample: ln a in the upper bits, term and t in the lower 32.

    The least over a text's terms is the sample. Gamma variates are read off the table by 12 bits of x each, which is
    many times faster than their logarithms; the other bits give b.
    """
    mask = (1 << TABLE_BITS) - 1
    r = F.get(gamma, x.bitwiseAND(F.lit(mask)).cast("int"))
    c = F.get(log_gamma, F.shiftrightunsigned(x, TABLE_BITS).bitwiseAND(F.lit(mask)).cast("int"))
    b = F.shiftrightunsigned(x, 2 * TABLE_BITS).bitwiseAND(F.lit((1 << 20) - 1)) / float(1 << 20)
    t = F.floor(log_weight / r + b)
    log_a = c - r * (t - b + 1)
    place = ((log_a + OFFSET) * STEPS).cast("bigint")
    kept = (F.shiftrightunsigned(x, 32) + t * 2654435761).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(place, 32).bitwiseOR(kept)


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = 64, width: int = 8) -> DataFrame:
    """keys and sig (array of ``samples`` ints, the 32-bit numbers less 2 ** 31) of texts, one row for each key with a word.

    ``keys`` must identify the rows. If texts are already dealt out by some of the keys, nothing is shuffled.
    """
    spark = texts.sparkSession
    values = gamma_table()
    tables = spark.createDataFrame([(values, [math.log(v) for v in values])], "gamma array<double>, log_gamma array<double>")
    words = texts.select(*keys, F.explode(F.split(text, GAP)).alias("word")).where("word <> ''")
    terms = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    # the tables are scalar subqueries: one constant each, however many samples read it
    terms = terms.select(*keys, F.xxhash64("word").alias("term"), F.log(term_weight(F.col("word"), F.col("n"))).alias("log_weight"), tables.select("gamma").scalar().alias("gamma"), tables.select("log_gamma").scalar().alias("log_gamma"))
    # a few samples a row keep the generated method small enough for the JIT compiler, which skips long ones
    lanes = terms.withColumn("lane", F.explode(F.array(*[F.lit(i) for i in range(-(-samples // width))])))
    hashed = lanes.select(*keys, "lane", "log_weight", "gamma", "log_gamma", *[F.xxhash64("term", F.col("lane") * width + i).alias(f"x{i}") for i in range(width)])
    least = [F.min(sample(F.col(f"x{i}"), F.col("log_weight"), F.col("gamma"), F.col("log_gamma"))).alias(f"s{i}") for i in range(width)]
    kept = hashed.groupBy(*keys, "lane").agg(*least)
    part = F.struct("lane", F.array(*[(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) - (1 << 31)).cast("int") for i in range(width)]).alias("s"))
    parts = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return parts.select(*keys, F.slice(F.flatten("p.s"), 1, samples).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; texts without words are like each other alone."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.size(a).cast("double"))


def as_text(sig: Column) -> Column:
    """Eight hex digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint") + (1 << 31))), 8, "0")), ""), F.lit(""))


def _ordered(keys: DataFrame, bucket: int) -> DataFrame:
    """id, h, n_chars, copies and those of the next and previous row, by descending id and h, round the table.

    Rows are dealt out by ranges of the order and written, then each range is one window; the ranges' ends are joined
    by a small table of one row a range.
    """
    ranges = max(1, min(4096, -(-keys.count() // bucket)))
    order = [F.col("is_null"), F.col("id").desc(), F.col("h").desc()]
    dealt = written(keys.repartitionByRange(ranges, *order).withColumn("b", F.spark_partition_id()), "order")
    row = F.struct("id", "h", "n_chars")
    inner = W.partitionBy("b").orderBy(*order)
    rows = dealt.withColumn("next", F.lead(row).over(inner)).withColumn("prev", F.lag(row).over(inner))
    ends = dealt.groupBy("b").agg(F.min_by(row, F.struct("is_null", -F.col("id").cast("decimal(20)"), -F.col("h").cast("decimal(20)"))).alias("head"), F.max_by(row, F.struct("is_null", -F.col("id").cast("decimal(20)"), -F.col("h").cast("decimal(20)"))).alias("tail"))
    round_ = W.orderBy("b")
    whole = round_.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(round_), F.first("head").over(whole))
    before = F.coalesce(F.lag("tail").over(round_), F.last("tail").over(whole))
    ends = ends.select(F.col("b").alias("e"), after.alias("after"), before.alias("before"))
    # only the first and last row of each range look at the ends
    edge = rows.where("next is null or prev is null").join(ends, F.col("b") == F.col("e"))
    edge = edge.withColumn("next", F.coalesce("next", "after")).withColumn("prev", F.coalesce("prev", "before")).select(rows.columns)
    return written(rows.where("next is not null and prev is not null").unionByName(edge), "neighbours")


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", samples: int = 64, bucket: int = 20_000) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness, and the likeness to the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last third of code points (rounded down) replaced by as many first ones of the next document, or all it has; next
    is by descending doc_id (nulls last, after the last the first; a lone document is its own next). Null texts are
    empty; empty and blank texts have an empty fingerprint and are like each other alone. Equal rows give equal rows;
    rows of one doc_id with different texts are in an order of their hashes. Other columns are not read; an empty
    table gives no rows. Whole texts are shuffled once and a third of them a second time.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"))
    rows = rows.select(F.col("doc_id").isNull().alias("is_null"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    keys = rows.groupBy("is_null", "id", "h").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"), F.count("*").alias("copies"))
    order = _ordered(keys, bucket)
    distinct = rows.groupBy("id", "h").agg(F.any_value("text").alias("text"))
    prefix = distinct.join(order.select("id", "h", "prev"), ["id", "h"])
    third = F.floor(F.col("prev.n_chars") / 3).cast("int")
    prefix = prefix.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.substring("text", F.lit(1), third).alias("prefix"))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("prefix"))
    both = distinct.join(prefix, ["id", "h"]).select("id", "h", "text", edited.alias("edited"))
    sides = both.select("id", "h", F.explode(F.array(F.struct(F.lit(0).alias("side"), "text"), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    sigs = fingerprints(sides.select("id", "h", F.col("x.side").alias("side"), F.col("x.text").alias("text")), ["id", "h", "side"], "text", samples)
    pair = sigs.groupBy("id", "h").agg(F.max(F.when(F.col("side") == 0, F.col("sig"))).alias("sig"), F.max(F.when(F.col("side") == 1, F.col("sig"))).alias("edited_sig"))
    digests = both.select("id", "h", F.sha2("edited", 256).alias("edited_sha256"))
    own = digests.join(pair, ["id", "h"], "left").join(order.select("id", "h", "is_null", "n_chars", "copies", "prev"), ["id", "h"])
    own = written(own, "fingerprints")
    ahead = own.select(F.col("prev.id").alias("id"), F.col("prev.h").alias("h"), F.col("sig").alias("next_sig"))
    out = own.join(ahead, ["id", "h"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(
        F.when(~F.col("is_null"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
