"""Mixing sources to target weights (op 8) by Poisson replication, in DataFrame functions only.

A source with target share w and size s (characters) has the repetition rate w * total / s. Each document
draws its count by inverting a Poisson distribution of that mean with a uniform number hashed from seed and
doc_id, is exploded by the count, and goes to the place that a second hash gives its copy. A rate over MAX_RATE is
split evenly into draws of at most that rate, whose sum has the whole rate's distribution; only the first is hashed
without a number.

Defined results: null source is a source of its own; n_chars that is null, negative or no number counts as 0, so no row can change the
rates of other sources; a source without characters has the rate 1; a weight that is negative, infinite or no number is refused
(ValueError); a source without a weight has the rate 0 and is left out, and where all weights are 0 all rates are 1; rows with equal doc_id draw alike; null doc_id draws as the text 'null'; an empty table gives an empty one.
All columns of docs stay; an added column whose name docs has already (in any case) gets underscores behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import fresh

#: At most so many sources are sent to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 2_000
#: Largest rate of one draw, and the most copies of one looked at; the mass beyond is under 1e-12.
MAX_RATE, MAX_COPIES = 16.0, 64
SEED = 17


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """src, rate, draws, and cdf: the distribution function of one draw's counts. Without weights, shares go with the root of the size."""
    if any(not math.isfinite(w) or w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must be finite and not negative")
    own = F.greatest(F.coalesce(F.col("n_chars").try_cast("long"), F.lit(0)), F.lit(0)).cast("double")
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("\0null")).alias("src")).agg(F.sum(own).alias("size"))
    if weights is None:
        weight = F.sqrt("size")
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("src")), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when((F.col("size") <= 0) | (F.col("weights") <= 0), 1.0).otherwise(F.col("weight") / F.col("weights") * F.col("total") / F.col("size"))
    rated = sizes.crossJoin(F.broadcast(sums)).select("src", F.round(rate, 6).alias("rate"))  # one row of sums
    rated = rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int")))
    one = F.col("rate") / F.col("draws")
    # Terms by p(k) = p(k - 1) * rate / k, summed as they come.
    start = F.struct(F.exp(-one).alias("p"), F.exp(-one).alias("sum"), F.array(F.exp(-one)).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * one / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["cdf"], F.array(acc["sum"] + p)).alias("cdf"))

    return rated.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COPIES)), start, add, lambda a: a["cdf"]))


def order_key(doc_id: Column, copy: Column, seed: int = SEED) -> Column:
    """The place of a copy in the shuffled order."""
    return F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), F.coalesce(doc_id.cast("string"), F.lit("null")), copy))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """docs with rate, n_copies, copy (from 0) and order_key; rows lie in the order of order_key within partitions."""
    rate, n_copies, copy, key, us, src, draws, cdf = fresh(docs, "rate", "n_copies", "copy", "order_key", "quill_us", "quill_src", "quill_draws", "quill_cdf")
    table = rates(docs.select("source", "n_chars"), weights).select(F.col("src").alias(src), F.col("rate").alias(rate), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, F.coalesce(F.col("source"), F.lit("\0null")) == F.col(src))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.transform(F.sequence(F.lit(0), F.col(draws) - 1), lambda j: uniform(F.when(j == 0, f"count-{seed}").otherwise(F.concat(F.lit(f"count-{seed}-"), j.cast("string"))), name))
    count = F.aggregate(us, F.lit(0), lambda n, u: n + F.size(F.filter(cdf, lambda c: c <= u)))
    counted = joined.withColumn(us, drawn).withColumn(n_copies, count)
    copies = counted.filter(F.col(n_copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_copies) - 1)))
    keyed = copies.withColumn(key, order_key(F.col("doc_id"), F.col(copy), seed)).select(*docs.columns, rate, n_copies, copy, key)
    return keyed.repartition(key).sortWithinPartitions(key)
