"""[M2, M3] Batches of segments that are asked again while answers are wrong, and then in halves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.review import answer_error

ATTEMPTS, DEPTH = 2, 2


def asked(batches: DataFrame, answer: Callable[[Column, Column], Column], attempts: int = ATTEMPTS, depth: int = DEPTH, error: Callable[[Column, Column], Column] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """batches(key, ids: the ids asked for) with, for each part that a batch ends in, ids, answer, error, depth and attempt.

    An iterative frontier: each round asks all parts that still wait. answer(ids, attempt) stands for a model call and gives a struct of arrays (ids, texts), which is
    checked as a whole (or by `error`): every id once, none else, no empty text. A part with a wrong answer waits for its next attempt; after the last one, two
    rows or more are asked again in halves, down to `depth`; what is wrong then has its error and no answer. Sound parts leave the frontier. Both counters are
    bounded, so the rounds are; keep should write each round to a table where calls cost. Null or empty batches end at once without an answer.
    """
    check = error or (lambda ids, a: answer_error(ids, a["ids"], a["texts"]))
    rest = [c for c in batches.columns if c != "ids"]
    waiting = batches.select(*rest, F.coalesce("ids", F.array().cast(dict(batches.dtypes)["ids"])).alias("ids"), F.lit(0).alias("depth"), F.lit(1).alias("attempt"))
    ended = None
    for level in range(depth + 1):
        for attempt in range(1, attempts + 1):
            called = waiting.withColumn("answer", F.explode(F.array(answer(F.col("ids"), F.lit(attempt)))))  # a generator's output is worked out once
            judged = keep(called.withColumn("error", check(F.col("ids"), F.col("answer"))).withColumn("attempt", F.lit(attempt)))
            sound = judged.filter("error is null")
            ended = sound if ended is None else ended.unionByName(sound)
            waiting = judged.filter("error is not null").drop("answer", "error")
        size = F.size("ids")
        middle = F.floor(size / 2).cast("int")
        if level == depth:
            break
        # Single rows are not asked again; they end as they are.
        ended = ended.unionByName(judged.filter((F.col("error").isNotNull()) & (size < 2)))
        halves = F.array(F.slice("ids", F.lit(1), middle), F.slice("ids", middle + 1, size))
        waiting = waiting.filter(size > 1).withColumn("ids", F.explode(halves)).withColumn("depth", F.lit(level + 1))
    out = ended.unionByName(judged.filter("error is not null"))
    return out.select(*rest, "ids", F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), "error", "depth", "attempt")
