"""[M15] The page loop: pages go through the critics, and those that fail go back, until none is left on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

Worker = Callable[[Column, Column], Column]


def page_loop(pages: DataFrame, translate: Worker, format_: Worker, retries: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """pages(doc_id, page_no, body, and toc, nested, tiers, columns: what the page's layout needs) with draft, translations, formats, defects and status.

    An iterative frontier: each round runs one node for all pages that wait at it. translate(body, attempt) gives a draft, which the draft critic
    (I7) judges; format_(draft, attempt) its layout, which the layout critic (I8) judges. A page whose critic finds defects goes back to the node before
    it while it has been there at most `retries` times, and else goes on with its defects; pages that are through leave the frontier, so later rounds
    hold only what failed. translate and format_ stand for model calls; keep should write each round to a table then, so that no call is made twice.
    Counters end the loop after 2 * (retries + 1) rounds. defects are the last ones of both critics.
    """
    names = pages.columns
    none = F.array().cast("array<string>")
    flags = [F.col(c) for c in ("toc", "nested", "tiers", "columns")]
    waiting = pages.select("*", F.lit(None).cast("string").alias("draft"), F.lit(0).alias("translations"), F.lit(0).alias("formats"), none.alias("draft_defects"), none.alias("layout_defects"))

    def through(node: str, worker: Callable[[], Column], critic: Callable[[], Column], frontier: DataFrame) -> DataFrame:
        counter, found = ("translations", "draft_defects") if node == "translate" else ("formats", "layout_defects")
        passed = None
        for _ in range(retries + 1):
            tried = frontier.withColumn(counter, F.col(counter) + 1).withColumn("draft", worker())
            judged = keep(tried.withColumn(found, F.explode(F.array(critic()))))  # a generator's output is worked out once
            done = judged.filter((F.size(found) == 0) | (F.col(counter) > retries))
            passed = done if passed is None else passed.unionByName(done)
            frontier = judged.filter((F.size(found) > 0) & (F.col(counter) <= retries))
        return passed

    drafted = through("translate", lambda: translate(F.col("body"), F.col("translations")), lambda: T.draft_defects(F.col("draft"), F.lit(True)), waiting)
    # A page is formatted from its draft anew each time.
    formatted = through("format", lambda: format_(F.col("drafted"), F.col("formats")), lambda: T.layout_defects(F.col("draft"), *flags), drafted.withColumn("drafted", F.col("draft")))
    defects = F.concat("draft_defects", "layout_defects")
    return formatted.select(*names, "draft", "translations", "formats", defects.alias("defects"), F.when(F.size(defects) == 0, "passed").otherwise("needs_review").alias("status"))
