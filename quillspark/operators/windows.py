"""Overlapping page windows, ordered release, and runs of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# What is a table's rule line, a cell with a number, and a line of digits.
RULE_LINE = r"^\s*\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-{2,}:?\s*\|?\s*$"
NUMBER_CELL, DIGITS = r"^\p{Nd}+[.)]?$", r"^\p{Nd}+$"


def page_windows(pages: DataFrame, size: int = 6, step: int = 4) -> DataFrame:
    """doc_id, window_start (position from 0), page_nos, n_pages, body: windows over the pages in order.

    The windows of a page are computed from its position, so there is no join on ranges.
    """
    at = pages.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")) - 1)
    last = F.floor(F.col("i") / step) * step
    starts = F.filter(F.sequence(F.greatest(F.lit(0), last - size), last, F.lit(1)), lambda s: (s % step == 0) & (s <= F.col("i")) & (F.col("i") < s + size))
    each = at.withColumn("window_start", F.explode(starts))
    own = F.sort_array(F.collect_list(F.struct("page_no", "body")))
    grouped = each.groupBy("doc_id", "window_start").agg(own.alias("p"))
    return grouped.select("doc_id", F.col("window_start").cast("long").alias("window_start"), F.transform("p", lambda p: p["page_no"]).alias("page_nos"), F.size("p").cast("long").alias("n_pages"), F.array_join(F.transform("p", lambda p: p["body"]), "\n").alias("body"))


def released(results: DataFrame, key: str, index: str) -> DataFrame:
    """Rows of the contiguous prefix 0, 1, 2, ... that is complete."""
    order = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("_n", F.count("*").over(order)).filter(F.col("_n") == F.col(index) + 1).drop("_n")


def corrections(pages: DataFrame, fixes: DataFrame) -> DataFrame:
    """[D16] Fixes with the page they mean: the lowest page_no that equals n - 1 or n. Two equi joins, no cross product."""
    shifted = fixes.withColumn("page_no", F.explode(F.array(F.col("n") - 1, F.col("n"))))
    hit = shifted.join(pages.select("doc_id", "page_no"), ["doc_id", "page_no"])
    return hit.groupBy("doc_id", "n", "fix_no").agg(F.min("page_no").alias("page_no"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """[F8] doc_id, block_no, block_text: prose lines joined with the lines that go on from them; lines(doc_id, line_no, line)."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    kind = T.block_type(F.col("line"))
    joins = T.continues(F.lag("line").over(order), F.col("line")) & F.lag(kind.isin("clause", "item", "bullet", "sub_bullet", "subitem", "paragraph")).over(order)
    marked = lines.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    blocks = marked.withColumn("block_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: T.strip(x["line"])), " ")
    return blocks.groupBy("doc_id", "block_no").agg(merged.alias("block_text"))


def merged_orphans(lines: DataFrame) -> DataFrame:
    """doc_id, entry_no, entry: a line of digits joins the contents line before it."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("line", T.strip(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").rlike(T.FENCE))
    rows = rows.withColumn("orphan", F.col("line").rlike(DIGITS)).withColumn("entry_no", F.sum((~F.col("orphan")).cast("long")).over(order)).filter("entry_no > 0")
    own = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc_id", "entry_no").agg(F.array_join(F.transform(own, lambda x: x["line"]), " ··· ").alias("entry"))


def normalised_tables(pages: DataFrame) -> DataFrame:
    """[I9, E14] Pages with the rows of each pipe table padded to one width; a table that ends the page stays as it is."""
    lined = pages.filter("body is not null").select("doc_id", "page_no", F.posexplode(T.lines(F.col("body"))).alias("pos", "line"))
    s = T.strip(F.col("line"))
    pipe = s.startswith("|") | ((F.regexp_count(s, F.lit(r"\|")) >= 2) & ~s.rlike("^(#|Article|Chapter|Section)"))
    page = Window.partitionBy("doc_id", "page_no").orderBy("pos")
    rows = lined.withColumn("s", s).withColumn("pipe", pipe)
    rows = rows.withColumn("island", F.sum((F.col("pipe") != F.coalesce(F.lag("pipe").over(page), ~F.col("pipe"))).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    rule = F.col("s").rlike(RULE_LINE)
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), lambda c: T.strip(c))
    rows = rows.withColumn("rule", rule).withColumn("cells", cells)
    island = Window.partitionBy("doc_id", "page_no", "island")
    rows = rows.withColumn("width", F.max(F.when(~F.col("rule"), F.size("cells"))).over(island)).withColumn("tail", F.max("pos").over(island) == F.max("pos").over(Window.partitionBy("doc_id", "page_no")))
    c, w = F.col("cells"), F.col("width")
    left = ~F.get(c, F.lit(0)).rlike(NUMBER_CELL) & (F.size(c) == w - 1)
    padded = F.when(F.size(c) >= w, c).when(left, F.concat(F.array(F.lit("")), c)).otherwise(F.concat(c, F.array_repeat(F.lit(""), F.greatest(F.lit(0), w - F.size(c)))))
    out = F.when(~F.col("pipe"), F.col("line")).when(F.col("tail") | w.isNull(), F.col("s"))
    out = out.when(F.col("rule"), F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), w), "|"), F.lit("|"))).otherwise(F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |")))
    return rows.withColumn("out", out).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "\n").alias("body"))
