"""Checks of source and candidate pairs, findings, roll-ups, and the repair loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

ENTITY_CODES = ("numbers", "url", "placeholder")
# What findings say.
MESSAGES = {
    "coverage": "Source segment has no translation.",
    "numbers": "Numeric entities differ from the source.",
    "url": "A URL in the source text was changed.",
    "placeholder": "Output contains an omission or error placeholder.",
}


def defects(source: Column, candidate: Column) -> Column:
    """[I3, I5, I6] Codes of the checks that a candidate fails, one for each lost link."""
    value, own = F.coalesce(candidate, F.lit("")), F.coalesce(source, F.lit(""))
    one = lambda test, code: F.when(test, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    full = F.concat(one(T.numbers_differ(own, value), "numbers"), F.transform(T.lost_urls(own, value), lambda u: F.lit("url")), one(T.has_placeholder(value), "placeholder"))
    return F.when(T.blank(value), F.array(F.lit("coverage"))).otherwise(full)


def findings(pairs: DataFrame) -> DataFrame:
    """[D4, H1] One row for each failed check of pairs(doc_id, segment_id, location, source, candidate).

    One pass: the checks of a row are an array that is exploded, not a union of scans.
    """
    table = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return pairs.select("doc_id", "segment_id", "location", F.explode(defects(F.col("source"), F.col("candidate"))).alias("code")).select("doc_id", "code", F.element_at(table, F.col("code")).alias("message"), F.lit("error").alias("severity"), "segment_id", "location")


def reports(docs: DataFrame, pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """[E1, E5, E20, H1] doc_id, status, n_errors, n_reviews: checks and status of each document from one pass over pairs; reviews(doc_id) has one row for each review finding."""
    rows = pairs.select("doc_id", defects(F.col("source"), F.col("candidate")).alias("codes"))
    sums = rows.groupBy("doc_id").agg(F.sum(F.size("codes")).alias("n_errors"))
    marks = reviews.groupBy("doc_id").agg(F.count("*").alias("n_reviews"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    joined = docs.select("doc_id").join(sums, "doc_id", "left").join(marks, "doc_id", "left").select("doc_id", zero("n_errors").alias("n_errors"), zero("n_reviews").alias("n_reviews"))
    # All findings of pairs are errors of the coverage and protected_entities checks, so a check fails exactly where there is one; both always run.
    return joined.select("doc_id", status(F.col("n_errors") > 0, F.col("n_errors") > 0, F.col("n_reviews") > 0, F.lit(False), F.lit(2)).alias("status"), "n_errors", "n_reviews")


def reconciliation(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """[D5] Keys that are missing, unknown or duplicate in an answer, with their kind."""
    seen = returned.groupBy(*keys).count()
    both = expected.select(*keys, F.lit(True).alias("_e")).join(seen, keys, "full")
    kind = F.when(F.col("_e").isNull(), "unknown").when(F.col("count").isNull(), "missing").when(F.col("count") > 1, "duplicate")
    return both.withColumn("kind", kind).filter("kind is not null").select(*keys, "kind")


def status(has_error: Column, has_failed: Column, has_review: Column, open_checks: Column, n_checks: Column) -> Column:
    """[E1] A report's status."""
    return F.when(has_error | has_failed, "failed").when(has_review | open_checks | (n_checks == 0), "needs_review").otherwise("passed")


def checks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """[E5] doc_id, check_name, status of the coverage and protected_entities checks of each document."""
    flags = found.groupBy("doc_id").agg(F.bool_or(F.col("code") == "coverage").alias("coverage"), F.bool_or(F.col("code").isin(*ENTITY_CODES)).alias("protected_entities"))
    joined = docs.select("doc_id").join(flags, "doc_id", "left")
    named = F.array(*[F.struct(F.lit(c).alias("check_name"), F.when(F.coalesce(F.col(c), F.lit(False)), "failed").otherwise("passed").alias("status")) for c in ("coverage", "protected_entities")])
    return joined.select("doc_id", F.explode(named).alias("c")).select("doc_id", "c.*")


def report_status(docs: DataFrame, found: DataFrame, check_rows: DataFrame) -> DataFrame:
    """[E1, E20] doc_id, status, n_errors, n_reviews."""
    f = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "review").alias("n_reviews"))
    c = check_rows.groupBy("doc_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"), F.bool_or(F.col("status") != "passed").alias("open"), F.count("*").alias("n"))
    joined = docs.select("doc_id").join(f, "doc_id", "left").join(c, "doc_id", "left")
    no = lambda x: F.coalesce(F.col(x), F.lit(False))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return joined.select("doc_id", status(zero("n_errors") > 0, no("failed"), zero("n_reviews") > 0, no("open"), zero("n")).alias("status"), zero("n_errors").alias("n_errors"), zero("n_reviews").alias("n_reviews"))


def failure_codes(found: DataFrame, observed: DataFrame, known: list[str]) -> DataFrame:
    """[E4, H2] doc_id, codes: sorted union of known codes from findings and of those observed before repair."""
    serious = found.filter(F.col("severity").isin("error", "review") & F.col("code").isin(*known)).select("doc_id", "code")
    return serious.unionByName(observed.filter(F.col("code").isin(*known)).select("doc_id", "code")).groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def observations(docs: DataFrame, found: DataFrame, check_rows: DataFrame, observed: DataFrame, code_checks: dict[str, str]) -> DataFrame:
    """[E4] doc_id, eligible, failures: what a finished report says about each failure code."""
    ran = check_rows.filter(F.col("status").isin("passed", "failed", "needs_review")).groupBy("doc_id").agg(F.collect_set("check_name").alias("ran"))
    broken = found.filter(F.contains("code", F.lit("unavailable")) | (F.col("code") == "specialist_error")).select("doc_id").distinct().withColumn("broken", F.lit(True))
    codes = failure_codes(found, observed, list(code_checks)).withColumnRenamed("codes", "failures")
    joined = docs.select("doc_id").join(ran, "doc_id", "left").join(broken, "doc_id", "left").join(codes, "doc_id", "left")
    empty = F.array().cast("array<string>")
    failures = F.coalesce(F.col("failures"), empty)
    could = F.array_compact(F.array(*[F.when(F.array_contains(F.coalesce("ran", empty), check), F.lit(code)) for code, check in code_checks.items()]))
    eligible = F.sort_array(F.array_union(F.when(F.coalesce("broken", F.lit(False)), empty).otherwise(could), failures))
    return joined.select("doc_id", eligible.alias("eligible"), failures.alias("failures")).filter(F.size("eligible") > 0)


def roles(segment: DataFrame, tables: bool, diagrams: bool, kind: str) -> DataFrame:
    """[C3] Adds roles: the reviewers of each segment."""
    address = F.concat("part", F.lit("/"), "location")
    is_table = (F.col("category") == "table_cell") | F.contains(address, F.lit("worksheets/")) | F.contains(address, F.lit("/tbl/")) | F.contains(address, F.lit("}tc[")) | F.lit(kind == "csv")
    is_diagram = F.contains(address, F.lit("/drawings/")) | F.contains(address, F.lit("/diagrams/")) | F.contains(address, F.lit("}cxnSp"))
    return segment.withColumn("roles", F.array_compact(F.array(F.lit("source_review"), F.when(is_table & F.lit(tables), "table_review"), F.when(is_diagram & F.lit(diagrams), "diagram_review"))))


def accepted_numbers(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[D9, M4] Findings without the numeric ones that a reviewer judged equivalent; those become info rows."""
    fine = verdicts.filter((F.col("verdict") == "equivalent") & ~T.blank(F.col("evidence"))).select("doc_id", "segment_id", "evidence")
    kept = found.join(fine.withColumn("code", F.lit("numbers")).drop("evidence"), ["doc_id", "segment_id", "code"], "left_anti").select(found.columns)
    info = fine.join(found.filter(F.col("code") == "numbers").select("doc_id", "segment_id", "location").distinct(), ["doc_id", "segment_id"])
    return kept.unionByName(info.select("doc_id", F.lit("numeric_equivalence").alias("code"), F.col("evidence").alias("message"), F.lit("info").alias("severity"), "segment_id", "location"))


def call_budget(segments: Column, pages: Column) -> Column:
    """[E19]"""
    return F.least(F.lit(512), F.greatest(F.lit(48), F.ceil(segments / 24) * 15 + pages * 12 + 10)).cast("long")


def repair_rounds(pairs: DataFrame, repair: Callable[[Column, Column], Column], cycles: int = 2, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """[M5, D7, D8] pairs with candidate and repairs after up to `cycles` repairs of the rows with findings.

    repair(source, candidate) stands for the model call. keep may write each round to a table.
    """
    rows = pairs.withColumn("repairs", F.lit(0).cast("long"))
    for _ in range(cycles):  # findings depend on their row alone, so no row needs another
        # A generator's output is worked out once, however often it is used.
        marked = rows.select("*", F.explode(F.array(F.size(defects(F.col("source"), F.col("candidate"))) > 0)).alias("_bad"))
        candidate = F.when(F.col("_bad"), repair(F.col("source"), F.col("candidate"))).otherwise(F.col("candidate"))
        rows = keep(marked.withColumns({"candidate": candidate, "repairs": F.col("repairs") + F.col("_bad").cast("long")}).drop("_bad"))
    return rows
