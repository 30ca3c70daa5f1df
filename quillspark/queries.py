"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.arrow import nfkc
from quillspark.operators import checks, feedback, jobs, limits, names, segments, windows
from quillspark.plans import relations as R
from quillspark.sources import parsers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f



def _now():
    return F.expr(R.NOW)


def _jobs_now():
    return F.expr(R.JOBS_NOW)


def _joined(*columns: str):
    return [F.array_join(c, ",").alias(c) for c in columns]


# Segments


@query
def text_segments(spark, sf):
    """A10, A16, F3, I1"""
    return R.segments(spark, sf).drop("part")


@query
def segment_stats_by_lang(spark, sf):
    rows = R.segments(spark, sf).join(R.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n_segments"), F.sum(F.length("source")).cast("long").alias("n_chars"), F.max(F.length("source")).cast("long").alias("longest"), F.min("segment_id").alias("first_id"))


@query
def segment_batches(spark, sf):
    """F4"""
    rows = segments.batches(R.segments(spark, sf), "doc_id", "line_no")
    return rows.groupBy("doc_id", "batch").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query
def neighbour_context(spark, sf):
    """F2, G7"""
    return segments.neighbours(R.segments(spark, sf), "doc_id", "line_no").select("doc_id", "line_no", "around")


@query
def context_dictionary(spark, sf):
    """C1"""
    rows = R.segments(spark, sf).withColumn("context", F.left("source", F.lit(12)))
    return segments.context_dictionary(rows, "doc_id", "line_no").select("doc_id", "line_no", "context", "context_ref")


@query
def rendered_documents(spark, sf):
    """B3, B4, D12"""
    pairs = R.pairs(spark, sf)
    out = segments.replaced(R.table(spark, sf, "documents").select("doc_id", "text"), pairs.drop("candidate"), pairs)
    return out.select("doc_id", F.length("rendered").cast("long").alias("n_chars"), F.md5("rendered").alias("digest"))


# Checks


@query
def segment_findings(spark, sf):
    """D4, I3, I5, I6, H1"""
    return checks.findings(R.pairs(spark, sf))


@query
def conversion_candidates(spark, sf):
    """I4"""
    p = R.pairs(spark, sf).withColumn("candidate", F.coalesce("candidate", F.lit("")))
    both = p.filter(T.numbers_differ(F.col("source"), F.col("candidate"))).select("doc_id", "segment_id", nfkc("source").alias("source"), nfkc("candidate").alias("candidate"))
    return both.select("doc_id", "segment_id", T.conversion_candidate(F.col("source"), F.col("candidate")).alias("plausible"))


@query
def normalised_numbers(spark, sf):
    """I2, E10 over NFKC text"""
    rows = R.table(spark, sf, "documents").select("doc_id", T.numbers(F.col("text")).alias("numbers")).filter(F.size("numbers") > 0)
    return rows.select("doc_id", F.size("numbers").cast("long").alias("n"), *_joined("numbers"))


@query
def id_reconciliation(spark, sf):
    """D5, H4"""
    s = R.segments(spark, sf).select("doc_id", "line_no")
    back = s.filter("(doc_id + line_no) % 7 <> 0").unionByName(s.filter("(doc_id + line_no) % 11 = 1")).unionByName(s.filter("line_no % 5 = 0").withColumn("line_no", F.col("line_no") + 100000))
    return checks.reconciliation(s, back, ["doc_id", "line_no"])


@query
def check_rollup(spark, sf):
    """E5"""
    return checks.checks(R.table(spark, sf, "documents"), checks.findings(R.pairs(spark, sf)))


def _statuses(spark, sf):
    docs = R.table(spark, sf, "documents")
    found = checks.findings(R.pairs(spark, sf)).select("doc_id", "code", "severity")
    marks = R.table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("code"), F.lit("review").alias("severity"))
    rolled = checks.checks(docs, found)
    return docs, found.unionByName(marks), rolled


def _reports(spark, sf):
    docs = R.table(spark, sf, "documents")
    return docs, checks.reports(docs, R.pairs(spark, sf), R.table(spark, sf, "labels").filter("toxic = 1").select("doc_id"))


@query
def report_status(spark, sf):
    """E1, H1, E20"""
    return _reports(spark, sf)[1]


@query
def segment_quality_report(spark, sf):
    """The flagship: documents by language and delivery status."""
    docs, rows = _reports(spark, sf)
    rows = rows.join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", "status").agg(F.count("*").alias("n_docs"), F.sum("n_errors").alias("n_errors"), F.sum("n_reviews").alias("n_reviews"))


@query
def failure_codes(spark, sf):
    """E4, H2"""
    found = checks.findings(R.pairs(spark, sf))
    observed = R.table(spark, sf, "labels").filter("quality = 0").select("doc_id", F.lit("visual").alias("code"))
    return checks.failure_codes(found, observed, list(feedback.CODE_CHECKS)).select("doc_id", *_joined("codes"))


@query
def report_observations(spark, sf):
    """E4"""
    docs, found, rolled = _statuses(spark, sf)
    observed = R.table(spark, sf, "labels").filter("quality = 0").select("doc_id", F.lit("visual").alias("code"))
    return checks.observations(docs, found, rolled, observed, feedback.CODE_CHECKS).select("doc_id", *_joined("eligible", "failures"))


@query
def segment_roles(spark, sf):
    """C3"""
    rows = R.segments(spark, sf).withColumn("category", F.when(F.col("line_no") % 4 == 0, "table_cell").otherwise("text")).withColumn("part", F.when(F.col("line_no") % 6 == 0, "xl/drawings/drawing1.xml").otherwise(F.col("part")))
    return checks.roles(rows, True, True, "txt").select("doc_id", "line_no", *_joined("roles"))


@query
def accepted_numbers(spark, sf):
    """D9, M4"""
    found = checks.findings(R.pairs(spark, sf))
    verdicts = found.filter("code = 'numbers'").select("doc_id", "segment_id").distinct().withColumn("verdict", F.when(F.col("doc_id") % 2 == 0, "equivalent").otherwise("different")).withColumn("evidence", F.lit("same quantity"))
    return checks.accepted_numbers(found, verdicts).groupBy("doc_id", "code", "severity").agg(F.count("*").alias("n"))


@query
def repair_rounds(spark, sf):
    """The model is a stub that drops digits and placeholders, or gives the source back"""
    fix = lambda s, c: F.when(T.blank(c), s).otherwise(F.regexp_replace(F.regexp_replace(c, " 7$", ""), r"\[omitted\]", ""))
    rows = checks.repair_rounds(R.pairs(spark, sf).select("doc_id", "segment_id", "location", "source", "candidate"), fix)
    return rows.groupBy("doc_id").agg(F.sum("repairs").alias("repairs"), F.count_if(F.size(checks.defects(F.col("source"), F.col("candidate"))) > 0).alias("unresolved"))


@query
def call_budget(spark, sf):
    """E19"""
    n = R.segments(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    return n.select("doc_id", "n_segments", checks.call_budget(F.col("n_segments"), F.lit(1)).alias("budget"))


# Evidence


@query
def feedback_evidence(spark, sf):
    """E2, J1"""
    rows = R.observations(spark, sf)
    return feedback.evidence(rows.filter(feedback.in_window(F.col("ts"), _now())))


@query
def active_rules(spark, sf):
    """E3, D18"""
    rows = R.observations(spark, sf)
    return feedback.active_rules(feedback.evidence(rows.filter(feedback.in_window(F.col("ts"), _now())))).select("kind", *_joined("rules"))


@query
def observations_latest(spark, sf):
    """G2"""
    return feedback.latest(R.observations(spark, sf).filter(F.col("ts") <= _now())).select("kind", "obs_id", F.col("position").cast("long").alias("position"))


@query
def evidence_fold(spark, sf):
    """J2, H6"""
    return feedback.admitted(R.observations(spark, sf), days=5, cap=50)


@query
def rate_limited_requests(spark, sf):
    """J4 with 3 requests a day"""
    return limits.limited(R.requests(spark, sf), 3, 86_400).select("identity", "request_id", "accepted", "retry_seconds")


def _event_stream(spark, sf):
    return spark.readStream.schema(R.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def windowed_evidence(spark, sf):
    """J1 as a stream: windows that the watermark has closed"""
    from quillspark.streaming import folds

    rows = folds.run_to_end(folds.windowed_evidence(R.observed(_event_stream(spark, sf))), "windowed_evidence")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "kind", "documents", "failures")


@query
def stream_limiter(spark, sf):
    """J4 as a stream; equal to rate_limited_requests"""
    from quillspark.streaming import folds

    rows = _event_stream(spark, sf).select(F.col("user_id").alias("identity"), F.col("event_id").alias("request_id"), "ts")
    return folds.run_to_end(folds.limited_stream(rows, 3, 86_400), "stream_limiter_rows").select("identity", "request_id", "accepted", "retry_seconds")


# Jobs


@query
def recovered_jobs(spark, sf):
    """K1"""
    return jobs.recovered(R.jobs(spark, sf), _jobs_now()).groupBy("state").agg(F.count("*").alias("n"), F.count("owner").alias("owned"), F.min("id").alias("first_id"))


@query
def provider_load(spark, sf):
    """E8"""
    return jobs.provider_load(R.jobs(spark, sf))


@query
def claimable_jobs(spark, sf):
    """K2, D1, G1"""
    return jobs.claimable(jobs.recovered(R.jobs(spark, sf), _jobs_now()), R.batches(spark, sf), _jobs_now(), 300, 40)


@query
def beating_jobs(spark, sf):
    """K3, D3"""
    return jobs.beating(R.jobs(spark, sf), R.batches(spark, sf), _jobs_now()).select("id", "owner")


@query
def finished_jobs(spark, sf):
    """K4, B12"""
    return jobs.finished(R.jobs(spark, sf), F.lit("needs_review")).select("id", "state", "progress", "artifact")


@query
def cancelled_jobs(spark, sf):
    """K5"""
    return jobs.cancelled(R.jobs(spark, sf)).groupBy("state", "cancel_requested").agg(F.count("*").alias("n"))


@query
def resumed_jobs(spark, sf):
    """K5, I32"""
    return jobs.resumed(R.jobs(spark, sf)).groupBy("state").agg(F.count("*").alias("n"), F.sum("model_calls").alias("model_calls"), F.sum("previous_model_calls").alias("previous_model_calls"), F.count_if("cancel_requested").alias("cancels"))


def _asked(spark, sf):
    o = R.table(spark, sf, "orders")
    shift = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    rows = o.select(F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"), F.md5((F.col("o_custkey") + shift).cast("string")).alias("token_hash"), F.md5(F.when(F.col("o_orderkey") % 4 == 0, F.lit("other")).otherwise(F.col("o_orderpriority"))).alias("fingerprint"))
    return rows


@query
def submit_outcomes(spark, sf):
    """K6, E18"""
    return jobs.submit_outcomes(_asked(spark, sf), R.batches(spark, sf), _jobs_now())


@query
def batch_access(spark, sf):
    """K7"""
    return jobs.authorised(_asked(spark, sf), R.batches(spark, sf), _jobs_now())


@query
def batch_exits(spark, sf):
    """E9"""
    return jobs.batch_exits(R.jobs(spark, sf))


@query
def batch_snapshots(spark, sf):
    """K7, E7, E9"""
    return jobs.snapshots(R.jobs(spark, sf))


@query
def expired_jobs(spark, sf):
    """K8, D2, J7"""
    return jobs.expired(R.jobs(spark, sf), R.batches(spark, sf), _jobs_now()).groupBy("state", "cancel_requested").agg(F.count("*").alias("n"), F.count("owner").alias("owned"))


@query
def upload_breaches(spark, sf):
    """C14, F6"""
    return jobs.over_limits(R.jobs(spark, sf), 5, 4_900_000, 10_000_000).select("id", "batch_id", "breach")


@query
def job_progress(spark, sf):
    """J6"""
    rows = R.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.col("value").cast("int").alias("progress"), F.concat("event_type", F.lit(":"), "event_id").alias("message"))
    return jobs.progress(rows)


@query
def run_log_tail(spark, sf):
    """B10, G3, A33"""
    return jobs.run_log(R.table(spark, sf, "events"), 100).select("event_id", "event_type")


# Pages


@query
def review_windows(spark, sf):
    """F1"""
    rows = windows.page_windows(R.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.col("text").alias("body")))
    return rows.select("doc_id", "window_start", "n_pages", F.array_join("page_nos", ",").alias("page_nos"), F.md5("body").alias("digest"))


@query
def released_pages(spark, sf):
    """F5"""
    rows = R.pages(spark, sf).filter("(doc_id + page_no) % 6 <> 4")
    return windows.released(rows, "doc_id", "page_no").select("doc_id", "page_no")


@query
def page_corrections(spark, sf):
    """D16"""
    p = R.pages(spark, sf)
    fixes = p.select("doc_id", (F.col("page_no") + 1).alias("n"), F.col("page_no").alias("fix_no"))
    return windows.corrections(p.filter("page_no % 3 <> 1"), fixes)


@query
def page_lint(spark, sf):
    """I7"""
    p = R.pages(spark, sf)
    rows = p.withColumn("defects", T.draft_defects(F.when(F.col("page_no") == 6, F.lit("  ")).otherwise(F.col("body")), F.lit(True)))
    return rows.select("doc_id", "page_no", *_joined("defects"))


@query
def layout_lint(spark, sf):
    """I8, E14"""
    n = F.col("page_no")
    rows = R.pages(spark, sf).withColumn("defects", T.layout_defects(F.col("body"), n % 3 == 0, n % 4 == 1, n % 2 == 0, F.lit(True)))
    return rows.select("doc_id", "page_no", *_joined("defects"))


@query
def page_kinds(spark, sf):
    """E15, I18"""
    return R.pages(spark, sf).select("doc_id", "page_no", T.is_toc(F.col("body")).alias("toc"), T.is_cover(F.col("body")).alias("cover"))


@query
def block_types(spark, sf):
    """I14"""
    rows = R.pages(spark, sf).select(F.explode(T.lines(F.col("body"))).alias("line"))
    return rows.groupBy(T.block_type(F.col("line")).alias("block_type")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def _lines(spark, sf):
    return R.pages(spark, sf).select((F.col("doc_id") * 100 + F.col("page_no")).alias("doc_id"), F.posexplode(T.lines(F.col("body"))).alias("line_no", "line"))


@query
def paragraph_blocks(spark, sf):
    """F8"""
    return windows.paragraphs(_lines(spark, sf)).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "block_text")


@query
def toc_entries(spark, sf):
    """F7"""
    return windows.merged_orphans(_lines(spark, sf))


@query
def table_normalize(spark, sf):
    """I9, E14"""
    return windows.normalised_tables(R.pages(spark, sf)).select("doc_id", "page_no", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


# Structured text


@query
def json_leaves(spark, sf):
    """A13, A16"""
    rows = R.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.to_json(F.struct(F.struct("event_type", F.col("value").alias("v")).alias("a/b"), F.array("event_type").alias("list"))).alias("text"))
    return parsers.segments(rows, "json").select("doc_id", "location", "source", "context")


@query
def html_text_nodes(spark, sf):
    """Tested against hand-made pages"""
    return parsers.segments(R.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html"), "html", "html")


@query
def html_objects(spark, sf):
    """A15 over pages with objects of each kind added"""
    extra = F.get(F.array(*[F.lit(x) for x in ("<table><tr><td>x</td></tr></table>", "<img alt='y'/>", "<p>none</p>", "<svg><g/></svg><img>")]), (F.col("page_id") % 4).cast("int"))
    return parsers.html_objects(R.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.concat("html", extra).alias("html")), "html")


@query
def csv_cells(spark, sf):
    """A12"""
    rows = R.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit('"'), F.concat_ws('","', "p_name", "p_brand", F.concat(F.lit("="), "p_type"), "p_size"), F.lit('"')).alias("text"))
    return parsers.segments(rows, "csv").select("doc_id", "location", "category", "source")


@query
def markdown_spans(spark, sf):
    """Tested against hand-made pages"""
    rows = R.pages(spark, sf).select((F.col("doc_id") * 100 + F.col("page_no")).alias("doc_id"), F.col("body").alias("text"))
    return parsers.segments(rows, "md")


@query
def sheet_names(spark, sf):
    """I20"""
    rows = R.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("workbook"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("original"), F.when(F.col("c_custkey") % 9 == 0, F.lit("History")).otherwise(F.concat("c_mktsegment", F.lit("/sheet"))).alias("wanted"))
    return names.sheet_names(rows)


@query
def retry_delays(spark, sf):
    """I26, C9"""
    n = F.col("event_id")
    message = F.when(n % 5 == 0, "HTTP 429").when(n % 5 == 1, F.concat(F.lit("Rate limit: retry after "), n % 90, F.lit("s"))).when(n % 5 == 2, "RESOURCE_EXHAUSTED; retry in 0.5 s").otherwise("bad request")
    header = F.when(n % 7 == 0, (n % 40).cast("string"))
    return R.table(spark, sf, "events").select("event_id", T.retry_delay(message, header, (n % 8).cast("int")).alias("delay"), T.transient_delay((n % 8).cast("int")).alias("transient"), T.is_transient((n % 600).cast("int"), n % 2 == 0).alias("is_transient"))


@query
def normalised_settings(spark, sf):
    """I24, I27, I28, I23, C7, C8"""
    n = F.col("c_custkey")
    language = F.get(F.array(*[F.lit(x) for x in (" German", "FRENCH", "Simplified Chinese", "Klingon")]), (n % 4).cast("int"))
    path = F.get(F.array(*[F.lit(x) for x in ("/jobs/batches", "/translate/text", "/other")]), (n % 3).cast("int"))
    provider = F.get(F.array(*[F.lit(x) for x in ("Google Translate", " google-translate ", "other")]), (n % 3).cast("int"))
    name = F.concat(F.lit("up\\dir/"), "c_name", F.lit(".docx"))
    return R.table(spark, sf, "customer").select("c_custkey", T.language_code(language).alias("language"), T.body_limit(path).alias("body_limit"), T.is_free_provider(provider).alias("free"), T.safe_name(name).alias("file"), T.model_id(F.concat(F.lit("models/Nova "), "c_nationkey", F.lit(" Pro!")), "nova-1", "nova-").alias("model"), T.is_number(F.concat(F.lit("1,"), "c_custkey", F.when(n % 3 == 0, "x").otherwise(""))).alias("numeric"))
