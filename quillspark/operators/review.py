"""Review of answers: validation, drafts and acceptances, plans, page gates, fingerprints, feedback state. Ids in brackets are SURVEY section 2's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The tools of a plan, kinds without pages, and limits.
TOOLS = ("diagram_review", "native_translation", "source_review", "table_review", "vision_translation", "visual_review")
TEXT_KINDS = ("txt", "md", "csv", "json", "html", "htm")
PAGE_KINDS = ("pdf", "png", "jpg", "jpeg", "webp")
VERDICTS = ("equivalent", "different", "uncertain")
CHECK_RANK = ("passed", "needs_review", "unavailable")
SURE = 0.7
STATE_VERSION, STATE_ROWS, KEY_LENGTH = 1, 200, 64
SECRET_KEYS = ("api_key", "access_token", "authorization", "token")


def answer_error(expected: Column, ids: Column, texts: Column) -> Column:
    """[M2, L4, D5] What is wrong with an answer (null for nothing): arrays of the ids asked for, and of the ids and texts that came back."""
    blank = F.exists(texts, lambda t: T.blank(t))
    wrong = F.exists(ids, lambda i: i.isNull() | ~F.array_contains(expected, i)) | (F.size(F.array_distinct(ids)) < F.size(ids))
    return F.when(F.size(ids) != F.size(texts), "record").when(wrong, "id").when(blank, "text").when(F.size(F.array_except(expected, ids)) > 0, "omitted")


def review_error(expected: Column, reviewed: Column, ids: Column, messages: Column) -> Column:
    """[M3] What is wrong with a reviewer's answer: every id must be reviewed once, and findings must name one and say something."""
    all_once = (F.size(reviewed) == F.size(F.array_distinct(expected))) & (F.size(F.array_except(expected, reviewed)) == 0) & (F.size(F.array_except(reviewed, expected)) == 0)
    return F.when(~F.coalesce(all_once, F.lit(False)), "coverage").when(F.exists(ids, lambda i: ~F.array_contains(expected, i)) | F.exists(messages, lambda m: T.blank(m)), "finding")


def verdict_error(expected: Column, ids: Column, verdicts: Column, evidence: Column) -> Column:
    """[M4] What is wrong with numeric verdicts: one for each id, of a known kind, with evidence."""
    once = (F.size(ids) == F.size(expected)) & (F.size(F.array_except(expected, ids)) == 0)
    return F.when(~once, "omitted").when(F.exists(verdicts, lambda v: ~v.isin(*VERDICTS)) | F.exists(evidence, lambda e: T.blank(e)), "evidence")


def halves(batch: Column, depth: int = 2) -> Column:
    """[M2, M3] The batches that an answer which stays wrong is asked again in: halved `depth` times, single rows not any more."""
    parts = F.array(batch)
    for _ in range(depth):
        cut = lambda p: F.when(F.size(p) > 1, F.array(F.slice(p, F.lit(1), F.floor(F.size(p) / 2).cast("int")), F.slice(p, F.floor(F.size(p) / 2).cast("int") + 1, F.size(p)))).otherwise(F.array(p))
        parts = F.flatten(F.transform(parts, cut))
    return parts


def located(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """[D6] findings(doc_id, segment_id, message) with the address of their segment."""
    return findings.join(segments.select("doc_id", "segment_id", "location"), ["doc_id", "segment_id"])


def cached(segments: DataFrame, acceptances: DataFrame, drafts: DataFrame) -> DataFrame:
    """[D10, J5] segments(doc_id, segment_id, roles) with value and origin: an acceptance that covers all roles, else a draft, else nothing. Tables are bound to a fingerprint."""
    keys = ["doc_id", "fingerprint", "segment_id"]
    a = acceptances.select(*keys, F.col("text").alias("_a"), F.col("roles").alias("_r"))
    d = drafts.select(*keys, F.col("text").alias("_d"))
    good = ~T.blank(F.col("_a")) & (F.size(F.array_except("roles", "_r")) == 0)
    joined = segments.join(a, keys, "left").join(d, keys, "left")
    origin = F.when(good, "acceptance").when(~T.blank(F.col("_d")), "draft")
    return joined.withColumns({"origin": origin, "value": F.when(origin == "acceptance", F.col("_a")).when(origin == "draft", F.col("_d"))}).drop("_a", "_r", "_d")


def semantic_check(statuses: DataFrame) -> DataFrame:
    """[E6] doc_id, semantic: the worst of the batches' statuses; unavailable before needs_review before passed."""
    rank = F.array_position(F.array(*[F.lit(x) for x in CHECK_RANK]), F.col("status"))
    return statuses.groupBy("doc_id").agg(F.max(rank).alias("_r")).select("doc_id", F.element_at(F.array(*[F.lit(x) for x in CHECK_RANK]), F.col("_r").cast("int")).alias("semantic"))


def canonical(*values: Column) -> Column:
    """Text that two rows share only if all values are equal: each with its length before it."""
    one = lambda v: F.when(v.isNull(), "-").otherwise(F.concat(F.length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")))
    return F.concat(*[one(v) for v in values])


def fingerprints(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """[E17] doc_id, fingerprint of documents(doc_id, digest, kind, target, model, rules, glossary) and their segments in order."""
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "segment_id", "source"))), lambda s: canonical(s["segment_id"], s["source"])), "")
    parts = segments.groupBy("doc_id").agg(own.alias("_s"))
    names = ("digest", "kind", "target", "model", "rules", "glossary")
    return documents.join(parts, "doc_id", "left").select("doc_id", F.sha2(canonical(*map(F.col, names), F.coalesce("_s", F.lit(""))), 256).alias("fingerprint"))


def submission(files: DataFrame) -> DataFrame:
    """[E18] batch_id, fingerprint of files(batch_id, pos, name, digest, options) in submission order."""
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "digest"))), lambda f: canonical(f["name"], f["digest"])), "")
    return files.groupBy("batch_id").agg(own.alias("_f"), F.max("options").alias("_o")).select("batch_id", F.sha2(canonical(F.col("_f"), F.col("_o")), 256).alias("fingerprint"))


def planned_tools(kind: Column, scanned: Column, tables: Column, diagrams: Column, rule_tools: Column, chosen: Column, confidence: Column) -> Column:
    """[M1, H3] Struct of tools, findings: baseline, optional and rule tools, then a planner's choice if it is valid; ordered, each once."""
    text = kind.isin(*TEXT_KINDS)
    base = F.array_compact(F.array(F.when(scanned, "vision_translation").otherwise("native_translation"), F.lit("source_review"), F.when(~text, "visual_review"), F.when(tables, "table_review"), F.when(diagrams, "diagram_review")))
    rules = F.filter(rule_tools, lambda t: ~(text & (t == "visual_review")))
    known = F.forall(chosen, lambda t: t.isin(*TOOLS)) & ~(F.array_contains(chosen, "vision_translation") & ~kind.isin(*PAGE_KINDS)) & confidence.between(0, 1)
    good = F.coalesce(known, F.lit(False))
    tools = F.array_distinct(F.concat(base, rules, F.when(good, chosen).otherwise(F.array().cast("array<string>"))))
    findings = F.array_compact(F.array(F.when(~good, "planner_fallback"), F.when(good & (confidence < SURE), "plan_confidence")))
    return F.struct(tools.alias("tools"), findings.alias("findings"))


STATE = "struct<version:int,salt:string,observations:array<struct<id:string,time:double,eligible:array<string>,failures:array<string>>>>"


def state_error(text: Column, codes: list[str]) -> Column:
    """[A28] What is wrong with a stored feedback state: 'state' or 'observation'; null for nothing."""
    s = F.from_json(text, STATE)
    known = F.array(*[F.lit(c) for c in codes])
    rows = s["observations"]
    state = s.isNull() | (s["version"] != STATE_VERSION) | (F.length(s["salt"]) != KEY_LENGTH) | rows.isNull() | (F.size(rows) > STATE_ROWS)
    bad = lambda r: r["id"].isNull() | (F.length(r["id"]) != KEY_LENGTH) | r["time"].isNull() | r["eligible"].isNull() | r["failures"].isNull() | (F.size(F.array_except(F.array_union(r["eligible"], r["failures"]), known)) > 0) | (F.size(F.array_except(r["failures"], r["eligible"])) > 0)
    return F.when(F.coalesce(state, F.lit(True)), "state").when(F.coalesce(F.exists(rows, bad), F.lit(True)), "observation")


def appended(states: DataFrame, writes: DataFrame, attempts: int = 3) -> DataFrame:
    """[B9] kind, write_id, generation, outcome of writes(kind, write_id, seen) to states(kind, generation): a write wins if it saw the newest generation or has
    an attempt left to read again; writes of a kind go one after the other by write_id, and each that loses a race has used one attempt."""
    order = Window.partitionBy("kind").orderBy("write_id")
    rows = writes.join(states, "kind").withColumn("turn", F.row_number().over(order) - 1)
    lost = F.greatest(F.lit(0), F.col("generation") + F.col("turn") - F.col("seen"))
    return rows.select("kind", "write_id", (F.col("generation") + F.col("turn") + 1).cast("long").alias("generation"), F.when(lost < attempts, "written").otherwise("skipped").alias("outcome"))


def sanitised(settings: Column, is_bytes: Column) -> Column:
    """[C12] A map of settings whose keys are paths (a.b.c): secret values are redacted at any depth, byte values (named in is_bytes) give their length."""
    last = lambda k: F.lower(F.substring_index(k, ".", -1))
    return F.transform_values(settings, lambda k, v: F.when(last(k).isin(*SECRET_KEYS), "[redacted]").when(F.array_contains(is_bytes, k), F.concat(F.when(last(k) == "image_bytes", "<image_bytes len=").otherwise("<bytes len="), F.octet_length(v).cast("string"), F.lit(">"))).otherwise(v))


def retry_schedule(limit: int = 3) -> Column:
    """[J9, I26] Seconds waited before each retry of a transient failure."""
    return F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda n: T.transient_delay(n))


def patched(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """[R16] Segments whose source is in labels(source, label), with it as value and the status needs_review."""
    return segments.join(labels, "source").withColumns({"value": F.col("label"), "status": F.lit("needs_review")}).drop("label")


def autofit(scale: Column) -> Column:
    """[R6] The next font scale of a text box that overflows: null below 65 %, else 85 % of it but 55 % at least."""
    return F.when(scale >= 65_000, F.greatest(F.lit(55_000), F.floor(scale * 0.85).cast("int")))


def page_status(text: Column, darkest: Column, scale: Column, compact: Column) -> Column:
    """[R2, R3] Findings of a typeset page: blank (no text and nothing darker than 245), small text under 0.45, and the compact layout."""
    return F.array_compact(F.array(F.when(T.blank(text) & (darkest >= 245), "blank_page"), F.when(scale < 0.45, "small_text"), F.when(compact, "compact_layout")))


def header_runs(cells: DataFrame, least: int = 3) -> DataFrame:
    """row_id, first_col, n_cols, label: the same label over `least` columns or more of a header row (gaps and islands)."""
    order = Window.partitionBy("row_id").orderBy("col_no")
    new = F.coalesce(F.col("label") != F.lag("label").over(order), F.lit(True)).cast("int")
    runs = cells.withColumn("_n", new).withColumn("_run", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row_id", "_run", "label").agg(F.min("col_no").alias("first_col"), F.count("*").alias("n_cols")).filter(F.col("n_cols") >= least).drop("_run")


def sections_of(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """[D11] text, sections: the sorted sections that hold each text."""
    each = sections.select("section", F.explode("texts").alias("text"))
    return texts.select("text").distinct().join(each, "text").groupBy("text").agg(F.sort_array(F.collect_set("section")).alias("sections"))


def first_texts(rows: DataFrame, key: str, order: str, n: int = 10) -> DataFrame:
    """[E16, G4] The first n different texts of each key in order: key, texts."""
    first = rows.groupBy(key, "text").agg(F.min(order).alias("_at"))
    own = F.row_number().over(Window.partitionBy(key).orderBy("_at", "text"))
    return first.withColumn("_n", own).filter(F.col("_n") <= n).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("texts"))


def longest_first(texts: Column) -> Column:
    """[G5] Texts in the order in which they are replaced: longer ones first, so that none spoils one that holds it."""
    return F.transform(F.sort_array(F.transform(texts, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def slide_of_page(pages: DataFrame, slides: DataFrame) -> DataFrame:
    """[D15] Rendered pages with the slide part of the same place."""
    return pages.join(slides.select("path", F.col("pos").alias("page_no"), "part"), ["path", "page_no"])


def partial_parts(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """[C6] The parts of a partial sample."""
    return parts.join(wanted.select("path", "name"), ["path", "name"], "left_semi")


def snapshot(report: Column, full: Column, keys: tuple[str, ...]) -> Column:
    """[C2] A report map with all keys, or with those that a snapshot shows."""
    return F.when(full, report).otherwise(F.map_filter(report, lambda k, v: k.isin(*keys)))


def model_options(items: DataFrame, excluded: tuple[str, ...], wanted: tuple[str, ...], free: tuple[str, str]) -> DataFrame:
    """[A30, C10, R11] id, name of items(pos, id, name): allowed ones, the first of each id, and the free provider if it is missing."""
    id_, name = T.strip(F.col("id")), T.strip(F.col("name"))
    is_free = T.is_free_provider(id_) | T.is_free_provider(name)
    rows = items.select("pos", F.when(is_free, free[0]).otherwise(id_).alias("id"), F.when(is_free, free[1]).otherwise(F.when(name == "", id_).otherwise(F.coalesce(name, id_))).alias("name"))
    low = lambda c: F.lower(F.col(c))
    has = lambda c, words: F.lit(False) if not words else F.array_max(F.array(*[low(c).contains(w).cast("int") for w in words])) == 1
    allowed = lambda c: ~has(c, excluded) & has(c, wanted)
    kept = rows.filter((F.col("id") != "") & ((F.col("id") == free[0]) | allowed("id") | allowed("name")))
    extra = items.sparkSession.createDataFrame([(1 << 60, *free)], "pos long, id string, name string")
    first = Window.partitionBy("id").orderBy("pos")
    return kept.unionByName(extra).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("id", "name")


def model_score(name: Column, order: tuple[str, ...]) -> Column:
    """[G6] Sort key of a model: its version, then its family by `order`; larger is better."""
    version = F.regexp_extract(name, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    family = F.lit(0)
    for k, word in enumerate(reversed(order), 1):
        family = F.when(F.contains(name, F.lit(word)), k).otherwise(family)
    return F.coalesce(version, F.lit(0.0)) * 10 + family


def channels(colour: Column) -> Column:
    """[I30] Hex form of a colour number."""
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(colour.bitwiseAND(0xFFFFFF))), 6, "0"))


def untagged(text: Column) -> Column:
    """[I30] Text without its tags."""
    return F.regexp_replace(text, r"<[^>]+>", "")


def planned_stages(files: DataFrame, stages: dict[str, tuple[str, ...]]) -> DataFrame:
    """[C15] files(path, ...) with the labels of the stages that their extension goes through; one label for extensions without a plan."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    table = F.create_map(*[x for k, v in stages.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return files.withColumn("stages", F.coalesce(F.try_element_at(table, kind), F.array(F.concat(F.lit("Translate "), F.when(kind == "", "file").otherwise(F.concat(F.lit("."), kind))))))


def page_type(answer: Column) -> Column:
    """[M6] Page type by the words of a classifier's answer; the first that occurs counts."""
    up = F.upper(answer)
    has = lambda *words: F.array_max(F.array(*[F.contains(up, F.lit(w)).cast("int") for w in words])) == 1
    return F.when(has("TOC"), "toc").when(has("TABLE"), "table_dense").when(has("STRUCTURED", "CLAUSE", "LEGAL"), "structured_clauses").otherwise("standard")


def rule_text(source: Column, target: Column, rules: dict[str, str], generic: str) -> Column:
    """[I25] The rules of a language pair ('Source-Target'), or the generic ones."""
    pair = F.concat(F.initcap(T.strip(source)), F.lit("-"), F.initcap(T.strip(target)))
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    return F.coalesce(F.try_element_at(table, pair), F.lit(generic))


def scanned(pages: DataFrame) -> DataFrame:
    """[A7] path, n_pages, scanned: whether any page of a file has no text, from pages(path, page_no, text)."""
    return pages.groupBy("path").agg(F.count("*").alias("n_pages"), F.bool_or(T.blank(F.col("text"))).alias("scanned"))


def review_cards(reports: DataFrame) -> DataFrame:
    """[B15] doc_id, card: HTML of reports(doc_id, title, status, messages), each message once and in order."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    items = F.array_join(F.transform(F.array_distinct("messages"), lambda m: F.concat(F.lit("<li>"), escape(m), F.lit("</li>"))), "")
    card = F.concat(F.lit("<article><h2>"), escape(F.col("title")), F.lit("</h2><p>Status: <strong>"), F.coalesce("status", F.lit("pending")), F.lit("</strong></p><details><summary>Review findings ("), F.size("messages"), F.lit(")</summary><ul>"), items, F.lit("</ul></details></article>"))
    return reports.select("doc_id", card.alias("card"))


def image_reports(images: DataFrame) -> DataFrame:
    """[M13] images(doc_id, text: the image's translation, answer: the reviewer's, limitations: what its adapter can't do) with coverage, semantic, findings and status.

    An empty translation or one that begins as an error fails at once, and nobody reviews it. An answer must be {"findings": [texts]}, each of them a text with content; any other
    leaves the review unavailable. Each limitation is a finding to look at. status follows from checks and findings as in E1.
    """
    empty = T.blank(F.col("text")) | F.lower(T.strip(F.col("text"))).rlike(r"^(?:error:|\*\[translation error)")
    said = F.try_variant_get(F.try_parse_json("answer"), "$.findings", "array<variant>")
    texts = F.transform(said, lambda v: F.try_variant_get(v, "$", "string"))
    sound = F.coalesce(F.forall(said, lambda v: (F.schema_of_variant(v) == "STRING") & ~T.blank(F.try_variant_get(v, "$", "string"))), F.lit(False))
    finding = lambda code, message, severity: F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity"))
    none = F.array().cast("array<struct<code:string,message:string,severity:string>>")
    failed = F.array(finding("image_translation_failed", F.lit("The image's translation is empty or an error."), "error"))
    reviewed = F.when(F.col("_sound"), F.transform("_texts", lambda t: finding("image_review", t, "review"))).otherwise(F.array(finding("image_review_unavailable", F.lit("The review's answer has another form."), "review")))
    limits = F.transform(F.coalesce("limitations", F.array().cast("array<string>")), lambda t: finding("capability_limit", t, "review"))
    marked = images.withColumns({"_empty": empty, "_sound": sound, "_texts": texts})
    rows = marked.withColumns({
        "coverage": F.when(F.col("_empty"), "failed"), "findings": F.when(F.col("_empty"), F.concat(failed, none)).otherwise(F.concat(reviewed, limits)),
        "semantic": F.when(~F.col("_empty"), F.when(~F.col("_sound"), "unavailable").when(F.size("_texts") == 0, "passed").otherwise("needs_review")),
    })
    open_ = F.coalesce(F.col("semantic") != "passed", F.lit(False)) | (F.size("findings") > 0)
    return rows.withColumn("status", F.when(F.col("_empty"), "failed").when(open_, "needs_review").otherwise("passed")).drop("_empty", "_sound", "_texts")
