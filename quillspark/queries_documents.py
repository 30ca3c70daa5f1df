"""Registered queries of files, packages, answers and rendering; those over segments, jobs and pages are in queries.py."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import arrow
from quillspark.functions import text as T
from quillspark.operators import pages as page_loops
from quillspark.operators import segments
from quillspark.operators import answers, checks, feedback, names, regions, rendering, review, tables
from quillspark.plans import relations as R
from quillspark.sources import folders, images, packages, parsers, publish, state, tail

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def pick(key: Column, *values) -> Column:
    """The value of a list by key modulo its length."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (key % len(values)).cast("int"))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def k() -> Column:
    return F.col("k")


def keys(spark, sf):
    return R.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"))


# Files and packages

#: Extensions of the files below, some of which no adapter knows.
EXTENSIONS = ("xlsx", "pdf", "png", "md", "exe", "pptx", "docx", "jpeg", "webp", "csv", "json", "htm", "tar.gz", "")


@query
def file_capabilities(spark, sf):
    """A1"""
    end = F.concat(pick(F.col("size"), *EXTENSIONS), F.when(k() % 5 == 0, F.left("a", F.lit(1))).otherwise(""))
    files = named_parts(spark, sf).select(F.concat(F.lit("dir.v1/"), "name", F.lit(" "), k(), F.lit("."), F.when(k() % 3 == 0, F.upper(end)).otherwise(end)).alias("path"))
    return packages.capability(files).select("path", "kind", "adapter", "output", "guarantee")


@query
def sniffed_kinds(spark, sf):
    """A2, A8"""
    head = pick(k(), "D0CF11E0A1B1", "504B0304", "255044462D312E", "89504E470D0A1A0A", "FFD8FFE0", "5249464600000000", "", "89504E47")
    content = F.unhex(F.concat(head, F.when(F.col("size") % 2 == 0, F.hex(F.lit("WEBP"))).otherwise(""), F.hex("name")))
    return named_parts(spark, sf).select("k", packages.sniffed(content).alias("kind"), F.md5(content).alias("content"))


@query
def image_headers(spark, sf):
    """Images in three formats whose sizes are the orders' own, some with another name or half a header; a JPEG frame has 16 bits for a size, so wider ones are JPEG-LS"""
    li = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), (F.col("o_custkey") + 1).alias("w"), (F.col("o_orderkey") % 4000 + 1).alias("h"))
    big = lambda c, width: F.lpad(F.hex(c), width, "0")
    little = lambda c, width: F.concat(*[F.substring(big(c, width), k, 2) for k in range(width - 1, 0, -2)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(F.col("w"), 8), big(F.col("h"), 8), F.lit("0802"))
    frame = F.concat(F.lit("FFC2001108"), big(F.col("h"), 4), big(F.col("w"), 4))
    oversize = F.concat(F.lit("FFF7000B080000000001011100FFF8000C0404"), big(F.col("h"), 8), big(F.col("w"), 8))
    jpeg = F.concat(F.lit("FFD8FFE000100000000000000000000000000000FFFFDB000400FF"), F.when(F.col("n") % 2 == 0, "FFC4000300").otherwise(""), F.when(F.col("w") > 65535, oversize).otherwise(frame))
    webp = F.concat(F.lit("524946460000000057454250565038580A00000000000000"), little(F.col("w") - 1, 6), little(F.col("h") - 1, 6))
    image = F.when(F.col("n") % 3 == 0, png).when(F.col("n") % 3 == 1, jpeg).otherwise(webp)
    content = F.unhex(F.when(F.col("n") % 13 == 0, F.left(image, F.lit(36))).otherwise(image))
    name = F.concat(F.lit("i"), "n", F.lit("."), F.when(F.col("n") % 11 == 0, "webp").when(F.col("n") % 17 == 0, "gif").otherwise(pick(F.col("n"), "png", "JPEG", "webp")))
    return images.inspected(li.select(name.alias("path"), content.alias("content")))


@query
def text_inspection(spark, sf):
    """A9"""
    n, raw = F.col("doc_id"), F.encode("text", "UTF-8")
    quoted = F.encode(F.concat(F.lit('{"t": "'), F.regexp_replace("text", r"[^\p{L} ]", ""), F.when(n % 2 == 0, '"}').otherwise("")), "UTF-8")
    content = F.when(n % 7 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(n % 7 == 1, quoted).when(n % 7 == 2, F.concat(raw, F.unhex(F.lit("FF")))).when(n % 7 == 3, F.concat(raw, F.unhex(F.lit("00")), raw)).otherwise(raw)
    rows = R.table(spark, sf, "documents").select("doc_id", content.alias("content"), F.when(n % 7 == 1, "json").otherwise("txt").alias("kind"))
    return parsers.inspected(rows).select("doc_id", "n_chars", "error")


def _parts(spark, sf):
    return packages.members(R.packages(spark, sf))


def _good(spark, sf):
    return _parts(spark, sf).filter("verdict = 'ok'")


@query
def package_verdicts(spark, sf):
    """A3"""
    return packages.verdicts(_parts(spark, sf))


@query
def package_features(spark, sf):
    """A4, A6"""
    return packages.features(_good(spark, sf))


@query
def broken_relationships(spark, sf):
    """A5, D19"""
    return packages.broken_relationships(_good(spark, sf)).select("path", "source", "rel_id", "kind", "target")


@query
def shared_cells(spark, sf):
    """A19, D19"""
    return packages.shared_cells(_good(spark, sf))


@query
def slide_order(spark, sf):
    """A20, D15, D19"""
    slides = packages.slides(_good(spark, sf))
    pages = slides.select("path", F.col("pos").alias("page_no"), F.concat(F.lit("page "), F.col("pos") + 1).alias("title"))
    return review.slide_of_page(pages, slides)


@query
def package_units(spark, sf):
    """A18, A21, C4, C5"""
    parts = _good(spark, sf)
    return packages.text_units(parts).unionByName(packages.sheet_titles(parts))


@query
def run_groups(spark, sf):
    """A17"""
    return packages.run_groups(_good(spark, sf))


@query
def replaced_units(spark, sf):
    """Units get new text over the same runs, packages are rebuilt and read again. Units, values and both packages stay in one row, so nothing is shuffled but the lines that packages are made from."""
    units = F.filter("units", lambda u: u["source"].rlike(packages.LETTER))
    values = F.transform(units, lambda u: F.struct(u["part"], u["location"], F.concat(F.lit("neu "), u["source"], F.lit(" & <mehr>")).alias("value")))
    files = packages.with_units(R.packages(spark, sf)).select("path", "content", values.alias("values")).filter(F.size("values") > 0)
    rows = packages.reread_units(packages.with_replaced_units(files))
    return rows.select("path", "part", F.coalesce("location", "change").alias("location"), F.coalesce("source", F.lit("")).alias("source"))


@query
def renamed_workbooks(spark, sf):
    """Sheets renamed, packages rebuilt, and their parts compared with what they were"""
    files, parts = R.packages(spark, sf), _good(spark, sf)
    titles = packages.sheet_titles(parts).filter(F.col("source").startswith("Data ")).select("path", F.col("source").alias("old"), F.concat(F.lit("It's "), F.col("source")).alias("new"))
    # All three are read again below; each pass over the packages makes and opens them anew.
    titles = folders.written(titles, "titles")
    changed = folders.written(packages.renamed(parts, titles), "changed")
    mine = files.join(titles.select("path"), "path", "left_semi")
    after = folders.written(packages.members(packages.rebuild(mine, changed)).select("path", "name", "raw"), "after")
    return packages.structure_changes(packages.canonical(parts.join(titles.select("path"), "path", "left_semi")), packages.canonical(after)).unionByName(packages.sheet_titles(after).select("path", F.col("location").alias("name"), F.col("source").alias("change")))


@query
def partial_parts(spark, sf):
    """C6"""
    parts = _good(spark, sf)
    wanted = parts.filter(F.col("name").rlike(r"slide1\.xml$|sheet1\.xml$")).select("path", "name")
    return review.partial_parts(parts, wanted).select("path", "name", "size")


@query
def formula_references(spark, sf):
    """I21"""
    texts = ("SUM('‹name›'!A‹size›,‹kind_of›!B2)", '"‹kind_of›!"&‹kind_of›!A1', "[Book.xlsx]‹kind_of›!A1", "‹a›:‹b›!A1", "'It''s ‹a›'!A1+Table1[‹b›!]+‹b›!B‹size›")
    formula = F.concat(pick(k(), *map(composed, texts)), F.lit("*"), k())
    table = F.create_map("name", F.concat(F.lit("New "), "brand"), F.lower("kind_of"), F.lit("X"), F.upper("b"), F.concat("b", F.lit("'s")))
    return named_parts(spark, sf).select("k", F.array_join(arrow.qualifiers(formula), ",").alias("sheets"), arrow.renamed_sheets(formula, table).alias("formula"))


# Streams, settings, guards


@query
def event_frames(spark, sf):
    """A31"""
    n, words = F.col("turn"), F.regexp_replace("text", r"[^\p{L} ]", "")
    body = F.concat(F.lit('data: {"type": "stage", "n": "'), words, F.lit('"}\r\n\r\n: note\n\n'))
    end = pick(n, 'data:{"type": "complete"}\n\ndata: {"type": "late"}\n\n', 'data: {"type":\ndata:   "error"}', 'data: {broken\n\ndata: {"type": "complete"}\n\n', 'data: {"type": "stage"}\n\n')
    rows = R.table(spark, sf, "conversations").select("conv_id", "turn", parsers.event_frames(F.concat(body, end)).alias("e"))
    return rows.select("conv_id", "turn", F.size("e.frames").cast("long").alias("n"), F.array_join("e.frames", "|").alias("frames"), F.col("e.error").alias("error"))


@query
def glossary_pairs(spark, sf):
    """A32, C13"""
    text = F.concat(composed("‹a› = ‹b› ‹size›\n\n‹brand›"), pick(k(), composed(" = ‹name› = ‹k›\n"), "\n", " =  \n", composed(" =  ‹kind_of› \r\n‹a› = ‹name›")))
    table = parsers.glossary(text)
    return named_parts(spark, sf).select("k", F.map_values(table).isNotNull().alias("valid"), F.try_element_at(table, F.col("a")).alias("a"), F.try_element_at(table, F.col("brand")).alias("own"))


@query
def text_guards(spark, sf):
    """A22, B6, B7, I13, I29"""
    n, text = F.col("doc_id"), F.substring("text", 1, 300)
    value = F.concat(pick(n, "=", " +", "", "- "), text)
    fenced = F.concat(F.lit('```json\n{"a": '), n, F.when(n % 3 == 0, "").otherwise("}"), F.lit("\n```"))
    return R.table(spark, sf, "documents").select(
        "doc_id", T.soft_breaks(F.regexp_replace(text, " ", F.when(n % 2 == 0, "_x000B_").otherwise("\x0b"))).alias("soft"), T.formula_guard(pick(n, "=x", "y"), value).alias("expression"), T.markdown_escaped(F.concat(text, F.lit(" *x*\r\n [y](z)"))).alias("escaped"),
        T.sanitized(F.regexp_replace(text, " ", F.when(n % 2 == 0, "\x01").otherwise("\t"))).alias("clean"), F.get_json_object(T.unfenced(fenced), "$.a").cast("long").alias("a"), F.try_parse_json(T.unfenced(fenced)).isNotNull().alias("parsed"),
    )


@query
def visual_components(spark, sf):
    """C11, M6"""
    li = R.table(spark, sf, "lineitem")
    box = F.array(F.col("l_tax") * 8 - 0.1, F.when(F.col("l_quantity") == 13, F.lit(float("nan"))).otherwise(F.col("l_discount") * 5), F.col("l_quantity") / 45, F.col("l_suppkey") % 50 / 48)
    box = F.when(F.col("l_partkey") % 17 == 0, F.slice(box, 1, 3)).otherwise(box)
    kind = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "table").otherwise("banner")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", names.valid_component(kind, box).alias("valid"))


@query
def sanitised_settings(spark, sf):
    """C12"""
    table = F.create_map(F.lit("Token"), F.col("name"), F.lit("a.b.api_key"), F.lit("x"), F.lit("a.image_bytes"), F.col("name"), F.lit("raw"), F.lit("é"), F.lit("plain"), k().cast("string"))
    out = review.sanitised(table, strings("a.image_bytes", "raw"))
    return keys(spark, sf).select("k", F.array_join(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("settings"))


EXCLUDED, WANTED, FREE = ("nano", "exp", "embed"), ("pro", "flash"), ("google-translate", "Google Translate (Free)")


@query
def model_options(spark, sf):
    """A29, A30, C10, G6, R11"""
    items = keys(spark, sf).select(k().alias("pos"), pick(k(), " nova-1-pro ", "nova-2-flash", "nova-nano-pro", "other", "google translate (free)", "").alias("id"), pick(k(), "Nova 1 Pro", "  ", "Nano", "Other flash", "G", "x").alias("name"))
    rows = review.model_options(items, EXCLUDED, WANTED, FREE)
    return rows.select("id", "name", review.model_score(F.col("id"), WANTED).cast("double").alias("score"))


@query
def retry_waits(spark, sf):
    """I26, J9"""
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    seconds = k() * 7 % 5000 - 100
    header = F.when(k() % 4 == 1, F.concat(F.date_format(now + F.make_dt_interval(secs=seconds), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k() % 4 == 2, "x").when(k() % 4 == 3, (F.col("size") / 4).cast("string"))
    details = F.when(k() % 3 == 0, F.concat(F.lit('[{"other": 1}, {"retryDelay": "'), F.col("size") / 2, F.lit('s"}]')))
    message = F.concat(F.lit("429: "), "name", F.when(k() % 5 == 0, "").otherwise(F.concat(F.lit(" retry in "), "size", F.lit(" s"))))
    return named_parts(spark, sf).select("k", T.retry_delay(message, header, F.col("size") % 7, now, details).alias("wait"), F.array_join(review.retry_schedule(), ",").alias("transient"))


# Geometry, styles, pages


def page_boxes(spark, sf):
    """A box for each order; some are cells."""
    o = R.table(spark, sf, "orders")
    x0, y0 = (F.col("o_custkey") % 97 * 10).cast("double"), (F.col("o_orderkey") * 7 % 83 * 10).cast("double")
    kind = F.when(F.left("o_orderpriority", F.lit(1)).isin("1", "2"), "cell").otherwise("block")
    return o.select((F.col("o_orderkey") % 400).alias("page"), kind.alias("kind"), F.col("o_orderkey").alias("box_no"), x0.alias("x0"), y0.alias("y0"), (x0 + 15 + F.col("o_orderkey") % 11 * 5).alias("x1"), (y0 + 10 + F.col("o_custkey") % 13 * 5).alias("y1"))


@query
def points_in_boxes(spark, sf):
    """A23, D17"""
    li = R.table(spark, sf, "lineitem")
    point = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")
    points = li.select((F.col("l_orderkey") % 400).alias("page"), point.alias("point"), (F.col("l_partkey") % 991).cast("double").alias("x"), (F.col("l_partkey") * 3 + F.col("l_linenumber") * 57).alias("y")).select("page", "point", "x", (F.col("y") % 877).cast("double").alias("y"))
    return regions.placed(points, page_boxes(spark, sf)).groupBy("page", "kind", "box_no").agg(F.count("*").alias("n_points"), F.sum("y").alias("sum_y"))


@query
def page_regions(spark, sf):
    """A23"""
    out = regions.merged(page_boxes(spark, sf).filter("kind = 'block'").drop("kind"), keep=lambda df, label: folders.written(df, label))
    return out.select("page", "box_no", "region", "rx0", "ry0", "rx1", "ry1")


@query
def log_tails(spark, sf):
    """The last lines of the log of each of eight parts"""
    spark.dataSource.register(tail.TailSource)
    root = folders.fresh_folder(spark, "logs")
    events = R.table(spark, sf, "events").select((F.col("user_id") % 8).alias("bucket"), "event_id", F.concat_ws(" ", "event_id", "event_type", "user_id").alias("line"))
    events.repartition("bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "line").write.partitionBy("bucket").text(f"{root}/log")
    rows = spark.read.format("quill_tail").option("paths", f"{root}/log").option("lines", 40).option("block", 512).load()
    return rows.select(F.regexp_extract("path", r"bucket=(\d+)", 1).cast("long").alias("bucket"), "from_end", "line")


@query
def rule_guidance(spark, sf):
    """M16"""
    e = R.table(spark, sf, "events").withColumn("kind", F.concat(F.lit("kind "), F.col("user_id") % 60))
    versions = e.filter("event_type in ('error', 'purchase') and user_id % 60 <> 7 and user_id % 3 = 0 and event_id % 10 = 0").select("kind", "ts", F.concat(F.lit("rule "), F.col("event_id") % 9).alias("rule"), (F.col("event_type") == "error").alias("active"))
    documents = e.filter("event_type not in ('error', 'purchase') and user_id % 60 % 3 < 2").select(F.col("event_id").alias("doc_id"), "kind", "ts")
    return feedback.guidance(documents, versions, 2).select("doc_id", "kind", "state", "rule")


@query
def style_scales(spark, sf):
    """E12, E13"""
    fits = R.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("style"), (F.col("l_orderkey") % 10).alias("page"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("region"), (0.7 + F.col("l_discount") * 4 - F.col("l_tax")).alias("fit"))
    return names.style_scales(fits).groupBy("page").agg(F.count("*").alias("n"), F.round(F.min("scale"), 6).alias("least"), F.round(F.max("scale"), 6).alias("most"))


@query
def dominant_styles(spark, sf):
    """E12, A24"""
    rows = R.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("region"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("style"))
    return names.dominant(rows, "region", "style")


@query
def missing_letters(spark, sf):
    """Turns without one of their letters, and with another one twice"""
    whole = F.substring("text", 1, 200)
    found = F.concat(F.replace(whole, pick(F.col("turn"), "e", "n", "é", "A", "zz"), F.lit("")), F.lit("q7"))
    rows = R.table(spark, sf, "conversations").select("conv_id", "turn", names.missing_letters(F.concat(whole, F.lit("qq-7")), found).alias("m"))
    return rows.select("conv_id", "turn", F.array_join("m", "").alias("missing"))


@query
def page_findings(spark, sf):
    """D14, R5, M10"""
    p = R.pages(spark, sf).select("doc_id", "page_no", (F.length("body") % 5 == 0).alias("blank"))
    after = p.filter("page_no % 5 <> 3").withColumn("blank", F.col("page_no") % 4 == 1).unionByName(p.filter("page_no = 0").withColumn("page_no", F.lit(99).cast("long")))
    return names.page_findings(p, after)


@query
def typeset_checks(spark, sf):
    """R2, R3, R6"""
    li = R.table(spark, sf, "lineitem")
    words = F.when(F.col("l_partkey") % 4 == 0, " \n").otherwise(F.col("l_returnflag"))
    found = review.page_status(words, (220 + F.col("l_quantity")).cast("int"), F.col("l_discount") * 5 + 0.2, F.col("l_linestatus") == "F")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array_join(found, ",").alias("findings"), review.autofit((F.col("l_partkey") * 50 + F.col("l_suppkey")).cast("int")).alias("next_scale"))


@query
def asked_batches(spark, sf):
    """M2, M3: answers go wrong by the batch's document, attempt, size and what is in it"""
    rows = segments.batches(R.segments(spark, sf), "doc_id", "line_no")
    batches = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list("line_no")).alias("ids"))  # 24 ids at most

    def answer(ids, attempt):
        texts = F.transform(ids, lambda i: F.concat(F.lit("line "), i))
        late = (attempt == 1) & (F.col("doc_id") % 3 == 0)
        poison = F.exists(ids, lambda i: i % 17 == 0) & (F.size(ids) > 6)
        unknown = F.exists(ids, lambda i: i % 41 == 5)
        return F.struct(F.when(late | poison, F.slice(ids, F.lit(2), F.size(ids))).when(unknown, F.transform(ids, lambda i: F.when(i % 41 == 5, -i).otherwise(i))).otherwise(ids).alias("ids"), F.when(late | poison, F.slice(texts, F.lit(2), F.size(texts))).otherwise(texts).alias("texts"))

    out = answers.asked(batches, answer)
    return out.select("doc_id", "batch", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").alias("n_ids"), "error", "depth", "attempt", F.size("answer.texts").alias("n_texts"))


@query
def image_reports(spark, sf):
    """Documents as translations of images, and answers made from their first lines"""
    n = F.col("doc_id")
    first = F.regexp_replace(F.substring("text", 1, 60), r"[^\p{L} ]", "")
    text = F.when(n % 11 == 0, " \n").when(n % 13 == 0, F.concat(F.lit(" Error: "), first)).otherwise(F.col("text"))
    answer = pick(n, F.lit('{"findings": []}'), F.concat(F.lit('{"findings": ["'), first, F.lit('", "x"]}')), F.concat(F.lit('{"findings": ["'), first, F.lit('", 5]}')), F.concat(F.lit('{"findings": ["'), first), F.lit('{"findings": ["ok", " "]}'), F.lit('{"findings": "x"}'), F.lit("[]"))
    images_ = R.table(spark, sf, "documents").select("doc_id", text.alias("text"), answer.alias("answer"), F.when(n % 4 == 0, strings("Markdown, not a picture.")).otherwise(strings()).alias("limitations"))
    rows = review.image_reports(images_)
    return rows.select("doc_id", "coverage", "semantic", "status", F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit(":"), f["message"], F.lit(":"), f["severity"])), "|").alias("findings"))


def redrafted(body: Column, attempt: Column) -> Column:
    """Stands for a translator: each attempt heeds one more rule."""
    second = F.replace(F.replace(body, F.lit("[text continues]"), F.lit("")), F.lit("Article 5"), F.lit("Article five"))
    return F.when(attempt == 1, body).when(attempt == 2, second).otherwise(F.replace(second, F.lit("TODO check"), F.lit("checked")))


def relaid(draft: Column, attempt: Column) -> Column:
    """Stands for a layout specialist."""
    second = F.replace(F.replace(draft, F.lit("\\frac{1}{2}"), F.lit("1/2")), F.lit("Chapter 1 one Chapter 2 two"), F.lit("Chapter 1 one\nChapter 2 two"))
    return F.when(attempt == 1, draft).when(attempt == 2, second).otherwise(F.replace(second, F.lit("second key: two value"), F.lit("and a second key")))


@query
def page_loop(spark, sf):
    """M15"""
    n = F.col("page_no")
    pages = R.pages(spark, sf).select("doc_id", "page_no", "body", (n % 3 == 0).alias("toc"), (n % 4 == 1).alias("nested"), (n % 2 == 0).alias("tiers"), F.lit(True).alias("columns"))
    done = page_loops.page_loop(pages, redrafted, relaid)
    return done.select("doc_id", "page_no", "translations", "formats", F.array_join("defects", ",").alias("defects"), "status", F.md5("draft").alias("draft"))


@query
def published_orders(spark, sf):
    """A publication by the lease's owner stands; one by another is refused, and what it staged is gone"""
    spark.dataSource.register(publish.PublishSource)
    place = folders.fresh_folder(spark, "published")
    orders = R.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice"))
    publish.put_json(f"{place}/lease.json", {"owner": "a", "until": time.time() + 3600})
    into = lambda df, owner: df.write.format("quill_publish").mode("overwrite").option("path", place).option("lease", f"{place}/lease.json").option("owner", owner).save()
    into(orders, "a")
    try:
        into(orders.limit(1), "b")
    except Exception as e:  # Spark wraps what the writer raises
        if "LeaseLost" not in str(e):
            raise
    return spark.read.format("quill_publish").option("path", place).load()


@query
def fallback_state(spark, sf):
    """Three places of state, of which two are damaged in parts"""
    spark.dataSource.register(state.StateSource)
    root = folders.fresh_folder(spark, "state")
    rows = R.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), (F.col("c_custkey") % 16).cast("int").alias("shard"))
    each = rows.withColumn("place", F.explode(strings("remote", "mirror", "local")))
    own = each.groupBy("place", "shard").agg(F.array_sort(F.collect_list(F.struct("key", F.concat("place", F.lit(" "), "name").alias("value")))).alias("entries"))  # a shard is a file
    remote, mirror, n = F.col("place") == "remote", F.col("place") == "mirror", F.col("shard")
    text = F.to_json(F.struct(F.when(mirror & (n % 8 == 1), 2).otherwise(1).alias("version"), "entries"))
    broken = (remote & (n % 4 == 1)) | (mirror & (n == 12))
    files = own.filter(~(remote & (n % 4 == 0)) & ~((F.col("place") == "local") & (n == 12))).select("place", "shard", F.when(broken, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text).alias("text"))
    files.foreach(lambda r: folders.put_text(f"{root}/{r.place}/shard-{r.shard}.json", r.text))
    places = ";".join(f"{p}={root}/{p}" for p in ("remote", "mirror", "local"))
    return spark.read.format("quill_state").option("places", places).option("shards", 16).load()


@query
def header_runs(spark, sf):
    """F9"""
    cells = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("col_no"), F.col("l_returnflag").alias("label"))
    return review.header_runs(cells)


@query
def header_paths(spark, sf):
    """I16"""
    cells = folders.written(tables.html_cells(R.order_tables(spark, sf), "order_no", "html"), "cells")  # read several times below
    return tables.header_paths(cells, ["order_no", "table_no"]).select("order_no", "col", F.array_join("path", "|").alias("path"), "label")


@query
def flat_tables(spark, sf):
    """I16"""
    cells = folders.written(tables.html_cells(R.order_tables(spark, sf), "order_no", "html"), "cells")  # read several times below
    return tables.body_rows(cells, ["order_no", "table_no"]).select("order_no", "row_no", "part", F.array_join("texts", "|").alias("texts"), "dense")


@query
def distributed_text(spark, sf):
    """F10, M9"""
    rows = R.table(spark, sf, "conversations").select("conv_id", "turn", arrow.distributed(F.coalesce("text", F.lit("")), F.array(*map(F.lit, (3, 5, 2)))).alias("p"))
    return rows.select("conv_id", "turn", F.array_join("p", "|").alias("parts"))


@query
def contents_pages(spark, sf):
    """I10"""
    p = R.pages(spark, sf).withColumn("body", rendering.toc_lines(F.col("body")))
    return p.select("doc_id", "page_no", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))


def named_parts(spark, sf):
    """k, name, brand, kind, size, and the two words of the name."""
    words = F.split("p_name", " ")
    return R.table(spark, sf, "part").select(
        F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind_of"), F.col("p_size").cast("long").alias("size"), F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b"),
    )


def composed(template: str) -> Column:
    """A text of columns between angle quotes: '‹name›'."""
    pieces = re.split("[‹›]", template)
    return F.concat(*[F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(pieces)])


#: A renderer (a function of texts or of a column) and a page, with the part's columns in it, for each kind.
PAGES_TO_RENDER = {
    "blocks": (
        rendering.blocks_html, "# ‹name›\nChapter ‹k› on ‹a›\nplain ‹b› text\nthat goes on\n\n‹size›.1 clause ‹a›\nmore of it\n1. item ‹name›\n• bullet ‹a›\n  • deeper ‹b›\n(1) condition ‹a›\n- after ‹b›\n```\n|‹a›|‹b›|\n|--|--|\n|‹k›|x|\n"
        "└── ‹name›\n<svg>\n| ‹a›\n</svg>\n‹a›: ‹b›\n‹k› counted\n  indented ‹b›",
    ),
    "cover": (rendering.cover_html, "# ‹name›\n‹brand›\n[Stamp: ‹kind_of›, ‹a›]\n2024-‹size›"),
    "fractions": (rendering.fractions, "‹name› = \\frac{‹size›}{\\text{‹b›}+{‹k›}} and $$‹a› \\times ‹k›$$"),
    "lists": (rendering.numbered_lists, '<ol start="‹size›"><li>‹a›</li><li> ‹b› </li></ol>'),
    "normalised": (lambda t: "#".join(map(str, rendering.normalised(t))), "* 1. ‹name›\n  * 2. ‹a›\n```json\n[Seal: Stamp: ‹a›; ‹b›]\nPage ‹k›"),
    "table": (lambda t: rendering.table_html(t.split("\n")), "|n|‹a›<‹size›|\n|--|--|\n|‹k›|\n|‹a›|\n|‹b›|‹brand›|"),
    "toc": (rendering.toc_html, "Contents of ‹brand›\nChapter ‹k› ··· ‹size›\n  Part ‹a›\n9\n### ‹name› · ‹size›\n‹b›\n[Page: ‹size›]"),
    "unsquashed": (rendering.unsquashed, "‹name› ‹k›.1 first ‹size›.‹size› ‹b›\n| ‹a› | 1.1 b |\n‹brand›"),
}


@query
def rendered_pages(spark, sf):
    """I11, I12, I13, I15, I17, I18, I19"""
    out = None
    for kind, (render, template) in sorted(PAGES_TO_RENDER.items()):
        pages = named_parts(spark, sf).select("k", F.lit(kind).alias("kind"), composed(template).alias("body"))
        one = pages.withColumn("body", render(F.col("body"))) if kind == "unsquashed" else rendering.rendered(pages, render)
        out = one if out is None else out.unionByName(one)
    return out.select("k", "kind", "body")


#: A document of each kind, and the places and values that are written into it.
DOCUMENTS_TO_WRITE = {
    "json": ('{"‹a›/b": " ‹name› ", "n": [‹k›, "x"]}', {"/‹a›~1b": "new ‹brand›", "/n/1": "‹b›"}),
    "csv": ('"id","text"\r\n"‹k›"," ‹a› "\r\n', {"row:2/column:2": "‹name›"}),
    "html": ('<p title="‹a› &amp; on">‹b› <b>‹k›</b></p>', {"text:0": "‹name› & more", "element:0/@title": 'say "‹brand›"'}),
    "md": ("# ‹a›\ntext *‹b›* end", {"offset:2:‹end_a›": "‹brand›_1", "offset:‹begin_b›:‹end_b›": "‹a›\n*‹name›*"}),
    "bad": ('"id","text"\r\n"‹k›"," ‹name› "\r\n', {"row:2/column:2": "=‹size›+1"}),
}


@query
def written_documents(spark, sf):
    """B2, B3, B5, B6, B7, D12"""
    parts = named_parts(spark, sf).withColumn("end_a", F.length("a") + 2)
    parts = parts.withColumns({"begin_b": F.col("end_a") + 7, "end_b": F.col("end_a") + 7 + F.length("b")})
    out = None
    for kind, (text, values) in DOCUMENTS_TO_WRITE.items():
        docs = parts.select(k().alias("doc_id"), composed(text).alias("text"))
        given = parts.select(k().alias("doc_id"), F.explode(F.array(*[F.struct(composed(at).alias("location"), composed(v).alias("value")) for at, v in values.items()])).alias("v")).select("doc_id", "v.*")
        one = rendering.written(docs, given, "csv" if kind == "bad" else kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.select("doc_id", "kind", "rendered", "error")


# Answers, drafts, plans


@query
def located_findings(spark, sf):
    """D6"""
    s = R.segments(spark, sf)
    found = s.filter("line_no % 3 = 0").select("doc_id", "segment_id", F.concat(F.lit("line "), "line_no").alias("message"))
    return review.located(found, s)


@query
def answer_checks(spark, sf):
    """Answers about the parts of an order, wrong by what its lines are"""
    li = R.table(spark, sf, "lineitem")
    part, supplier, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    copies = F.when(supplier % 9 == 0, 0).when(supplier % 13 == 0, 2).otherwise(1)
    row = F.struct(
        part.alias("part"), supplier.alias("supplier"), n.alias("n"), part.cast("string").alias("id"), F.array_repeat(F.when(part % 31 == 0, F.concat(F.lit("x"), part)).otherwise(part.cast("string")), copies).alias("ids"),
        F.array_repeat(F.when(n == 7, " ").otherwise("text"), copies).alias("texts"), F.when(n == 11, "same").when(F.col("l_returnflag") == "A", "equivalent").when(F.col("l_returnflag") == "N", "different").otherwise("uncertain").alias("verdict"),
        F.when(n == 5, "").otherwise("seen").alias("evidence"), (F.col("l_tax") == 0.08).alias("short"),
    )
    orders = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("own"))  # the lines of one order
    of = lambda f, where=lambda x: F.lit(True): F.transform(F.filter("own", where), f)
    want, ids, texts = F.array_distinct(of(lambda x: x["id"])), F.flatten(of(lambda x: x["ids"])), F.flatten(of(lambda x: x["texts"]))
    texts = F.when((F.col("l_orderkey") % 5 == 0) & F.exists("own", lambda x: x["short"]), F.slice(texts, F.lit(1), F.greatest(F.size(texts) - 1, F.lit(0)))).otherwise(texts)
    reviewed = F.array_distinct(of(lambda x: x["id"], lambda x: x["n"] != 9))
    noted = lambda x: x["supplier"] % 7 == 0
    findings = of(lambda x: F.when(x["n"] == 3, F.concat(F.lit("y"), x["id"])).otherwise(x["id"]), noted)
    return orders.select(
        F.col("l_orderkey").alias("order_no"), review.answer_error(want, ids, texts).alias("answer"), review.review_error(want, reviewed, findings, of(lambda x: F.when(x["n"] == 4, " ").otherwise("m"), noted)).alias("review"),
        review.verdict_error(want, of(lambda x: x["id"]), of(lambda x: x["verdict"]), of(lambda x: x["evidence"])).alias("verdict"), F.array_join(F.transform(review.halves(want), lambda p: F.array_join(p, "+")), ",").alias("halves"),
    )


@query
def cached_drafts(spark, sf):
    """D10, J5, L6"""
    mark = lambda s: s.withColumn("fingerprint", F.concat(F.lit("f"), F.col("doc_id") % 2))
    s = mark(R.segments(spark, sf)).withColumn("roles", F.when(F.col("line_no") % 6 == 0, strings("source_review", "table_review")).otherwise(strings("source_review")))
    a = s.filter("line_no % 3 = 0").select("doc_id", F.lit("f0").alias("fingerprint"), "segment_id", F.upper("source").alias("text"), strings("source_review").alias("roles"))
    d = s.filter("line_no % 2 = 0").select("doc_id", "fingerprint", "segment_id", F.when(F.col("line_no") % 4 == 0, " ").otherwise(F.concat(F.lit("draft "), "line_no")).alias("text"))
    return review.cached(s, a, d).select("doc_id", "line_no", "origin", "value")


@query
def semantic_checks(spark, sf):
    """E6"""
    s = R.segments(spark, sf).select("doc_id", F.when(F.col("line_no") % 40 == 6, "unavailable").when(F.col("line_no") % 15 == 4, "needs_review").otherwise("passed").alias("status"))
    return review.semantic_check(s)


@query
def document_fingerprints(spark, sf):
    """E17"""
    docs = R.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), F.lit("txt").alias("kind"), F.col("lang").alias("target"), F.lit("m").alias("model"), F.lit("").alias("rules"), F.lit(None).cast("string").alias("glossary"))
    return review.fingerprints(docs, R.segments(spark, sf))


@query
def submission_fingerprints(spark, sf):
    """E18"""
    files = R.jobs(spark, sf).select("batch_id", F.col("row_no").alias("pos"), F.col("filename").alias("name"), F.md5("filename").alias("digest"), F.lit("o").alias("options"))
    return review.submission(files)


@query
def planned_tools(spark, sf):
    """M1, H3, E3"""
    chosen = pick(k(), strings("source_review", "table_review"), strings("vision_translation"), strings("nonsense"), strings())
    plan = review.planned_tools(pick(k(), "pdf", "txt", "docx", "png", "md"), k() % 7 == 0, k() % 2 == 0, k() % 3 == 0, strings("visual_review", "source_review"), chosen, pick(k(), 0.9, 0.5, 1.5))
    return keys(spark, sf).select("k", F.array_join(plan["tools"], ",").alias("tools"), F.array_join(plan["findings"], ",").alias("findings"))


@query
def feedback_states(spark, sf):
    """A28"""
    row = lambda e, f: '{"id": "' + "a" * 64 + '", "time": 1.5, "eligible": [' + e + '], "failures": [' + f + "]}"
    state = lambda rows, version=1: '{"version": ' + str(version) + ', "salt": "' + "b" * 64 + '", "observations": [' + rows + "]}"
    text = pick(k(), state(row('"numbers", "visual"', '"visual"')), state(row('"numbers"', '"visual"')), state(row('"nope"', "")), state("", 2), "not json", state(row('"numbers"', "").replace("a" * 64, "short")))
    return keys(spark, sf).select("k", review.state_error(text, list(feedback.CODE_CHECKS)).alias("error"))


@query
def appended_states(spark, sf):
    """B9"""
    e = R.table(spark, sf, "events").filter("event_id % 50 = 0").select(F.col("event_type").alias("kind"), F.col("event_id").alias("write_id"), (F.col("event_id") / 50 % 7).cast("long").alias("seen"))
    states = e.select("kind").distinct().withColumn("generation", F.length("kind").cast("long"))
    return review.appended(states, e)


@query
def text_sections(spark, sf):
    """D11"""
    c = R.table(spark, sf, "customer")
    sections = c.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("section")).agg(F.collect_set("c_mktsegment").alias("texts"))
    return review.sections_of(c.select(F.col("c_mktsegment").alias("text")), sections).select("text", F.array_join("sections", ",").alias("sections"))


@query
def sampled_texts(spark, sf):
    """E16, G4, G5"""
    rows = R.segments(spark, sf).select("doc_id", "line_no", F.left("source", F.lit(20)).alias("text"))
    first = review.first_texts(rows, "doc_id", "line_no", 5)
    return first.select("doc_id", F.array_join("texts", "|").alias("texts"), F.array_join(review.longest_first(F.col("texts")), "|").alias("longest"))


@query
def report_snapshots(spark, sf):
    """C2, B14"""
    report = F.create_map(F.lit("status"), pick(k(), "passed", "failed"), F.lit("checks"), F.col("name"), F.lit("plan"), F.lit("p"), F.lit("model_calls"), k().cast("string"))
    shown = review.snapshot(report, k() % 3 == 0, ("status", "checks", "findings", "model_calls", "repairs"))
    return keys(spark, sf).select("k", F.array_join(F.array_sort(F.map_keys(shown)), ",").alias("keys"), F.get_json_object(F.to_json(shown), "$.checks").alias("checks"))


@query
def allowed_patches(spark, sf):
    """R16"""
    rows = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("segment_no"), F.col("c_mktsegment").alias("source"))
    labels = spark.createDataFrame([("BUILDING", "Bau"), ("MACHINERY", "Maschinen"), ("NONE", "x")], "source string, label string")
    return review.patched(rows, labels)


@query
def colours_and_tags(spark, sf):
    """I30"""
    return keys(spark, sf).select("k", review.channels((k() * 7919 + (1 << 24)).cast("long")).alias("colour"), review.untagged(F.concat(F.lit("<b class='x'>"), "name", F.lit("</b> 1 < 2"))).alias("bare"))


@query
def lease_events(spark, sf):
    """Claims, heartbeats and ends as a stream"""
    from quillspark.streaming import folds

    source = R.table(spark, sf, "events").schema
    events = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf)
    n = F.col("event_id")
    rows = events.select((F.col("user_id") % 10).alias("job_id"), "event_id", "ts", F.concat(F.lit("w"), n % 3).alias("owner"), pick(n, "claim", "heartbeat", "claim", "finish").alias("action"))
    return folds.run_to_end(folds.leases_stream(rows, 3600), "lease_events")


@query
def finding_counts(spark, sf):
    """Exit code of a run over all documents"""
    rows = checks.reports(R.table(spark, sf, "documents"), R.pairs(spark, sf), R.table(spark, sf, "labels").filter("toxic = 1").select("doc_id"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "needs_review").alias("open"), F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("exit_code"))


STAGES = {"pdf": ("inspect", "extract", "translate", "audit", "typeset"), "csv": ("parse", "translate", "serialise"), "png": ("ingest", "translate", "render")}


@query
def planned_stages(spark, sf):
    """C15"""
    files = keys(spark, sf).select(F.concat(F.lit("f"), k(), pick(k(), ".PDF", ".csv", ".htm", "")).alias("path"))
    return review.planned_stages(files, STAGES).select("path", F.array_join("stages", ">").alias("stages"))


@query
def page_types(spark, sf):
    """M6"""
    return keys(spark, sf).select("k", review.page_type(pick(k(), "a toc page", "dense Table", "LEGAL text", "plain", "clause and table")).alias("page_type"))


@query
def rule_texts(spark, sf):
    """I25"""
    return keys(spark, sf).select("k", review.rule_text(pick(k(), " japanese ", "GERMAN", ""), pick(k(), "English", "french"), {"Japanese-English": "je", "German-French": "gf"}, "any").alias("rules"))


@query
def scanned_files(spark, sf):
    """A7"""
    p = R.pages(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("path"), "page_no", F.when((F.col("doc_id") + F.col("page_no")) % 9 == 0, " \n").otherwise(F.col("body")).alias("text"))
    return review.scanned(p)


@query
def review_index(spark, sf):
    """B15"""
    rows = keys(spark, sf).select(k().alias("doc_id"), F.concat(F.lit("<"), "name", F.lit(">")).alias("title"), pick(k(), "passed", None).alias("status"), pick(k(), strings("a: b & c", "d: 'e'", "a: b & c"), strings(), strings("x")).alias("messages"))
    return review.review_cards(rows)
