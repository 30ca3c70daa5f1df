"""Relations of the checked queries, derived from the driver's tables; each has the same text in SQL."""

from __future__ import annotations

import struct
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.feedback import CODE_CHECKS
from quillspark.operators.segments import line_segments

NOW = "timestamp_ntz '2024-01-30 00:00:00'"
JOBS_NOW = "timestamp_ntz '1996-06-17 00:00:00'"
STATES = ("queued", "queued", "waiting_credentials", "passed", "needs_review", "failed", "cancelled")
SNIPPETS = (
    "[text continues]", "TODO check", "| a | b | c |\n| --- | --- | --- |\n| d | e |\n| 1. | f |\nafter the table", "Chapter 1 one Chapter 2 two", "1. item\n(1) condition\n  - sub",
    "\\frac{1}{2}", "first key: one value second key: two value", "Article 5", "| a |\n| a | b | c | d | e | f |", "## Heading\nKapitel 4 · · 12\n17",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    return line_segments(table(spark, sf, "documents"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with a candidate: by a hash digit dropped, changed, replaced or kept."""
    digit = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))), 1, 1)
    source = F.col("source")
    candidate = F.when(digit == "1", None).when(digit == "2", F.concat(source, F.lit(" 7"))).when(digit == "3", F.lit("[omitted]")).when(digit == "4", F.regexp_replace(source, "[0-9]", "9")).otherwise(source)
    return segments(spark, sf).withColumn("candidate", candidate).withColumn("source", F.when(digit == "5", F.concat(source, F.lit(" https://example.org/a"))).otherwise(source))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return observed(table(spark, sf, "events"))


def observed(events: DataFrame) -> DataFrame:
    """Observations of events, a table or a stream."""
    codes = F.array(*[F.lit(c) for c in CODE_CHECKS])
    n = F.col("event_id")
    eligible = F.slice(codes, F.lit(1), (n % 6 + 1).cast("int"))
    failed = F.get(codes, (F.floor(n / 7) % 6).cast("int"))
    failures = F.when((n % 4 == 0) & F.array_contains(eligible, failed), F.array(failed)).otherwise(F.array().cast("array<string>"))
    return events.select(F.col("event_type").alias("kind"), F.col("event_id").alias("obs_id"), F.col("user_id").alias("doc"), "ts", eligible.alias("eligible"), failures.alias("failures"))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("batch_id"), "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    i = F.col("id")
    state = F.when(i % 499 == 0, "running").otherwise(F.element_at(F.array(*[F.lit(s) for s in STATES]), (i % 7 + 1).cast("int")))
    rows = rows.withColumn("state", state)
    return rows.select(
        "id", "batch_id", F.concat(F.lit("f"), "l_partkey", F.lit(".txt")).alias("filename"), F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("provider"), "state",
        (i % 100).cast("int").alias("progress"), F.when(F.col("state") == "running", F.concat(F.lit("w"), i % 5)).alias("owner"), F.col("l_shipdate").alias("lease_until"), (i % 13 == 0).alias("cancel_requested"), i.alias("row_no"),
        F.when(F.col("state").isin("passed", "needs_review"), F.concat(F.lit("a"), i)).alias("artifact"), (i % 50).alias("model_calls"), (i % 7).alias("previous_model_calls"), (F.col("l_quantity") * 100000).cast("long").alias("size"),
    )


def batches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.md5(F.col("o_custkey").cast("string")).alias("token_hash"), F.md5("o_orderpriority").alias("fingerprint"), F.col("o_orderdate").alias("created"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("expires"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as pages, each with a snippet chosen by its number."""
    own = F.get(F.array(*[F.lit(s) for s in SNIPPETS]), ((F.col("conv_id") * 7 + F.col("turn")) % 13).cast("int"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.when(own.isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), own)).alias("body"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("identity"), F.col("event_id").alias("request_id"), "ts")


def order_tables(spark: SparkSession, sf: str) -> DataFrame:
    """order_no, html: a table for each order, with a header of three tiers. Lines are columns, under their flag and status; a flag or status of one line
    spans the tiers below it. The body has a row for each line, with a value over as many columns as the line's place."""
    by = lambda *c: Window.partitionBy("l_orderkey", *c)
    place = F.row_number().over(by().orderBy("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = table(spark, sf, "lineitem").select("*", place.alias("i"), F.count("*").over(by("l_returnflag")).alias("nf"), F.count("*").over(by("l_returnflag", "l_linestatus")).alias("ns"))
    first = lambda *c: F.col("i") == F.min("i").over(by(*c))
    lines = lines.withColumn("first_flag", first("l_returnflag")).withColumn("first_status", first("l_returnflag", "l_linestatus"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    t0 = F.when(F.col("first_flag"), text('<th colspan="', F.col("nf"), F.when(F.col("nf") == 1, '" rowspan="3').otherwise(""), '">flag <b>', F.col("l_returnflag"), "</b></th>")).otherwise("")
    t1 = F.when((F.col("nf") > 1) & F.col("first_status"), text('<th colspan="', F.col("ns"), F.when(F.col("ns") == 1, '" rowspan="2').otherwise(""), '">status ', F.col("l_linestatus"), "</th>")).otherwise("")
    t2 = F.when((F.col("nf") > 1) & (F.col("ns") > 1), text("<th>line ", F.col("l_linenumber"), "</th>")).otherwise("")
    label = F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(text("L", F.col("l_linenumber")))
    value = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(text("shipped from supplier ", F.col("l_suppkey")))
    row = text("<tr><td>", label, '</td><td colspan="', F.col("i"), '">', value, "</td></tr>")
    own = lines.groupBy(F.col("l_orderkey").alias("order_no")).agg(F.array_sort(F.collect_list(F.struct("i", t0.alias("t0"), t1.alias("t1"), t2.alias("t2"), row.alias("row")))).alias("own"))  # the lines of one order
    joined = lambda name: F.array_join(F.transform("own", lambda x: x[name]), "")
    head = text('<table><thead><tr><th rowspan="3">order ', F.col("order_no"), "</th>", joined("t0"), "</tr><tr>", joined("t1"), "</tr><tr>", joined("t2"), "</tr></thead><tbody>")
    return own.select("order_no", text(head, joined("row"), "</tbody></table>").alias("html"))


def _zip(members: list[tuple[str, str]]) -> bytes:
    """A package of stored members, byte by byte as zipfile writes it, but in a tenth of its time."""
    out, directory, at = [], [], 0
    for name, text in members:
        raw, own = text.encode(), name.encode("ascii")
        # Method, time, date (2000-01-01), checksum, both sizes, and lengths of the name and of extra fields.
        entry = struct.pack("<HHHLLLHH", 0, 0, 0x2821, zlib.crc32(raw), len(raw), len(raw), len(own), 0)
        out += (b"PK\3\4\x14\0\0\0", entry, own, raw)
        directory.append(b"PK\1\2\x14\3\x14\0\0\0" + entry + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + own)
        at += 30 + len(own) + len(raw)
    end = b"".join(directory)
    return b"".join([*out, end, b"PK\5\6\0\0\0\0", struct.pack("<HHLLH", len(members), len(members), len(end), at, 0)])


_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _rels(rows: list[tuple[str, str, str, bool]]) -> str:
    own = "".join(f'<Relationship Id="{i}" Type="{_REL}/{kind}" Target="{target}"{" TargetMode=\"External\"" if outside else ""}/>' for i, kind, target, outside in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{own}</Relationships>'


PICTURES = "http://schemas.openxmlformats.org/drawingml/2006/main"


def _document(lines: list[dict]) -> list[tuple[str, str]]:
    """Paragraphs of runs with properties by flag; fields begin and end by supplier, simple fields by part; links; pictures, some of which are missing."""
    out, rels, media = [], [], []
    for par in sorted({x["par"] for x in lines}):
        out.append("<w:p>")
        for x in (x for x in lines if x["par"] == par):
            if x["suppkey"] % 7 < 2:
                out.append(f'<w:r><w:fldChar w:fldCharType="{"end" if x["suppkey"] % 7 else "begin"}"/></w:r>')
            run = f'<w:r>{"<w:rPr><w:b/></w:rPr>" if x["flag"] == "A" else ""}<w:t>T{x["partkey"]}</w:t></w:r>'
            out.append(f"<w:fldSimple>{run}</w:fldSimple>" if x["partkey"] % 11 == 0 else f'<w:hyperlink r:id="h">{run}</w:hyperlink>' if x["partkey"] % 4 == 1 else run)
            if x["flag"] == "R":
                rels.append((f"rId{x['i']}", "image", f"media/i{x['i']}.png", False))
                media += [(f"word/media/i{x['i']}.png", "png")] * (x["partkey"] % 5 > 0)
        out.append("</w:p>")
    text = f'<w:document xmlns:w="w" xmlns:r="{_REL}"><w:body>{"".join(out)}</w:body></w:document>'
    return [("word/document.xml", text), ("word/_rels/document.xml.rels", _rels([*rels, ("h", "hyperlink", "https://example.org", True)])), *media]


def _workbook(order: int, lines: list[dict]) -> list[tuple[str, str]]:
    """A shared string for each line, in pieces for one flag; cells that refer to strings by rule, one past the end at times; formulas by status."""
    strings = "".join(f"<si><r><t>T</t></r><r><t>{x['partkey']}</t></r></si>" if x["flag"] == "A" else f"<si><t>T{x['partkey']}</t></si>" for x in lines)
    cells = "".join(f'<c r="A{x["i"]}" t="s"><v>{(x["i"] * 7 + x["partkey"]) % (len(lines) + 1)}</v></c>' + f"<c r=\"B{x['i']}\" t=\"s\"><f>'Data {order}'!A1+Other!B1</f><v>0</v></c>" * (x["status"] == "F") for x in lines)
    charts = [(f"xl/charts/chart{x['i']}.xml", "<c/>") for x in lines if x["flag"] == "N"]
    book = f'<workbook><sheets><sheet name="Data {order}"/><sheet name="{order}"/></sheets></workbook>'
    return [("xl/workbook.xml", book), ("xl/sharedStrings.xml", f"<sst>{strings}</sst>"), ("xl/worksheets/sheet1.xml", f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>"), *charts]


def _slides(order: int, lines: list[dict]) -> list[tuple[str, str]]:
    """A slide for each half of the lines, shown in either order; runs with properties by flag, whose attributes change places; breaks, and runs without text."""
    pars, members = sorted({x["par"] for x in lines}), []
    for par in pars:
        runs = []
        for x in (x for x in lines if x["par"] == par):
            properties = {"A": '<a:rPr b="1" i="0"/>' if x["partkey"] % 2 else '<a:rPr i="0" b="1"/>', "R": '<a:rPr lang="x"><a:latin/></a:rPr>'}.get(x["flag"], "")
            runs.append(f"<a:r>{properties}<a:t>T{x['partkey']}</a:t></a:r>" + "<a:r><a:rPr/></a:r>" * (x["suppkey"] % 5 == 0) + "<a:br/>" * (x["partkey"] % 3 == 0))
        members.append((f"ppt/slides/slide{par + 1}.xml", f'<p:sld xmlns:p="p" xmlns:a="{PICTURES}"><p:txBody><a:p>{"".join(runs)}</a:p></p:txBody></p:sld>'))
    shown = pars if order % 4 < 2 else pars[::-1]
    deck = f'<p:presentation xmlns:p="p" xmlns:r="{_REL}"><p:sldIdLst>{"".join(f"<p:sldId r:id=\"rId{n + 1}\"/>" for n in shown)}</p:sldIdLst></p:presentation>'
    return [("ppt/presentation.xml", deck), ("ppt/_rels/presentation.xml.rels", _rels([(f"rId{n + 1}", "slide", f"slides/slide{n + 1}.xml", False) for n in pars])), *members]


def office_file(order: int, lines: list[dict]) -> bytes:
    """An office file of an order: document, workbook or slides; some break a rule."""
    members = _document(lines) if order % 3 == 0 else _workbook(order, lines) if order % 3 == 1 else _slides(order, lines)
    members += {1: [members[0]], 2: [("word/vbaProject.bin", "x")], 3: [("../up.txt", "x")], 4: [("word/document.xml" if order % 3 else "xl/workbook.xml", "<x/>")]}.get(order % 11, [])
    raw = _zip(members)
    return raw[:40] if order % 11 == 5 else raw


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: an office file for each order, made from its lines. Lines come as plain sorted rows, as nested ones take longer to hand over than a file to make."""
    fields = ("par", "linenumber", "partkey", "suppkey", "flag", "status")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), (F.col("l_linenumber") % 2).alias("par"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    lines = lines.repartition("o").sortWithinPartitions("o", "par", "linenumber", "partkey", "suppkey", "quantity", "flag", "status").select("o", *fields)

    def files(orders):
        rows = [(f"o{o}.zip", office_file(o, own)) for o, own in orders]
        return pa.RecordBatch.from_arrays([pa.array([path for path, _ in rows], pa.string()), pa.array([raw for _, raw in rows], pa.binary())], names=["path", "content"])

    def run(batches):
        last, held = None, []  # the lines of the last order, which may go on in the next batch
        for batch in batches:
            orders = []
            columns = [c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]  # numpy makes the same values sooner, but for nulls
            for o, own in groupby(zip(*columns, strict=True), key=lambda x: x[0]):
                if o != last and held:
                    orders.append((last, held))
                    held = []
                last = o
                held += [dict(zip(fields, x[1:], strict=True), i=i) for i, x in enumerate(own, len(held) + 1)]
            yield files(orders)
        if held:
            yield files([(last, held)])

    return lines.mapInArrow(run, "path string, content binary")
