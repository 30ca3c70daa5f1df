"""Edge cases of the operators, and ordered folds against plain loops."""

import datetime as dt
import io
import json
import random
import re
import unicodedata
import warnings
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.arrow import distributed, nfkc, qualifiers, requalified, sheet_references
from quillspark.operators import checks, feedback, jobs, limits, names, rendering, review, windows
from quillspark.operators.segments import line_segments, replaced
from quillspark.sources import packages, parsers
from quillspark.streaming import folds

PAIR = "doc_id long, segment_id string, location string, source string, candidate string"


def one(spark, column, **values):
    names_ = list(values)
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[k] for k in names_)], schema).select(column.alias("x")).first().x


def codes(spark, source, candidate):
    return sorted(r.code for r in checks.findings(spark.createDataFrame([(1, "s", "l", source, candidate)], PAIR)).collect())


@pytest.mark.parametrize(
    ("source", "candidate", "want"),
    [
        ("a 1 2", "", ["coverage"]), ("a", "  \t", ["coverage"]), ("a", None, ["coverage"]), ("1 then 2", "2 dann 1", []), ("1,234", "1.234", ["numbers"]), ("٣", "3", ["numbers"]),
        ("see http://a.b/c http://a.b/c", "nichts", ["url", "url"]), ("x", "y [Omitted here]", ["placeholder"]), (None, "y", []),
    ],
)
def test_findings(spark, source, candidate, want):
    assert codes(spark, source, candidate) == want


def test_nfkc_joins_full_width_digits(spark):
    row = spark.createDataFrame([("１２", "12"), (None, None)], "a string, b string").select((T.numbers(nfkc("a")) == T.numbers(F.col("b"))).alias("same"), nfkc("a").alias("n")).collect()
    assert row[0].same and row[1].n is None


def test_status_rules(spark):
    docs = spark.createDataFrame([(k,) for k in range(1, 6)], "doc_id long")
    found = spark.createDataFrame([(1, "x", "info"), (2, "x", "review"), (3, "x", "error")], "doc_id long, code string, severity string")
    rolled = spark.createDataFrame([(1, "a", "passed"), (2, "a", "passed"), (3, "a", "passed"), (4, "a", "unavailable")], "doc_id long, check_name string, status string")
    got = {r.doc_id: r.status for r in checks.report_status(docs, found, rolled).collect()}
    assert got == {1: "passed", 2: "needs_review", 3: "failed", 4: "needs_review", 5: "needs_review"}


def test_lines_and_offsets(spark):
    text = "ab\r\n\n 12 \n𝒳y z"
    rows = line_segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("line_no").collect()
    assert [(r.source, r.location) for r in rows] == [("ab", "offset:0:2"), ("𝒳y z", "offset:10:14")]
    assert rows[0].context == text


def test_page_windows_tail(spark):
    rows = windows.page_windows(spark.createDataFrame([(1, k, str(k)) for k in range(5)], "doc_id long, page_no long, body string")).orderBy("window_start").collect()
    assert [(r.window_start, r.page_nos) for r in rows] == [(0, [0, 1, 2, 3, 4]), (4, [4])]


def test_evidence_edges(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [("k", d, d, now - dt.timedelta(days=30) if d == 0 else now, ["numbers"], ["numbers"] if d < 2 else []) for d in range(10)] + [("k", 99, 99, now + dt.timedelta(seconds=1), ["numbers"], ["numbers"])]
    df = spark.createDataFrame(rows, "kind string, obs_id long, doc long, ts timestamp_ntz, eligible array<string>, failures array<string>")
    got = {r.code: r for r in feedback.evidence(df.filter(feedback.in_window(F.col("ts"), F.lit(now).cast("timestamp_ntz")))).collect()}
    assert (got["numbers"].documents, got["numbers"].failures, got["numbers"].rate, got["numbers"].active) == (10, 2, 0.2, True)
    assert (got["coverage"].documents, got["coverage"].rate, got["coverage"].active) == (0, 0.0, False)


def loop_admitted(rows, days, cap):
    state, out = [], []
    for kind, n, doc, ts in sorted(rows, key=lambda r: (r[3], r[1])):
        state = [s for s in state if s[1] >= ts - dt.timedelta(days=days)]
        if doc in [s[0] for s in state]:
            continue
        out.append(n)
        state = sorted([*state, (doc, ts)], key=lambda s: s[1])[-cap:]
    return out


def test_evidence_fold(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [("k", n, rnd.randrange(12), base + dt.timedelta(hours=rnd.randrange(600))) for n in range(300)]
    df = spark.createDataFrame(rows, "kind string, obs_id long, doc long, ts timestamp_ntz")
    want = sorted(loop_admitted(rows, 5, 6))
    assert sorted(r.obs_id for r in feedback.admitted(df, 5, 6).collect()) == want
    assert len(want) < 300


def test_limiter_edges():
    times: list[float] = []
    assert [limits.decide(times, float(t), 2, 60) for t in (0, 1, 2, 60, 60.5)] == [None, None, 58, None, 1]


def test_streams_equal_batches(spark, tmp_path):
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(n % 5, n, base + dt.timedelta(seconds=rnd.randrange(400)), n % 9) for n in range(300)]
    df = spark.createDataFrame(rows, "identity long, request_id long, ts timestamp_ntz, doc long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = folds.run_to_end(folds.limited_stream(stream, 3, 60), "limited_rows").select("request_id", "accepted").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, limits.limited(df, 3, 60).select("request_id", "accepted").collect()))
    seen = folds.run_to_end(folds.admitted_stream(stream.select(F.col("identity").cast("string").alias("kind"), F.col("request_id").alias("obs_id"), "doc", "ts"), 1, 4), "admitted_rows")
    want = feedback.admitted(df.select(F.col("identity").cast("string").alias("kind"), F.col("request_id").alias("obs_id"), "doc", "ts"), 1, 4)
    assert sorted(r.obs_id for r in seen.collect()) == sorted(r.obs_id for r in want.collect())
    beats = stream.select(F.col("identity").alias("job_id"), F.col("request_id").alias("event_id"), "ts", F.concat(F.lit("w"), F.col("doc") % 2).alias("owner"), F.when(F.col("doc") % 3 == 0, "claim").when(F.col("doc") % 3 == 1, "heartbeat").otherwise("finish").alias("action"))
    assert folds.run_to_end(folds.leases_stream(beats, 30), "lease_rows").count() == 300


def test_claims_equal_repeated_claims(spark):
    rnd = random.Random(7)
    rows = [(n, n % 4, f"p{rnd.randrange(3)}", "running" if rnd.random() < 0.1 else "queued", n) for n in range(60)]
    j = spark.createDataFrame(rows, "id long, batch_id long, provider string, state string, row_no long")
    b = spark.createDataFrame([(k, dt.datetime(2024, 1, 2 if k else 1)) for k in range(4)], "id long, expires timestamp_ntz")
    now = F.expr("timestamp_ntz '2024-01-01'")
    running = [r[2] for r in rows if r[3] == "running"]
    want = []
    for r in rows:
        if r[3] == "queued" and r[1] and len(running) < 14 and running.count(r[2]) < 5:
            running.append(r[2])
            want.append(r[0])
    assert [r.id for r in jobs.claimable(j, b, now, 14, 5).orderBy("claim_no").collect()] == want


def test_lease_boundaries(spark):
    now = dt.datetime(2024, 1, 1)
    j = spark.createDataFrame([(1, "running", now, False, "w"), (2, "running", now - dt.timedelta(seconds=1), True, "w"), (3, "running", now - dt.timedelta(seconds=1), False, "w")], "id long, state string, lease_until timestamp_ntz, cancel_requested boolean, owner string")
    assert [(r.state, r.owner) for r in jobs.recovered(j, F.lit(now).cast("timestamp_ntz")).orderBy("id").collect()] == [("running", "w"), ("cancelled", None), ("queued", None)]


def test_sheet_names(spark):
    wanted = [("a", "x/y"), ("b", "X Y"), ("c", "History"), ("d", "  "), ("e", "n" * 40), ("f", "N" * 40), ("g", "'x y'"), ("h", "x y (2)"), ("i", None), ("j", "' '")]
    df = spark.createDataFrame([(w, k, *x) for w in (1, 2) for k, x in enumerate(wanted)], "workbook long, pos long, original string, wanted string")
    got = [(r.workbook, r.sheet_name) for r in names.sheet_names(df).orderBy("workbook", "pos").collect()]
    own = ["x y", "X Y (2)", "History_1", "d", "n" * 31, "N" * 27 + " (2)", "x y (3)", "x y (2) (2)", "i", "j"]
    assert got == [(w, n) for w in (1, 2) for n in own]


def test_small_functions(spark):
    assert one(spark, T.retry_delay(F.col("m"), F.col("h"), F.col("a")), m="429", h="Tue", a=2) == 60
    assert one(spark, T.retry_delay(F.col("m"), F.col("h"), F.col("a")), m="bad", h="3", a=2) is None
    assert one(spark, T.unfenced(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.sanitized(F.col("t")), t="a\0b\x01c\td") == "a• b c\td"
    assert one(spark, T.edges_of(F.col("s"), F.col("v")), s="  a\n", v=" b ") == "  b\n"
    assert one(spark, T.formula_guard(F.col("s"), F.col("v")), s="a", v=" =b")
    assert one(spark, T.markdown_escaped(F.col("t")), t="a*b\n c") == "a\\*b c"
    assert one(spark, qualifiers("f"), f="='My ''x'''!A1+Sheet2!B2+\"No!C1\"+'[1]Ext'!A1") == ["My 'x'", "Sheet2"]
    assert one(spark, names.valid_component(F.lit("table"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.5))), x=1)
    assert not one(spark, names.valid_component(F.lit("table"), F.array(F.lit(0.0), F.lit(0.6), F.lit(1.0), F.lit(0.5))), x=1)
    assert one(spark, names.missing_letters(F.col("a"), F.col("b")), a="aab", b="ab") == ["a"]
    assert one(spark, distributed("t", F.array(F.lit(2), F.lit(2))), t="ab cd") == ["ab ", "cd"]
    assert one(spark, parsers.glossary(F.col("t")), t="a = b\n\na = c\n") == {"a": "c"} and one(spark, parsers.glossary(F.col("t")), t="bad") is None


def loop_frames(text):
    # Server-sent events one by one: frames up to the first terminal one, and what is wrong.
    got = []
    for part in re.split(r"\r?\n\r?\n", text):
        data = "\n".join(x[5:].lstrip() for x in re.split(r"\r?\n", part) if x.startswith("data:"))
        if not data:
            continue
        try:
            event = json.loads(data)
        except ValueError:
            return got, "malformed"
        got.append(data)
        if isinstance(event, dict) and event.get("type") in ("complete", "error"):
            return got, None
    return got, "truncated"


def test_event_frames(spark):
    stage, done, late = 'data: {"type": "stage"}', 'data:\t {"type":\r\ndata: "complete"}', 'data: {"type": "late"}'
    texts = [f"{stage}\n\n{done}\r\n\r\n{late}\n\n", f"{stage}\r\n\r\n: note\n\n{done}", f"{stage}\n\n", f"{stage}\n\ndata: {{bad\n\n{done}\n\n", "", "data: 1\n\ndata: {\"type\": \"error\"}\n\n", f"event: x\n{done}\n\n{late}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", parsers.event_frames(F.col("t")).alias("e"))
    assert [(r.e.frames, r.e.error) for r in df.orderBy("k").collect()] == [loop_frames(t) for t in texts]


def test_numbers_in_other_forms(spark):
    texts = ["x １２", "x 12", "½ cup", "㏠ ⒈ ⑽", "3．5", "٣٤ and 𝟙𝟚", "5․6 … 7", "①②", "a12b,3"]
    for t in texts:
        want = sorted(re.findall(r"\d+(?:[.,]\d+)*", unicodedata.normalize("NFKC", t)))
        assert one(spark, T.numbers(F.col("t")), t=t) == want, t
    pairs = spark.createDataFrame([(1, "s", "l", "x １２", "x 12"), (1, "t", "l", "x １２", "x 13")], "doc_id long, segment_id string, location string, source string, candidate string")
    assert [(r.segment_id, r.code) for r in checks.findings(pairs).collect()] == [("t", "numbers")]
    assert one(spark, T.block_type(F.col("t")), t="第１条 x") == "article"


def test_numbers_of_random_texts(spark):
    rnd = random.Random(9)
    odd = list(T._number_forms()) + list("12.,aé½²①…éß٣\u0301\u20ac\u2023\u218a\u33ff\ufe0f") + [" "] * 40
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(30))) for _ in range(3000)] + [" \x1c\u3000", "", "\x1f."]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.numbers(F.col("t")).alias("n"), T.blank(F.col("t")).alias("b")).collect()
    for r in rows:
        assert r.n == sorted(re.findall(r"\d+(?:[.,]\d+)*", unicodedata.normalize("NFKC", texts[r.k]))), repr(texts[r.k])
        assert r.b == (texts[r.k].strip() == "")


def test_bad_files(spark):
    df = spark.createDataFrame([(1, "{bad"), (2, '{"a": "ok"}'), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.category) for r in parsers.segments(df, "json").orderBy("doc_id").collect()] == [(1, "error"), (2, "structured_value")]
    wide = spark.createDataFrame([(1, "a,b\n" + "x" * 200_000 + ",y")], "doc_id long, text string")
    assert parsers.segments(wide, "csv").count() == 4


def test_retry_delay(spark):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    wait = lambda **v: one(spark, T.retry_delay(F.col("m"), F.col("h"), F.lit(0), now, F.col("d")), **{"m": "429", "h": "", "d": "[]"} | v)
    assert wait(h="Tue, 30 Jan 2024 00:01:30 GMT") == 90 and wait(h="Mon, 29 Jan 2024 00:00:00 GMT") == 1 and wait(h="soon") == 15
    assert wait(d='[{"x": 1}, {"retryDelay": "x"}, {"retryDelay": "2.5s"}]') == 2.5 and wait(h="4", d='[{"retryDelay": "2s"}]') == 4 and wait(d="no") == 15


def test_long_documents(spark):
    text = "\n".join(f"line {k} é" for k in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = line_segments(docs).collect()
    assert len(rows) == 16_000
    for r in rows[::997]:
        a, b = map(int, r.location.split(":")[1:])
        assert text[a:b] == r.source and text[max(0, a - 150) : b + 150] == r.context
    changed = line_segments(docs).withColumn("candidate", F.concat("source", F.lit("!")))
    out = replaced(docs, changed.drop("candidate"), changed).first().rendered
    assert out == "\n".join(f"line {k} é!" for k in range(16_000))


def loop_leases(rows, span):
    held, out = {}, []
    for job, n, ts, owner, action in sorted(rows, key=lambda r: (r[2], r[1])):
        who, until = held.get(job, ("", dt.datetime.min))
        who = who if until >= ts else ""
        if action == "claim":
            out.append((n, "busy" if who else "claimed"))
            held[job] = (who, until) if who else (owner, ts + dt.timedelta(seconds=span))
        elif who == owner:
            out.append((n, "extended" if action == "heartbeat" else "finished"))
            held[job] = (owner, ts + dt.timedelta(seconds=span)) if action == "heartbeat" else ("", dt.datetime.min)
        else:
            out.append((n, "lost"))
            held[job] = (who, until)
    return sorted(out)


def test_leases(spark, tmp_path):
    rnd = random.Random(4)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.randrange(3), n, base + dt.timedelta(seconds=rnd.randrange(2000)), f"w{rnd.randrange(2)}", rnd.choice(["claim", "heartbeat", "finish"])) for n in range(200)]
    schema = "job_id long, event_id long, ts timestamp_ntz, owner string, action string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = folds.run_to_end(folds.leases_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "e")), 60), "leases")
    assert sorted((r.event_id, r.outcome) for r in got.collect()) == loop_leases(rows, 60)


def test_writers_and_pages(spark):
    page = '<ul><li title="a &lt; b">One &amp; <b>two</b></li></ul><pre>x</pre>'
    assert rendering.write_html(page, {"text:0": "Eins & ", "element:1/@title": '"'}) == '<ul><li title="&quot;">Eins &amp; <b>two</b></li></ul><pre>x</pre>'
    assert rendering.write_html(page, {}) == page and rendering.write_spans("a b\nc", {"offset:4:5": "d"}) == "a b\nd"
    with pytest.raises(ValueError, match="expression"):
        rendering.write_csv("a,b\n1,2\n", {"row:2/column:1": " =1"})
    assert one(spark, rendering.toc_lines(F.col("t")), t="Chapter 1 x  Chapter 2 y\n```\n\n7") == "Chapter 1 x\nChapter 2 y\n[Page: 7]"
    assert one(spark, rendering.toc_lines(F.col("t")), t="") == one(spark, rendering.unsquashed(F.col("t")), t="") == ""
    assert one(spark, rendering.unsquashed(F.col("t")), t="a • b\n\n<td> 1.1 x\n") == "  • a\n  • b\n\n<td> 1.1 x"
    assert rendering.fractions("x\n\n$$v = \\frac{a{b{c}}}{\\text{d}} $$ and $$ y") == 'x\n<table class="formula-table"><tr><td>v =</td><td>a{b{c}}</td></tr><tr><td></td><td>d</td></tr></table>\n and $$ y'
    assert rendering.fractions("\\frac{a}{") == "\\frac{a}{" and rendering.fractions("\\frac{}{b}") == "\\frac{}{b}"
    assert rendering.toc_html("目次\n5\nA  7\n[Page: 3]").count("toc-entry") == 1 and rendering.toc_html("") == '<table class="toc-table"></table>'
    assert rendering.numbered_lists('<ol><li>a<ol start="3"><li>b</li></ol></li></ol>').count("<p ") >= 1
    assert rendering.normalised("") == ("", None) and rendering.normalised("x\n[Page: 3]") == ("x", 3)
    assert requalified("SUM('A''s'!B1:C2)+a.b!A1&\"a.b!\"", {"a's": "n", "a.b": "m'"}) == "SUM('n'!B1:C2)+'m''" + "'!A1&\"a.b!\""


def test_sheet_references():
    """Lexer states: strings, brackets, quoted and bare names, ranges of sheets, and parts that never end."""
    cases = {
        "A!1+'B c'!2": [["A"], ["B c"]], "'It''s'!A1": [["It's"]], '"A!"&B!1': [["B"]], "[x.xlsx]A!1": [], "'[x]A'!1": [["[x]A"]], "Jan:Mär!A1": [["Jan", "Mär"]], "'a:b'!1": [["a", "b"]],
        "T[A!]B!1": [], "a'B'!1": [], "'open A!1": [["A"]], '"open A!1': [["A"]], "x:y:z!1": [["y", "z"]], "": [], "!": [],
    }
    for formula, want in cases.items():
        assert [names_ for _, _, names_ in sheet_references(formula)] == want, formula
    assert requalified("'[x]A'!1+A!1+'a:b'!2", {"a": "N"}) == "'[x]A'!1+'N'!1+'N:b'!2"


def test_dealt_text(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("ab  \n漢字한") for _ in range(rnd.randrange(20))), [rnd.randrange(4) for _ in range(rnd.randrange(4))]) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string, s array<int>").select("t", "s", distributed("t", "s").alias("p")).collect()
    for r in got:
        units = re.findall(r"\s+|[\u3040-\u9fff\uac00-\ud7af]|[^\s\u3040-\u9fff\uac00-\ud7af]+", r.t)
        sizes = r.s or [0]
        stops = [round(len(units) * sum(sizes[: k + 1]) / (sum(sizes) or len(sizes))) for k in range(len(sizes) - 1)] + [len(units)]
        assert list(r.p) == ["".join(units[a:b]) for a, b in zip([0, *stops], stops)]


def test_halves(spark):
    halves = one(spark, review.halves(F.sequence(F.lit(1), F.col("n"))), n=9)
    assert [list(x) for x in halves] == [[1, 2], [3, 4], [5, 6], [7, 8, 9]]


def test_parsers():
    page = '<html><!-- c --><p>One <b>two</b></p><script>no()</script><img alt="pic"><table><tr><td>x&amp;y</td></tr></table></html>'
    assert [(a, s) for a, _, s, _ in parsers.html_segments(page)] == [("text:1", "One "), ("text:2", "two"), ("text:4", "x&y"), ("element:4/@alt", "pic")]
    assert [s for _, _, s, _ in parsers.csv_segments("a,b\n=x,c\n")] == ["a", "b", "c"]
    assert [a for a, *_ in parsers.json_segments('{"a/b": ["x", {"~": "y"}], "n": 1}')] == ["/a~1b/0", "/a~1b/1/~0"]
    text = "# Head\n\n- item `code` and [link](http://x.y)\n```\nfence\n```\nlast"
    assert [s.strip() for _, _, s, _ in parsers.markdown_segments(text) if s.strip()] == ["Head", "item", "and", "link", "last"]


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"kept"
        for name, raw in parts.items():
            z.writestr(name, raw)
    return out.getvalue()


def test_packages(spark):
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    book = office(**{
        "xl/workbook.xml": "<workbook/>",
        "xl/_rels/workbook.xml.rels": rel.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="x/worksheet" Target="gone.xml"/><Relationship Id="r3" Type="x/link" Target="http://a" TargetMode="External"/>'),
        "xl/worksheets/s1.xml": '<worksheet><c r="A1" t="s"><v>1</v></c><c r="A2" t="s"><v>9</v></c><c r="A3" t="s"><f>B1</f><v>0</v></c></worksheet>',
        "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>",
    })
    doc = office(**{"word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:rPr/><w:t>world</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:br/><w:t>after</w:t></w:r></w:p></w:document>'})
    files = spark.createDataFrame([("a.xlsx", book), ("b.docx", doc), ("c.docx", b"PKbroken")], "path string, content binary")
    parts = packages.members(files)
    got = {r.path: (r.kind, r.verdict == "ok") for r in packages.verdicts(parts).collect()}
    assert got == {"a.xlsx": ("xlsx", True), "b.docx": ("docx", True), "c.docx": (None, False)}
    assert [r.rel_id for r in packages.broken_relationships(parts).collect()] == ["r2"]
    assert {(r.cell, r.value) for r in packages.shared_cells(parts).collect()} == {("A1", "one"), ("A2", None)}
    assert [r.source for r in packages.text_units(parts).orderBy("location").collect()] == ["Hello world", "link", "after"]
    assert {r.kind for r in files.select(packages.sniffed(F.col("content")).alias("kind")).collect()} == {"zip"}
    assert {r.adapter for r in packages.capability(files).collect()} == {"office"}
    new = spark.createDataFrame([("b.docx", "word/document.xml", doc and b'<w:document xmlns:w="w"><w:p><w:r><w:t>Hallo</w:t></w:r></w:p></w:document>')], "path string, name string, raw binary")
    built = packages.rebuild(files.filter("path = 'b.docx'"), new)
    with zipfile.ZipFile(io.BytesIO(built.first().content)) as z:
        assert z.comment == b"kept" and b"Hallo" in z.read("word/document.xml")
    changes = packages.structure_changes(packages.canonical(parts.filter("path = 'b.docx'")), packages.canonical(packages.members(built)))
    assert [r.change for r in changes.collect()] == ["changed"]


def test_run_groups(spark):
    """Groups differ from translation units where styles change; fields are closed by depth, an end without a begin closes nothing."""
    w = lambda body: f'<w:document xmlns:w="w" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><w:p>{body}</w:p></w:document>'
    t = lambda x, props="": f"<w:r>{props}<w:t>{x}</w:t></w:r>"
    field = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    word = w(field("end") + t("one", "<w:rPr><w:b/></w:rPr>") + t("two") + field("begin") + t("in") + field("begin") + t("deep") + field("end") + t("still") + field("separate") + field("end") + t("out") + f"<w:fldSimple>{t('simple')}</w:fldSimple>" + "<w:r><a:p><a:r><a:t>drawn</a:t></a:r></a:p></w:r>")
    run = lambda x, props="": f"<a:r>{props}<a:t>{x}</a:t></a:r>"
    own = '<a:rPr b="1" i="0"><a:latin/></a:rPr>'
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p>' + run("a", own) + "<a:r><a:rPr/></a:r>" + run("b", '<a:rPr i="0" b="1">\n<a:latin/></a:rPr>') + run("c") + run("d") + "<a:fld/>" + run("e") + run("1", own) + "</a:p><a:p/></p:sld>"
    files = spark.createDataFrame([("w.docx", office(**{"word/document.xml": word})), ("p.pptx", office(**{"ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": slide}))], "path string, content binary")
    parts = packages.members(files)
    got = sorted((r.path, r.n_runs, r.source) for r in packages.run_groups(parts).collect())
    assert got == [("p.pptx", 1, "e"), ("p.pptx", 2, "ab"), ("p.pptx", 2, "cd"), ("w.docx", 1, "drawn"), ("w.docx", 1, "one"), ("w.docx", 1, "out"), ("w.docx", 1, "two")]
    units = {r.source for r in packages.text_units(parts).collect()}
    assert {"abcd", "e1"} <= units


def test_blocks_of_pages(spark):
    """Lines by the block that takes them; continuations by the same rule as the column function."""
    html_ = rendering.blocks_html
    assert html_("") == html_("\n```\n") == ""
    assert html_("a\nb  \nc") == '<div class="doc-paragraph">a b</div>\n<div class="doc-paragraph">c</div>'
    assert html_("<TABLE>\n# not a heading\n</TABLE>\n# one") == '<TABLE>\n# not a heading\n</TABLE>\n<div class="doc-title">one</div>'
    assert html_("<svg></svg>\nx") == '<svg></svg>\n<div class="doc-paragraph">x</div>' and html_("<svg>\nx") == "<svg>\nx"
    assert html_("|a|b|\nc|d\n\nc|d").count("<tr>") == 2 and html_("| a |\n├── b\n└── c").endswith('<div class="doc-tree">├── b\n└── c</div>')
    assert html_("① one\nkey: value\nkey: value") == '<div class="doc-subitem"><b>①</b> one</div>\n<div class="doc-subitem-desc">key: value</div>\n<div class="doc-subitem-desc">key: value</div>'
    assert html_("## x\n##### y\n第 2 章 z") == '<div class="doc-chapter">x</div>\n<div class="doc-subheading">y</div>\n<div class="doc-chapter">第 2 章 z</div>'
    rnd = random.Random(2)
    bits = ["a", "b c", "  d", "key: v", "1. x", "x:", "y  ", "z<br>", "│", "```", "<table>", "• p", "q\\\\", "", "Article 2", "3 n"]
    pairs = [(rnd.choice(bits), rnd.choice(bits)) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.continues(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        assert r.c == rendering.goes_on(r.a, r.b), (r.a, r.b)
    pages = [(1, 0, "# Guide\n2024"), (1, 1, "Contents\nChapter 1 ··· 4\n\nPage 2"), (1, 2, "1.1 clause\n```\nrest\n7"), (1, 3, None)]
    got = {r.page_no: (r.kind, r.html) for r in rendering.pages_html(spark.createDataFrame(pages, "doc_id long, page_no long, body string")).collect()}
    assert [got[k][0] for k in range(4)] == ["body" if k > 1 else "cover" if k == 0 else "contents" for k in range(4)]
    assert got[1][1].endswith('<div class="page-footer">2</div>') and got[2][1] == '<div class="doc-clause"><b>1.1</b> clause rest</div><div class="page-footer">7</div>' and got[3][1] == ""


def test_replaced_units(spark):
    """New text goes over the unit's runs; properties, links, breaks and other units stay."""
    w = '<w:document xmlns:w="urn:w"><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>Hello </w:t></w:r><w:r><w:t>wide world</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>after</w:t></w:r></w:p><w:p><w:r><w:t>2</w:t></w:r></w:p></w:document>'
    parts = packages.members(spark.createDataFrame([("a.docx", office(**{"word/document.xml": w, "word/x.bin": b"x"}))], "path string, content binary"))
    units = {r.source: r.location for r in packages.text_units(parts).collect()}
    assert set(units) == {"Hello wide world", "link", "after"}
    values = [("a.docx", "word/document.xml", units["Hello wide world"], "Guten Tag <Welt> da"), ("a.docx", "word/document.xml", units["after"], ""), ("a.docx", "word/document.xml", "p:9/u:9", "nowhere")]
    changed = packages.replaced_units(parts, spark.createDataFrame(values, "path string, part string, location string, value string"))
    rows = changed.collect()
    assert [(r.path, r.name) for r in rows] == [("a.docx", "word/document.xml")]
    raw = bytes(rows[0].raw).decode()
    runs = re.findall(r"<w:r>(.*?)</w:r>", raw)
    texts = [re.sub(r"<[^>]*>", "", r) for r in runs]
    assert "".join(texts[:2]) == "Guten Tag &lt;Welt&gt; da" and all(texts[:2]) and texts[2:] == ["link", "", "2"] and "<w:b />" in runs[0] and "<w:tab />" in runs[3] and "<w:hyperlink>" in raw
    again = packages.members(packages.rebuild(spark.createDataFrame([("a.docx", office(**{"word/document.xml": w, "word/x.bin": b"x"}))], "path string, content binary"), changed))
    assert {r.source for r in packages.text_units(again).collect()} == {"Guten Tag <Welt> da", "link"}


def test_units_are_replaced_package_by_package(spark):
    """Units, values and both packages stay in one row: nothing is joined or written to be read again (F1), and results are those of the joined operators."""
    import __spark_entry__ as entry

    plan = entry.queries()["replaced_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Repartition") == 1
    w = '<w:document xmlns:w="urn:w"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>wide 世界</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t/></w:r></w:p><w:tbl><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tbl></w:document>'
    slide = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:txBody><a:p><a:r><a:t>One</a:t></a:r><a:br/><a:r><a:t>two &amp; three</a:t></a:r></a:p></p:txBody></p:sld>'
    odd = io.BytesIO()
    with zipfile.ZipFile(odd, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"kept"
        z.writestr("word/é/", b"")
        z.writestr("word/document.xml", w)
        z.writestr("word/header1.xml", "<broken")
    rows = [("a", office(**{"word/document.xml": w, "word/footer1.xml": w, "word/x.bin": b"x"})), ("b", office(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": slide})), ("c", odd.getvalue()), ("d", b"PK"), ("e", None), ("f", office(**{"word/document.xml": w, "a/../b": b""})), ("g", office(**{"xl/workbook.xml": "<x/>"}))]
    files = spark.createDataFrame(rows, "path string, content binary")
    parts = packages.members(files).filter("verdict = 'ok'")
    found = packages.with_units(files)
    assert {r.path for r in found.collect()} == set("abcg")
    own = found.select("path", F.inline("units")).filter(F.col("source").rlike(packages.LETTER))
    units = packages.text_units(parts)
    assert sorted(own.collect()) == sorted(units.select(own.columns).collect()) and own.count() == 8
    new = {("a", "word/document.xml", "p:0/u:0"): "ein <sehr> langer Text", ("a", "word/document.xml", "p:1/u:0"): "zwei", ("a", "word/footer1.xml", "p:7/u:0"): "nowhere", ("b", "ppt/slides/slide1.xml", "p:0/u:2"): "neu", ("c", "word/document.xml", "p:0/u:1"): None, ("c", "word/header1.xml", "p:0/u:0"): "x", ("d", "word/document.xml", "p:0/u:0"): "x", ("g", "xl/workbook.xml", "p:0/u:0"): "x"}
    values = spark.createDataFrame([(*k, v) for k, v in new.items()], "path string, part string, location string, value string")
    changed = packages.replaced_units(parts, values)
    want = {r.path: bytes(r.content) for r in packages.rebuild(files.join(changed.select("path").distinct(), "path", "left_semi"), changed).collect()}
    beside = files.join(values.groupBy("path").agg(F.collect_list(F.struct("part", "location", "value")).alias("values")), "path", "left")
    made = packages.with_replaced_units(beside)
    got = {r.path: (bytes(r.new), r.names) for r in made.collect()}
    assert want == {k: v for k, (v, _) in got.items()} and {k: v for k, (_, v) in got.items()} == {"a": ["word/document.xml"], "b": ["ppt/slides/slide1.xml"], "c": ["word/document.xml"]}
    with zipfile.ZipFile(io.BytesIO(want["c"])) as z:
        assert z.comment == b"kept" and z.namelist() == ["word/é/", "word/document.xml", "word/header1.xml"]
    again = {(r.path, r.part, r.location): (r.source, r.change) for r in packages.reread_units(made).collect()}
    assert again["a", "word/document.xml", "p:0/u:0"] == ("ein <sehr> langer Text", None) and again["a", "word/document.xml", "p:1/u:0"] == ("zwei", None) and again["b", "ppt/slides/slide1.xml", "p:0/u:2"] == ("neu", None)
    assert ("c", "word/document.xml", "p:0/u:1") not in again and again["c", "word/document.xml", "p:0/u:0"] == ("Hello wide 世界", None) and {c for _, c in again.values()} == {None}
    # Members that a writer spoils, loses or adds are told; other prefixes, texts and bytes of equal meaning are no change.
    before = office(**{"word/document.xml": w, "word/styles.xml": '<s xmlns="u" b="1" a="2"/>', "word/x.bin": b"x", "word/y.bin": b"y"})
    after = office(**{"word/document.xml": w, "word/styles.xml": '<q:s xmlns:q="u" a="2" b="1"/>', "word/x.bin": b"z", "word/new.bin": b""})
    told = spark.createDataFrame([("a", before, after, ["word/document.xml"]), ("b", before, b"PK", ["word/y.bin"])], "path string, content binary, new binary, names array<string>")
    assert {(r.path, r.part, r.change) for r in packages.reread_units(told).collect() if r.change} == {("a", "word/x.bin", "changed"), ("a", "word/y.bin", "removed"), ("a", "word/new.bin", "added"), ("b", "word/document.xml", "removed"), ("b", "word/styles.xml", "removed"), ("b", "word/x.bin", "removed")}


def test_units_of_a_part():
    """Links, fields and breaks end units; a category is the first that matches around a paragraph; the places of units count on over those without text (F1)."""
    t = "<r><t>{}</t></r>".format
    raw = f"<hdr><tc><txBody><p>{t('a')}<ins>{t('b')}{t('c')}</ins><ins>{t('d')}</ins><r><br/><tab/><t>e</t></r><fld>{t('x')}</fld>{t('f')}</p></txBody><p/></tc><p><hyperlink><sdt>{t('g')}</sdt>{t('h')}</hyperlink><r><pict><p>{t('i')}</p></pict></r>{t('')}</p></hdr>"
    got = [(place, category, [x.text for x in own]) for place, category, own in packages._part_units(packages.ET.fromstring(raw))]
    cells = [("p:0/u:0", ["a"]), ("p:0/u:1", ["b", "c"]), ("p:0/u:2", ["d"]), ("p:0/u:5", ["e"]), ("p:0/u:7", ["f"])]
    assert got[:5] == [(place, "table_cell", own) for place, own in cells]
    assert got[5:] == [("p:2/u:0", "header", ["g"]), ("p:2/u:1", "header", ["h"]), ("p:2/u:3", "header", [None]), ("p:3/u:0", "header", ["i"])]


def test_plain_packages_are_read_and_written_as_zipfile_does():
    """Plain members need no file objects; packages that aren't plain are left to zipfile, with its errors (F1)."""
    fresh = {"b.xml": b"<new/>" * 9}
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        content, want = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(content, "w", method) as z:
            for k, name in enumerate(["a.xml", "b.xml", "c/d.bin"]):
                i = zipfile.ZipInfo(name, (1999, 12, 31, 23, 59, 58))
                i.compress_type, i.external_attr, i.create_system = method, k, k
                z.writestr(i, b"text " * 9 * k)
        whole = content.getvalue()
        with zipfile.ZipFile(io.BytesIO(whole)) as a, zipfile.ZipFile(want, "w") as b:
            plain = [(i.filename, i.file_size, a.read(i)) for i in a.infolist()]
            for i in a.infolist():
                b.writestr(i, fresh.get(i.filename, a.read(i)))
        assert [(i.filename, i.file_size, raw) for i, raw in packages._plain(whole)] == plain == [(i.filename, i.file_size, raw) for i, raw in packages._opened(whole)]
        assert packages._rebuilt(whole, fresh) == want.getvalue()
        for broken in (b"x" + whole, whole + b"x", whole[:-1], whole.replace(b"PK\1\2", b"PK\1\3", 1), whole.replace(b"PK\3\4", b"PK\3\5", 1), whole.replace(b"a.xml", b"z.xml", 1), b"", b"PK"):
            assert packages._plain(broken) is None
        with pytest.raises(zipfile.BadZipFile):
            packages._opened(whole[:-30])


def test_packages_are_opened_once(spark):
    """Verdicts, relationships, cells and slides come from one pass: packages are made, opened and read by one step each."""
    import __spark_entry__ as entry

    def passes(name):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("MapInArrow")

    assert passes("package_verdicts") == passes("package_features") == 2
    assert passes("broken_relationships") == passes("shared_cells") == passes("run_groups") == 3
    assert passes("slide_order") == passes("package_units") == 6 and passes("partial_parts") == 4
    assert passes("renamed_workbooks") <= 5 and passes("replaced_units") <= 5


def test_verdicts_by_package(spark):
    from quillspark.sources import packages

    files = [(path, office(**members)) for path, members in {"a": {"word/document.xml": b"x"}, "b": {"word/document.xml": b"x", "a/../b": b""}, "c": {"x": b""}, "d": {"xl/workbook.xml": b"", "word/document.xml": b""}, "e": {"word/document.xml": b"", "VBAProject.BIN": b""}}.items()]
    parts = packages.members(spark.createDataFrame([*files, ("f", b"PK"), ("g", None)], "path string, content binary"))
    got = {r.path: (r.kind, r.verdict) for r in packages.verdicts(parts).collect()}
    assert {k: got[k] for k in "abcde"} == {"a": ("docx", "ok"), "b": ("docx", "traversal"), "c": (None, "signature"), "d": (None, "signature"), "e": ("docx", "macro")}
    assert got.keys() == set("abcdefg") and got["f"][0] is None and got["g"][1] != "ok"


def test_packages_are_made_and_read_without_detours(spark):
    """Files are made from plain sorted rows, byte by byte as zipfile writes them; sound members are read at once, others as zipfile does."""
    from quillspark.plans import relations as R

    files = R.packages(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in files._jdf.queryExecution().optimizedPlan().toString()
    names, pieces = [("xl/workbook.xml", "é<x/>"), ("a.bin", ""), ("a.bin", "y" * 70_000)], io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(pieces, "w") as z:
        warnings.simplefilter("ignore")
        for name, text in names:
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text)
    assert R._zip(names) == pieces.getvalue()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("é.xml", "text " * 99)
        z.writestr("b", b"stored", zipfile.ZIP_STORED)

    class Reader:
        read = staticmethod(lambda i: "as zipfile does")

    def read(content):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            return [packages._member(Reader, i, content, e) for i, e in zip(infos, [*[i.header_offset for i in infos[1:]], z.start_dir], strict=True)]

    whole = packed.getvalue()
    assert read(whole) == [b"text " * 99, b"stored"] and read(pieces.getvalue())[2] == b"y" * 70_000
    assert read(whole.replace(b"stored", b"staled")) == [b"text " * 99, "as zipfile does"]
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        assert packages._member(Reader, z.infolist()[0], whole, 40) == "as zipfile does"  # goes on into what follows it
    orders = {o: n for o, n in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # orders go on over batches
    try:
        made = {r.path: r.content for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) == len(orders)
    for o, n in orders.items():
        if o % 3 == 1 and o % 11 not in (4, 5):
            with zipfile.ZipFile(io.BytesIO(made[f"o{o}.zip"])) as z:
                assert z.read("xl/sharedStrings.xml").count(b"<si>") == n


def test_written_values_are_not_broadcast(spark):
    """However small its files look, a table of values isn't gathered in the driver."""
    docs = spark.createDataFrame([(1, '["a"]'), (2, '["b"]')], "doc_id long, text string")
    out = rendering.written(docs, spark.createDataFrame([(1, "/0", "c")], "doc_id long, location string, value string"), "json")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.rendered for r in out.collect()} == {1: '[\n  "c"\n]', 2: '[\n  "b"\n]'}
