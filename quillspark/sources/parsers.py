"""Readers of structured text: HTML, CSV, JSON, Markdown, event frames, glossaries. Arrow batches in, rows out."""

from __future__ import annotations

import contextlib
import csv
import html
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = pa.schema([("doc_id", pa.int64()), ("location", pa.string()), ("category", pa.string()), ("source", pa.string()), ("context", pa.string())])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "code", "pre"))
OBJECTS = {"table": "table", "img": "image_unknown", "svg": "diagram"}


class _Tree(HTMLParser):
    """Text nodes, attributes and objects of a page, numbered in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = [("", [])]
        self.nodes: list[tuple[int, str, bool, list[str]]] = []
        self.attributes: list[tuple[int, str, str]] = []
        self.objects: list[str] = []
        self.places: list[tuple[str, int, int, str, bool]] = []
        self.lines = [0]
        self.strings = self.elements = self.begin = 0
        self.held: list[str] = []

    def read(self, text: str) -> _Tree:
        self.lines += [k + 1 for k, c in enumerate(text) if c == "\n"]
        self.feed(text)
        self.close()
        self._flush(len(text))
        return self

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _flush(self, end: int | None = None):
        if self.held:
            self.places.append((f"text:{self.strings}", self.begin, self._offset() if end is None else end, "".join(self.held), False))
            text, self.held = "".join(self.held), []
            hidden = any(name in HIDDEN for name, _ in self.open)
            for _, own in self.open:
                own.append(text)
            self.nodes.append((self.strings, text, hidden, self.open[-1][1]))
            self.strings += 1

    def handle_data(self, data):
        if not self.held:
            self.begin = self._offset()
        self.held.append(data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        for key in ("alt", "title", "aria-label"):
            self.attributes += [(self.elements, key, v or "") for k, v in attrs if k == key][:1]
            tag_text = self.get_starttag_text() or ""
            value = re.search(rf"""\s{key}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag_text, re.I)
            if value and any(k == key for k, _ in attrs):
                k = 1 if value[1] is not None else 2
                self.places.append((f"element:{self.elements}/@{key}", self._offset() + value.start(k), self._offset() + value.end(k), html.unescape(value[k]), True))
        if tag in OBJECTS:
            self.objects.append(OBJECTS[tag])
        self.elements += 1
        if tag not in VOID:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        self._flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def _special(self, data):
        self._flush()
        self.strings += 1

    handle_comment = handle_decl = handle_pi = unknown_decl = _special


def _tree(text: str) -> _Tree:
    return _Tree().read(text)


def html_places(text: str) -> list[tuple[str, int, int, str, bool]]:
    """location, begin, end, text, is attribute of all text nodes and attribute values in the source."""
    return _tree(text).places


def html_segments(text: str) -> Iterator[tuple[str, str, str, str]]:
    tree = _tree(text)
    for k, value, hidden, parent in tree.nodes:
        if not hidden:
            yield f"text:{k}", "text", value, "".join(parent)[:3000]
    for k, name, value in tree.attributes:
        yield f"element:{k}/@{name}", "text", value, value


def sniffed_rows(text: str) -> tuple[list[list[str]], type[csv.Dialect] | csv.Dialect]:
    """Rows of a CSV text and its dialect, guessed from the start; fields may have any length."""
    csv.field_size_limit(1 << 31)
    dialect: type[csv.Dialect] = csv.excel
    with contextlib.suppress(csv.Error):
        dialect = csv.Sniffer().sniff(text[:8192])
    return list(csv.reader(io.StringIO(text, newline=""), dialect)), dialect


def csv_segments(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Cells; spreadsheet expressions are data that stay."""
    for i, row in enumerate(sniffed_rows(text)[0], 1):
        whole = json.dumps(row, ensure_ascii=False)
        yield from ((f"row:{i}/column:{j}", "table_cell", cell, whole) for j, cell in enumerate(row, 1) if cell[:1] != "=")


def json_segments(text: str) -> Iterator[tuple[str, str, str, str]]:
    stack = [("", json.loads(text))]
    while stack:
        path, value = stack.pop()
        if isinstance(value, str):
            yield path, "structured_value", value, f"{path}: {value}"
        elif isinstance(value, dict):
            stack += [(f"{path}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{path}/{k}", v) for k, v in reversed(list(enumerate(value)))]


# What Markdown keeps out of translation.
PROTECTED = re.compile(r"(?ms)^```.*?^```[^\n]*|^~~~.*?^~~~[^\n]*|`[^`\n]*`|\]\([^\n)]*\)|https?://[^\s]+|^\s*\[[^\]]+\]:[^\n]*$|<[^>]*>")
MARKERS = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]+|[-+*][ \t]+|\d+[.)][ \t]+|>[ \t]*)")
PROSE = re.compile(r"[^\n\r#*_|\[\]<>`~()]+")


def markdown_segments(text: str) -> Iterator[tuple[str, str, str, str]]:
    """Prose spans less the protected intervals, by one sweep over the sorted intervals."""
    barred: list[list[int]] = []
    for a, b in sorted(m.span() for p in (PROTECTED, MARKERS) for m in p.finditer(text)):
        if barred and a <= barred[-1][1]:
            barred[-1][1] = max(b, barred[-1][1])
        else:
            barred.append([a, b])
    k = 0
    for match in PROSE.finditer(text):
        at, end = match.span()
        while k < len(barred) and barred[k][1] <= at:
            k += 1
        j = k
        while at < end:
            stop = min(end, barred[j][0]) if j < len(barred) else end
            if at < stop:
                yield f"offset:{at}:{stop}", "text", text[at:stop], text[max(0, at - 150) : stop + 150]
            if j >= len(barred) or barred[j][0] >= end:
                break
            at, j = max(at, barred[j][1]), j + 1


READERS: dict[str, Callable[[str], Iterator[tuple[str, str, str, str]]]] = {"html": html_segments, "htm": html_segments, "csv": csv_segments, "json": json_segments, "md": markdown_segments}


def segments(docs: DataFrame, kind: str, column: str = "text") -> DataFrame:
    """[A11-A14, A16] Segments of docs(doc_id, column): doc_id, location, category, source, context. A text that can't be read gives one row of category error with the reason as its source."""
    read = READERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    own = list(read(text or "null" if kind == "json" else text or ""))
                except (ValueError, csv.Error, RecursionError) as e:
                    own = []
                    rows.append({"doc_id": doc, "location": "", "category": "error", "source": str(e)[:240] or type(e).__name__, "context": ""})
                for location, category, source, context in own:
                    if source.strip() and any(c.isalpha() for c in source):
                        rows.append({"doc_id": doc, "location": location, "category": category, "source": source.strip(), "context": context or source})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=SEGMENT)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=SEGMENT)

    return docs.select(F.col("doc_id").cast("long"), column).mapInArrow(run, "doc_id long, location string, category string, source string, context string")


def html_objects(docs: DataFrame, column: str = "text") -> DataFrame:
    """[A15] doc_id, object_no, category of tables, images and diagrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("object_no", pa.int64()), ("category", pa.string())])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "object_no": k, "category": c} for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, c in enumerate(_tree(t or "").objects)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), column).mapInArrow(run, "doc_id long, object_no long, category string")


def event_frames(text: Column) -> Column:
    """[A31] Struct of frames (JSON payloads of server-sent events, up to the first terminal one) and error (null, 'malformed' or 'truncated').

    A frame is what stands before a blank line, or the rest at the end; its data lines lose their leading white space and are joined by newlines.
    """
    data = lambda f: F.array_join(F.transform(F.filter(F.split(f, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, r"(?U)^data:\s*", "")), "\n")
    found = F.filter(F.transform(F.split(text, r"\r?\n\r?\n"), data), lambda x: x != "")
    kind = lambda f: F.when(F.try_parse_json(f).isNull(), "malformed").when(F.get_json_object(f, "$.type").isin("complete", "error"), "terminal")
    stops = F.transform(found, kind)
    first = F.array_min(F.filter(F.transform(stops, lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull()))
    how = F.get(stops, first)
    upto = F.when(first.isNull(), F.size(found)).when(how == "malformed", first).otherwise(first + 1)
    return F.struct(F.slice(found, F.lit(1), upto).alias("frames"), F.when(first.isNull(), "truncated").when(how == "malformed", how).alias("error"))


def glossary(text: Column) -> Column:
    """[A32, C13] Map of 'a = b' lines, the last of equal keys; null if a line is bad or there are over 200 pairs or 500 characters."""
    own = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(r"^\s*$"))
    side = lambda x, k: F.trim(F.regexp_extract(x, r"^([^=]*)=(.*)$", k))
    bad = F.exists(own, lambda x: ~x.rlike(r"^[^=]*\S[^=]*=.*\S") | (F.length(side(x, 1)) > 500) | (F.length(side(x, 2)) > 500)) | (F.size(own) > 200)
    backwards = F.reverse(F.transform(own, lambda x: side(x, 1)))
    pairs = F.transform(own, lambda x, i: F.struct(side(x, 1).alias("key"), side(x, 2).alias("value"), (F.size(own) - i).alias("from_end")))
    last = F.filter(pairs, lambda p: F.array_position(backwards, p["key"]) == p["from_end"])
    return F.when(~bad, F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))))


def decoded(content: Column) -> Column:
    """[A9] Text of a UTF-8 file without its byte order mark; null if it holds NUL or isn't UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^\ufeff", ""))
    return F.when(~F.contains(text, F.lit("\0")), text)


def inspected(files: DataFrame) -> DataFrame:
    """[A9] files(path, content, kind) with n_chars and error: null, 'encoding' (not UTF-8, or with NUL) or 'json' (kind json that doesn't parse)."""
    rows = files.withColumn("_t", decoded(F.col("content")))
    bad = (F.col("kind") == "json") & F.try_parse_json(F.col("_t")).isNull()
    return rows.withColumns({"n_chars": F.length("_t").cast("long"), "error": F.when(F.col("_t").isNull(), "encoding").when(bad, "json")}).drop("_t")
