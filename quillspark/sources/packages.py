"""Office packages: inspection, parts, relationships, shared strings, text runs; and the writer. Standard library only."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.arrow import dealt, requalified

# Capabilities by extension, package limits and signature parts.
OFFICE, IMAGES, PLAIN = ("xlsx", "pptx", "docx"), ("png", "jpg", "jpeg", "webp"), ("txt", "md", "csv", "json", "html", "htm")
CAPABILITIES = (
    [(k, "office", k, "native objects and immutable fields preserved") for k in OFFICE]
    + [("pdf", "pdf", "pdf", "translated reconstruction; visual review required")]
    + [(k, "image", "md", "text extraction, not image replication") for k in IMAGES]
    + [(k, "structured_text", k, "native syntax and protected fields validated") for k in PLAIN]
)
SIGNATURES = {"xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx", "word/document.xml": "docx"}
MAX_BYTES, MAX_MEMBERS = 512 << 20, 20_000


def capability(files: DataFrame) -> DataFrame:
    """[A1] files(path, ...) with kind, adapter, output, guarantee; null adapter for unknown extensions."""
    table = files.sparkSession.createDataFrame(CAPABILITIES, "kind string, adapter string, output string, guarantee string")
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.withColumn("kind", kind).join(F.broadcast(table), "kind", "left")  # 14 rows


def sniffed(content: Column) -> Column:
    """[A2, A8] Kind by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("D0CF11E0"), "ole").when(head.startswith("504B"), "zip").when(head.startswith("255044462D"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpg").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp").otherwise("text")
    )


MEMBER = "path string, pos int, name string, size long, sha256 string, encrypted boolean, error string, raw binary, package_kind string, verdict string"


#: Members are handed on in batches of about these many bytes, not package by package; each counts some for its other columns.
BATCH_BYTES, MEMBER_BYTES = 4 << 20, 200


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _member(z: zipfile.ZipFile, i: zipfile.ZipInfo, content: bytes, end: int) -> bytes:
    """The bytes of a member that ends at `end` or before: those of a sound stored or deflated one at once, anything else as zipfile reads it, with its errors."""
    at = i.header_offset
    if content[at : at + 4] == b"PK\3\4" and len(content) >= at + 30 and not i.flag_bits & 0x61 and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        named, extra = struct.unpack_from("<HH", content, at + 26)
        begin = at + 30 + named + extra
        raw = content[begin : begin + i.compress_size]
        if i.compress_type == zipfile.ZIP_DEFLATED:
            try:
                raw = zlib.decompressobj(-15).decompress(raw, i.file_size + 1)
            except zlib.error:
                return z.read(i)
        name = i.orig_filename.encode("utf-8" if i.flag_bits & 0x800 else "cp437")
        if begin + i.compress_size <= end and len(raw) == i.file_size and zlib.crc32(raw) == i.CRC and content[at + 30 : at + 30 + named] == name:
            return raw
    return z.read(i)


class _Entry(NamedTuple):
    """What zipfile.ZipInfo says of a plain member, and its fields in the directory."""

    filename: str
    flag_bits: int
    file_size: int
    fields: tuple


_DIRECTORY, _END = struct.Struct("<4s4B4HL2L5H2L"), struct.Struct("<4s4H2LH")


def _plain(content: bytes) -> list[tuple[_Entry, bytes]] | None:
    """The members of a package of sound stored or deflated ones, one behind the other, without comments, extra fields, folders or names beyond ASCII; None
    for any other package."""
    stop = len(content) - _END.size
    if stop < 0 or content[stop : stop + 4] != b"PK\5\6":
        return None
    _, _, _, _, _, size, start, remark = _END.unpack_from(content, stop)
    if remark or start + size != stop:
        return None
    own, at, upto, total = [], start, 0, 0
    while at < stop:
        if at + _DIRECTORY.size > stop:
            return None
        fields = _DIRECTORY.unpack_from(content, at)
        signature, _, _, version, _, flags, method, _, _, crc, packed, whole, named, extra, remark, _, _, _, begin = fields
        at += _DIRECTORY.size + named
        name, total = content[at - named : at], total + whole
        if signature != b"PK\1\2" or at > stop or version > 63 or flags & ~0x800 or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or extra or remark:
            return None
        if not name.isascii() or b"\0" in name or name.endswith(b"/") or total > MAX_BYTES or len(own) == MAX_MEMBERS or begin < upto or begin + 30 > start:
            return None
        own_named, own_extra = struct.unpack_from("<HH", content, begin + 26)
        first = begin + 30 + own_named + own_extra
        upto = first + packed
        if upto > start or content[begin : begin + 4] != b"PK\3\4" or content[begin + 30 : begin + 30 + own_named] != name:
            return None
        raw = content[first:upto]
        if method == zipfile.ZIP_DEFLATED:
            try:
                raw = zlib.decompressobj(-15).decompress(raw, whole + 1)
            except zlib.error:
                return None
        if len(raw) != whole or zlib.crc32(raw) != crc:
            return None
        own.append((_Entry(name.decode(), flags, whole, fields), raw))
    return own


def _opened(content: bytes | None) -> list[tuple[_Entry | zipfile.ZipInfo, bytes | None]]:
    """The members of a package and their bytes; None for the bytes of an encrypted one. Raises what zipfile does for a broken package."""
    content = content or b""
    if (plain := _plain(content)) is not None:
        return plain
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) > MAX_BYTES or len(infos) > MAX_MEMBERS:
            raise zipfile.BadZipFile("too large")
        begins = sorted(i.header_offset for i in infos)
        ends = dict(zip(begins, [*begins[1:], z.start_dir], strict=True))
        return [(i, None if i.flag_bits & 1 else _member(z, i, content, ends[i.header_offset])) for i in infos]


#: What a broken package raises when it is opened.
BROKEN = (zipfile.BadZipFile, OSError, EOFError)


def _sound(content: bytes | None) -> list[tuple[_Entry | zipfile.ZipInfo, bytes | None]]:
    """The members of a package and their bytes; none of a broken one."""
    try:
        return _opened(content)
    except BROKEN:
        return []


def members(files: DataFrame) -> DataFrame:
    """[A3] One row for each member of files(path, content); one row with an error for a broken package. Each row holds its package's kind and verdict, so that
    packages are opened once and their members needn't meet again. Paths tell files apart."""
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("encrypted", pa.bool_()), ("error", pa.string()), ("raw", pa.binary()), ("package_kind", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    own = [(path, k, i.filename, i.file_size, hashlib.sha256(raw).hexdigest() if raw is not None else None, bool(i.flag_bits & 1), None, raw) for k, (i, raw) in enumerate(_opened(content.as_py()))]
                except BROKEN as e:
                    own = [(path, -1, None, None, None, False, str(e) or "broken", None)]
                judged = _verdict([r[2] for r in own if r[2] is not None], any(r[5] for r in own), own[0][6] if own else None)
                rows += [(*r, *judged) for r in own]
                held += sum(len(r[-1] or b"") + MEMBER_BYTES for r in own)
                if held >= BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return files.select("path", "content").mapInArrow(run, MEMBER)


def _verdict(names: list[str], encrypted: bool, error: str | None = None) -> tuple[str | None, str]:
    """Kind and verdict of one package by the names of its members."""
    kinds = {SIGNATURES[x] for x in names if x in SIGNATURES}
    kind, whole = kinds.pop() if len(kinds) == 1 else None, "\n".join(["", *names])  # most packages need no look at single names
    rules = {
        "duplicate": len(names) > len(set(names)), "encrypted": encrypted, "signature": kind is None, "macro": "vbaproject.bin" in whole.lower() and any(x.lower().endswith("vbaproject.bin") for x in names),
        "traversal": ("\n/" in whole or "\\" in whole or ".." in whole) and any(x.startswith("/") or "\\" in x or ".." in x.split("/") for x in names),
    }
    return kind, error or next((k for k, broken in rules.items() if broken), "ok")


def verdicts(parts: DataFrame) -> DataFrame:
    """[A3] path, kind, verdict of each package: ok, or the first rule that it breaks."""
    return parts.filter("pos <= 0").select("path", F.col("package_kind").alias("kind"), "verdict")


def features(parts: DataFrame) -> DataFrame:
    """[A4, A6] path, feature, n, limitation: counts of special parts."""
    rules = {"charts": r"/charts/chart[^/]*\.xml$", "diagrams": r"/diagrams/data[^/]*\.xml$", "opaque_assets": r"/(embeddings|media)/", "legacy_shapes": r"\.vml$", "drawings": r"/drawings/drawing[^/]*\.xml$"}
    named = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in rules.items()]))
    return parts.select("path", F.explode(named).alias("feature")).groupBy("path", "feature").agg(F.count("*").alias("n")).withColumn("limitation", F.col("feature").isin("opaque_assets", "legacy_shapes"))


def _xml_rows(parts: DataFrame, schema: str, read, keep: Column) -> DataFrame:
    """Rows that read(path, name, root) yields for the XML members in keep."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[kind]) for n, kind in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    root = ET.fromstring(raw)
                except ET.ParseError:
                    continue
                rows += read(path, name, root)
            yield _batch(rows, arrow)

    return parts.filter(keep & F.col("raw").isNotNull()).select("path", "name", "raw").mapInArrow(run, schema)


def _relations(path: str, name: str, root: ET.Element) -> Iterator[tuple[str, str, str, str, str, bool]]:
    folder = posixpath.dirname(posixpath.dirname(name))
    for r in root:
        target, outside = r.get("Target", ""), r.get("TargetMode") == "External"
        full = target if outside else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        yield path, name, r.get("Id", ""), r.get("Type", "").rpartition("/")[2], full, outside


RELATION = "path string, source string, rel_id string, kind string, target string, external boolean"


def relationships(parts: DataFrame) -> DataFrame:
    """[A5] path, source, rel_id, kind, target (resolved), external."""
    return _xml_rows(parts, RELATION, _relations, F.col("name").endswith(".rels"))


def broken_relationships(parts: DataFrame) -> DataFrame:
    """[A5] Relationships whose target is no member. Members and relationships come from one pass over the parts and meet by target."""
    schema = pa.schema([(n, pa.string()) for n in ("path", "target", "source", "rel_id", "kind")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((path, name, None, None, None))
                try:
                    rows += [(path, target, source, rel_id, kind) for _, source, rel_id, kind, target, external in _relations(path, name, ET.fromstring(raw)) if not external] if raw is not None else []
                except ET.ParseError:
                    continue
            yield _batch(rows, schema)

    raw = F.when(F.col("name").endswith(".rels"), F.col("raw"))
    rows = parts.filter("name is not null").select("path", "name", raw.alias("raw")).mapInArrow(run, "path string, target string, source string, rel_id string, kind string")
    own = F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "rel_id", "kind")))  # the relationships of one package to one target
    met = rows.groupBy("path", "target").agg(F.bool_or(F.col("source").isNull()).alias("there"), own.alias("own")).filter("not there")
    return met.select("path", "target", F.inline("own")).select("path", "source", "rel_id", "kind", "target", F.lit(False).alias("external"))


@lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def shared_cells(parts: DataFrame) -> DataFrame:
    """[A19] Cells that refer to shared strings: path, sheet, cell, index, value; value is null where the index is out of range.

    Strings and cells come from one pass over the parts and meet by index.
    """

    def read(path, name, root):
        if name == "xl/sharedStrings.xml":
            for k, si in enumerate(x for x in root if _local(x.tag) == "si"):
                yield path, None, None, k, "".join(t.text or "" for t in si.iter() if _local(t.tag) == "t")
            return
        for c in root.iter():
            if _local(c.tag) == "c" and c.get("t") == "s" and not any(_local(x.tag) == "f" for x in c):
                v = next((x.text for x in c if _local(x.tag) == "v"), None)
                if v is not None and v.strip().isdigit():
                    yield path, name, c.get("r", ""), int(v), None

    keep = (F.col("name") == "xl/sharedStrings.xml") | F.col("name").rlike(r"^xl/worksheets/[^/]+\.xml$")
    rows = _xml_rows(parts, "path string, sheet string, cell string, index int, value string", read, keep)
    value = F.max("value").over(Window.partitionBy("path", "index"))  # a package has one table of strings, so one value
    return rows.withColumn("value", value).filter("sheet is not null").select("path", "sheet", "cell", "index", "value")


def slides(parts: DataFrame) -> DataFrame:
    """[A20] path, pos, part of slides in presentation order. Places and relationships come from one pass over the parts and meet by the relationship's id."""
    key = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def read(path, name, root):
        if name == "ppt/presentation.xml":
            for k, s in enumerate(x for x in root.iter() if _local(x.tag) == "sldId"):
                yield path, s.get(key, ""), k, None
        else:
            yield from ((path, rel_id, None, target) for _, _, rel_id, _, target, _ in _relations(path, name, root))

    rows = _xml_rows(parts, "path string, rel_id string, pos int, part string", read, F.col("name").isin("ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"))
    met = rows.groupBy("path", "rel_id").agg(F.collect_list("pos").alias("pos"), F.collect_list("part").alias("parts"))  # one relationship
    return met.select("path", F.explode("pos").alias("pos"), "parts").select("path", "pos", F.explode("parts").alias("part"))


# Elements around the runs of a paragraph, and what breaks a unit inside a run.
AROUND, BREAKS = frozenset(("hyperlink", "ins", "smartTag", "sdt", "sdtContent")), frozenset(("br", "tab", "drawing", "fldChar", "instrText", "pict"))


def _add_marks(node: ET.Element, link: str, marks: list[tuple[str, ET.Element | None]]) -> None:
    """The marks of a paragraph in document order: the links around a text and its node, or None for what breaks a unit."""
    for x in node:
        tag = _local(x.tag)
        if tag == "r":
            for y in x:
                kind = _local(y.tag)
                if kind == "t":
                    marks.append((link, y))
                elif kind in BREAKS:
                    marks.append(("", None))
        elif tag in AROUND:
            _add_marks(x, f"{link}/{tag}{len(marks)}", marks)
        elif tag in ("fld", "br"):
            marks.append(("", None))


#: What a unit's text must hold.
LETTER = r"\p{L}"

UNIT_PARTS = r"^(word/(document|header\d*|footer\d*|footnotes|endnotes)|ppt/(slides|notesSlides)/[^/]+)\.xml$"


UNIT_PART = re.compile(UNIT_PARTS, re.ASCII)

#: Categories of paragraphs by the elements around them; the first match wins. Behind a break a unit begins, whatever its links.
CATEGORIES, BREAK = {"tc": "table_cell", "txBody": "shape_text", "txbxContent": "shape_text", "hdr": "header", "ftr": "footer"}, "break"


def _is_unit_part(name: str) -> bool:
    return UNIT_PART.match(name) is not None and "/embeddings/" not in name


def _part_units(root: ET.Element) -> Iterator[tuple[str, str, list[ET.Element]]]:
    """Location, category and text nodes of the units of a part: gaps and islands over links, fields and breaks of a paragraph. A part is parsed by one task, so its units need no shuffle."""
    tags = [(x, _local(x.tag)) for x in root.iter()]
    boxes = sorted(((list(CATEGORIES).index(tag), x) for x, tag in tags if tag in CATEGORIES), key=lambda b: -b[0])
    category = {p: list(CATEGORIES.values())[rank] for rank, x in boxes for p in x.iter()}  # the first of those around a paragraph comes last
    for n, p in enumerate(x for x, tag in tags if tag == "p"):
        marks, own, island, before = [], [], 0, None
        _add_marks(p, "", marks)
        for link, node in marks:
            if node is None or (before is not None and link != before):
                if own:
                    yield f"p:{n}/u:{island}", category.get(p, "text"), own
                island, own = island + 1, []
            if node is not None:
                own.append(node)
            before = BREAK if node is None else link
        if own:
            yield f"p:{n}/u:{island}", category.get(p, "text"), own


def _source(own: list[ET.Element]) -> str:
    return "".join(x.text or "" for x in own)


def text_units(parts: DataFrame) -> DataFrame:
    """[A18, C4, C5] path, part, location, category, source: text of paragraphs, broken at links, fields and breaks."""

    def read(path, name, root):
        return ((path, name, location, category, _source(own)) for location, category, own in _part_units(root))

    keep = F.col("name").rlike(UNIT_PARTS) & ~F.contains("name", F.lit("/embeddings/"))
    return _xml_rows(parts, "path string, part string, location string, category string, source string", read, keep).filter(F.col("source").rlike(LETTER))


def _replaced(raw: bytes, given: dict[str, str | None]) -> bytes | None:
    """A part in which units are given other text by location; None if it has no such unit or is no XML."""
    reader = ET.XMLPullParser(["start-ns", "start"])
    try:
        reader.feed(raw)
        reader.close()
        events = list(reader.read_events())
    except ET.ParseError:
        return None
    root, changed = next(x for kind, x in events if kind == "start"), False
    for location, _, own in _part_units(root):
        if location in given:
            changed = True
            for node, text in zip(own, dealt(given[location], [len(x.text or "") for x in own]), strict=True):
                node.text = text
                node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    if not changed:
        return None
    for prefix, uri in (x for kind, x in events if kind == "start-ns"):
        if prefix and not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    # As ET.tostring writes UTF-8, but without its writer of streams.
    return ("<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(root, encoding="unicode")).encode(errors="xmlcharrefreplace")


def replaced_units(parts: DataFrame, values: DataFrame) -> DataFrame:
    """[B1, D12, R9] path, name, raw of the parts in which units are given other text by values(path, part, location, value).

    A unit's new text is dealt over its runs by their lengths (F10), so every run keeps its formatting, links and place; all marks besides stay. What
    isn't named stays as it is. Places of values that no unit has are passed over.
    """
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("raw", pa.binary())])
    given = values.groupBy("path", F.col("part").alias("name")).agg(F.collect_list(F.struct("location", "value")).alias("given"))  # the texts of one part

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((path, name, _replaced(raw, {x["location"]: x["value"] for x in own})) for path, name, raw, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            yield _batch([r for r in rows if r[2] is not None], schema)

    mine = parts.filter(F.col("name").rlike(UNIT_PARTS) & ~F.contains("name", F.lit("/embeddings/")) & F.col("raw").isNotNull())
    return mine.select("path", "name", "raw").join(given, ["path", "name"]).mapInArrow(write, "path string, name string, raw binary")


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES, by the bytes of their binary columns."""
    own, held, raws = [], 0, [k for k, f in enumerate(schema) if pa.types.is_binary(f.type)]
    for row in rows:
        own.append(row)
        held += MEMBER_BYTES + sum(len(row[k] or b"") for k in raws)
        if held >= BATCH_BYTES:
            yield _batch(own, schema)
            own, held = [], 0
    if own:
        yield _batch(own, schema)


def _units_in(opened: list[tuple[_Entry | zipfile.ZipInfo, bytes | None]]) -> Iterator[tuple[str, str, str, str]]:
    """Part, location, category and source of the units of a package's members."""
    for i, raw in opened:
        if raw is not None and _is_unit_part(i.filename):
            try:
                root = ET.fromstring(raw)
            except ET.ParseError:
                continue
            for location, category, own in _part_units(root):
                yield i.filename, location, category, _source(own)


def with_units(files: DataFrame) -> DataFrame:
    """[A3, A18] path, content, units (part, location, category, source) of the sound packages of files(path, content). A package's units stay beside it, so
    that they needn't be sent to meet it again."""
    unit = pa.struct([(n, pa.string()) for n in ("part", "location", "category", "source")])
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("units", pa.list_(unit))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                opened = _sound(content)
                if _verdict([i.filename for i, _ in opened], any(raw is None for _, raw in opened))[1] == "ok":
                    yield path, content, [dict(zip(("part", "location", "category", "source"), x, strict=True)) for x in _units_in(opened)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(read(batches), schema)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, units array<struct<part: string, location: string, category: string, source: string>>")


def with_replaced_units(files: DataFrame) -> DataFrame:
    """[B1, D12, R9] path, content, new, names of the packages of files(path, content, values) that change when their units are given other text by
    values (part, location, value), as replaced_units and rebuild do it: the package made anew, and its changed parts."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("new", pa.binary()), ("names", pa.list_(pa.string()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                content, given = content.as_py(), {}
                for x in values.as_py() or []:
                    given.setdefault(x["part"], {})[x["location"]] = x["value"]
                opened = _sound(content) if given else []
                fresh = {i.filename: _replaced(raw, given[i.filename]) for i, raw in opened if raw is not None and i.filename in given and _is_unit_part(i.filename)}
                fresh = {name: raw for name, raw in fresh.items() if raw is not None}
                if fresh:
                    yield path, content, _rebuilt(content, fresh, opened), list(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(write(batches), schema)

    return files.select("path", "content", "values").mapInArrow(run, "path string, content binary, new binary, names array<string>")


def reread_units(files: DataFrame) -> DataFrame:
    """[A18, D13, M14] path, part, location, category, source, change of files(path, content, new, names): the units of the packages made anew, and what became
    of the members besides names, which should be as they were: added, removed or changed, by structure_changes' rules."""
    schema = pa.schema([(n, pa.string()) for n in ("path", "part", "location", "category", "source", "change")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content, new, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                opened, named = _sound(new.as_py()), set(names.as_py() or [])
                yield from ((path, *unit, None) for unit in _units_in(opened))
                before, after = ({i.filename: raw for i, raw in x if raw is not None and i.filename not in named} for x in (_sound(content.as_py()), opened))
                for name in before | after:
                    a, b = before.get(name), after.get(name)
                    change = "added" if a is None else "removed" if b is None else "changed" if a != b and _canonical(name, a) != _canonical(name, b) else None
                    if change:
                        yield path, name, None, None, None, change

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(read(batches), schema)

    rows = files.select("path", "content", "new", "names").mapInArrow(run, "path string, part string, location string, category string, source string, change string")
    return rows.filter(F.col("change").isNotNull() | F.col("source").rlike(LETTER))


def run_groups(parts: DataFrame) -> DataFrame:
    """[A17] path, part, location, n_runs, source: text of neighbouring runs with the same properties.

    Parts become relations of marks in document order: texts, edges, and begins and ends of fields. Properties are told apart by
    their canonical XML (attributes in order of name). In word processing each text is a group, unless it lies in a field: the depth of open fields is a
    running sum that never falls below zero, so an end without a begin closes nothing. In drawings, runs of a paragraph are islands of one signature;
    anything but a run ends an island, a run without text doesn't.
    """

    def marks(path, name, root):
        n = paragraph = -1
        if name.startswith("word/"):
            opaque = {x for field in root.iter() if _local(field.tag) == "fldSimple" for x in field.iter()}
            for x in root.iter():
                tag = _local(x.tag)
                if tag == "p":
                    paragraph += 1
                elif tag == "fldChar":
                    n += 1
                    yield path, name, n, paragraph, None, "", {"begin": 1, "end": -1}.get(next((v for k, v in x.attrib.items() if _local(k) == "fldCharType"), ""), 0), False, True
                elif tag == "t" and not x.tag.startswith(A) and x not in opaque:
                    n += 1
                    yield path, name, n, paragraph, None, x.text or "", 0, True, True
        drawn = [p for p in root.iter() if _local(p.tag) == "p" and (p.tag.startswith(A) or not name.startswith("word/"))]
        for p in drawn:
            paragraph += 1
            for x in p:
                n += 1
                parts_of = {_local(y.tag): y for y in reversed(x)} if _local(x.tag) == "r" else None
                if parts_of is None:
                    yield path, name, n, paragraph, "", "", 0, False, True
                elif "t" in parts_of:
                    own = parts_of.get("rPr")
                    yield path, name, n, paragraph, "" if own is None else ET.canonicalize(ET.tostring(own, encoding="unicode"), strip_text=True, rewrite_prefixes=True), parts_of["t"].text or "", 0, True, False

    keep = F.col("name").rlike(r"^(word/(document|header\d*|footer\d*|footnotes|endnotes)|ppt/(slides|notesSlides)/[^/]+)\.xml$") & ~F.contains("name", F.lit("/embeddings/"))
    rows = _xml_rows(parts, "path string, part string, n int, paragraph int, signature string, text string, field int, is_text boolean, edge boolean", marks, keep)
    order = Window.partitionBy("path", "part").orderBy("n")  # a part is read by one task, so its marks fit one
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum("field").over(upto)
    rows = rows.withColumn("sum", depth).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    before = Window.partitionBy("path", "part", "paragraph").orderBy("n")
    new = F.coalesce(F.col("edge") | F.lag("edge").over(before) | (F.lag("signature").over(before) != F.col("signature")), F.lit(True))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("is_text") & (F.col("signature").isNotNull() | (F.col("depth") == 0)))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), "")
    groups = rows.groupBy("path", "part", "paragraph", "island").agg(own.alias("source"), F.count("*").alias("n_runs")).filter(F.col("source").rlike(r"\p{L}"))
    return groups.select("path", "part", F.concat(F.lit("p:"), "paragraph", F.lit("/g:"), "island").alias("location"), "n_runs", "source")


def sheet_titles(parts: DataFrame) -> DataFrame:
    """[A21] path, part, location, category, source: sheet names as segments, in order."""

    def read(path, name, root):
        for k, x in enumerate(x for x in root.iter() if _local(x.tag) == "sheet"):
            yield path, name, f"sheet:{k}", "sheet_title", x.get("name", "")

    return _xml_rows(parts, "path string, part string, location string, category string, source string", read, F.col("name") == "xl/workbook.xml").filter(F.col("source").rlike(r"\p{L}"))


# The namespace of drawings, and elements whose text is a formula.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
FORMULAS = ("f", "formula", "formula1", "formula2", "definedName", "calculatedColumnFormula", "totalsRowFormula")


def renamed(parts: DataFrame, names: DataFrame) -> DataFrame:
    """[I22] path, name, raw of the workbook parts that change when sheets are renamed by names(path, old, new): titles, formulas, pivot sources and links."""
    own = names.groupBy("path").agg(F.collect_list(F.struct("old", "new")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, raw, pairs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                table = {x["old"]: x["new"] for x in pairs}
                folded = {k.casefold(): v for k, v in table.items()}
                try:
                    root = ET.fromstring(raw)
                except ET.ParseError:
                    continue
                changed = False

                def put(x, key, value):
                    nonlocal changed
                    if value != x.get(key):
                        changed = True
                        x.set(key, value)

                for x in root.iter():
                    tag = _local(x.tag)
                    if tag == "sheet" and x.get("name") in table:
                        put(x, "name", table[x.get("name")])
                    elif tag in FORMULAS and x.text and (text := requalified(x.text, folded)) != x.text:
                        x.text, changed = text, True
                    elif tag == "worksheetSource" and x.get("sheet") in table:
                        put(x, "sheet", table[x.get("sheet")])
                    elif tag == "hyperlink" and x.get("location"):
                        put(x, "location", requalified(x.get("location"), folded))
                if changed:
                    rows.append({"path": path, "name": name, "raw": ET.tostring(root, encoding="UTF-8", xml_declaration=True)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("raw", pa.binary())]))

    mine = parts.filter(F.col("name").startswith("xl/") & F.col("name").endswith(".xml") & ~F.contains("name", F.lit("/embeddings/")) & F.col("raw").isNotNull())
    return mine.join(own, "path").select("path", "name", "raw", "names").mapInArrow(run, "path string, name string, raw binary")


def _canonical(name: str, raw: bytes) -> bytes:
    """Canonical XML of an XML part with its text nodes blanked; the bytes of another."""
    if name.endswith(".xml"):
        try:
            root = ET.fromstring(raw)
            for x in root.iter():
                if _local(x.tag) == "t":
                    x.text = ""
            return ET.canonicalize(ET.tostring(root, encoding="unicode"), rewrite_prefixes=True).encode()  # prefixes are names that writers choose
        except ET.ParseError:
            pass
    return raw


def canonical(parts: DataFrame) -> DataFrame:
    """[M14] path, name, c14n: hash of the canonical XML of each XML part with its text nodes blanked; of the bytes for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": path, "name": name, "c14n": hashlib.sha256(_canonical(name, raw)).hexdigest()} for path, name, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("name", pa.string()), ("c14n", pa.string())]))

    return parts.filter("raw is not null").select("path", "name", "raw").mapInArrow(run, "path string, name string, c14n string")


def structure_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """[D13, M14] path, name, change between two sets of canonical parts."""
    a, b = before.withColumnRenamed("c14n", "a"), after.withColumnRenamed("c14n", "b")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["path", "name"], "full").select("path", "name", change.alias("change")).filter("change is not null")


def _rebuilt(content: bytes, fresh: dict[str, bytes], opened: list[tuple[_Entry | zipfile.ZipInfo, bytes | None]] | None = None) -> bytes:
    """A package with the members in fresh replaced; order, comment and the rest are kept. Plain members are written byte by byte as zipfile does, but sooner."""
    opened = _opened(content) if opened is None else opened
    if not all(isinstance(i, _Entry) for i, _ in opened):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
            b.comment = a.comment
            for i in a.infolist():
                b.writestr(i, fresh[i.filename] if i.filename in fresh else a.read(i))
        return out.getvalue()
    out, directory, at = [], [], 0
    for i, raw in opened:
        raw, named = fresh.get(i.filename, raw), i.filename.encode()
        _, made, system, version, reserved, _, method, time, date, *_, inside, outside, _ = i.fields
        packed = raw
        if method == zipfile.ZIP_DEFLATED:
            press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
            packed = press.compress(raw) + press.flush()
        entry = struct.pack("<BBHHHHLLLHH", version, reserved, 0, method, time, date, zlib.crc32(raw), len(packed), len(raw), len(named), 0)
        out += (b"PK\3\4", entry, named, packed)
        directory.append(struct.pack("<4sBB", b"PK\1\2", made, system) + entry + struct.pack("<HHHLL", 0, 0, inside, outside or 0o600 << 16, at) + named)
        at += 30 + len(named) + len(packed)
    end = b"".join(directory)
    return b"".join([*out, end, _END.pack(b"PK\5\6", 0, 0, len(opened), len(opened), len(end), at, 0)])


def rebuild(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """[B1] files(path, content) with the members of replacements(path, name, raw) replaced; order, comment and the rest are kept."""
    parts = replacements.groupBy("path").agg(F.collect_list(F.struct("name", "raw")).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": path, "content": _rebuilt(content, {x["name"]: x["raw"] for x in new or []})} for path, content, new in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.select("path", "content").join(parts, "path", "left").mapInArrow(run, "path string, content binary")
