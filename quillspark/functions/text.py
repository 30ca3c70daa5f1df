"""Column functions on text: addresses, numbers, links, placeholders, page rules. Ids in brackets are SURVEY section 2's."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
URL = r"https?://[^\s<>]+"
PLACEHOLDER = r"(?i)\[(?:omitted|continues?|translation error)[^\]]*\]"
CJK_UNITS = "万|萬|亿|億|千|百|年|月|日|時|时|년|월|일|시|만|억|천|백"
WORD_UNITS = (
    "million|billion|thousand|hundred|january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec|once|twice|one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|am|pm"
)
SEPARATED = r"\p{Nd}[.,:/-]\p{Nd}"
TRUNCATED = (
    r"(?i)\[(?:text\s+)?continues?\]",
    r"(?i)\[(?:rest\s+of\s+)?(?:page|section|article)?\s*omitted\]",
    r"(?i)\[sentence\s+continues\]",
    r"(?i)\b(?:TODO|FIXME)\b",
)
CJK_RUN = "[\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff]{10,}"
LANGUAGES = {
    "japanese": "ja", "korean": "ko", "english": "en", "chinese (simplified)": "zh-CN", "chinese (traditional)": "zh-TW",
    "simplified chinese": "zh-CN", "traditional chinese": "zh-TW", "spanish": "es", "french": "fr", "german": "de", "italian": "it",
    "portuguese": "pt", "russian": "ru", "vietnamese": "vi", "thai": "th", "indonesian": "id", "arabic": "ar", "hindi": "hi",
}
FREE_PROVIDERS = ("google-translate", "google translate", "google translate (free)")
TRANSIENT_CODES = (408, 500, 502, 503, 504)
BODY_LIMITS = {"/jobs/batches": 260 << 20, "/translate/document": 66 << 20, "/translate/document/stream": 66 << 20, "/translate/text": 512 << 10}
OTHER_BODY_LIMIT = 2 << 20
TOC_TITLE = r"(?i)^(?:#+\s*)?(?:Table\s+of\s+Contents|Contents|目次|목차|目录|Sommaire|Inhalt|Indice|Tabla\s+de\s+contenidos)\b"
TOC_LEADER = r"[·.\s]{2,}\s*\p{Nd}+$"
TOC_ENTRY = r"(?i)^(?:#+\s*)?(?:Chapter|Section|Article|Part|Chapitre|Kapitel|Capítulo|Capitolo|Appended|Supplementary|第\s*\p{Nd}+\s*[章節条部]|제\s*\p{Nd}+\s*[장절조])\b"
FENCE = r"^\s*```"
STAMP = r"(?i)\[(?:Stamp|Seal|Approved):\s*([\s\S]*?)\]"
NOT_ON_COVERS = (
    r"(?i)<(?:table|ul|ol)\b",
    r"(?i)\b(?:Chapter|Article|Section|\p{Nd}+[A-Za-z]?(?:\.\p{Nd}+)+)\b",
    r"(?m)^\s*#{2,}",
    r"(?m)^\s*(?:[①-⑳]|\(\p{Nd}+\)|\p{Nd}+[.)、]|\p{Nd}+\s+\S)",
    r"\|.*\|",
)
HEADLESS = r"(?m)^(?:Article|Section|Chapter)\s+\p{Nd}+(?:\.\p{Nd}+)*\s*$"
PAIR_ON_LINE = r"[^\n:]{3,35}:\s*[^\n:]{2,30}"
BULLET_PAIR = r"(?m)^[•*\-▪]\s+[^:\n]{5,30}:\s+[^\n]{4,}"
DIVISION = r"(?i)\b(?:Chapter|Section|Article|Part)\s+\p{Nd}+"
LATEX = r"\\frac\{|\$\$"
TREE = "──|┬|│|└──|├──"
CHAPTER = r"(?i)^(?:Chapter\s+\p{Nd}+|第\s*\p{Nd}+\s*章|Appended\s+Table|Supplementary\s+Provisions)\b"
SECTION = r"(?i)^(?:Section\s+\p{Nd}+|第\s*\p{Nd}+\s*節)\b"
ARTICLE = r"(?i)^(?:Article\s+\p{Nd}+|第\s*\p{Nd}+\s*条)\b"
CLAUSE, ITEM, COUNTED, SUBITEM = r"^\p{Nd}+[A-Za-z]?(?:\.\p{Nd}+)+\s+", r"^\p{Nd}+[.)、]\s*.", r"^\p{Nd}+\s+\S", r"^([①-⑳]|\(\p{Nd}+\))"
BULLET = r"^[•*\-▪▫○·]\s+"
NEW_BLOCK = r"(?i)^(?:\p{Nd}+[A-Za-z]?(?:\.\p{Nd}+)+|\p{Nd}+[.)、]|\p{Nd}+\s+\S|Article|Chapter|Section|[①-⑳]|\(\p{Nd}+\)|[•*\-▪▫○·]|\||#+)"
KEY_VALUE = r"^[^\n:]{2,50}\s*:\s*[^\n]+$"


def strip(text: Column) -> Column:
    """Removes Unicode white space from both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def stable_id(part: Column, location: Column) -> Column:
    """[I1] 24 hex digits that address a segment inside its document."""
    return F.substring(F.sha2(F.concat(part, F.lit("\0"), location), 256), 1, 24)


@cache
def _number_forms() -> dict[str, str]:
    """Characters whose compatibility form (NFKC) has a digit, a full stop or a comma, and that form: all that normalising can change in numeric tokens."""
    forms = ((chr(k), unicodedata.normalize("NFKC", chr(k))) for k in range(0x80, 0x110000) if not 0xD800 <= k < 0xE000)
    return {c: f for c, f in forms if c != f and any(x in ".," or unicodedata.category(x) == "Nd" for x in f)}


@cache
def _number_gate() -> str:
    """A class of few ranges with all characters of _number_forms, and some between them that are far from Latin letters."""
    ranges: list[list[int]] = []
    for k in sorted(map(ord, _number_forms())):
        if ranges and k - ranges[-1][1] <= 0x200 and (k < 0xC0 or ranges[-1][0] > 0x2000):
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


def number_form(text: Column) -> Column:
    """[I2] text with the digits, full stops and commas of its NFKC form; without Python, and untouched where it is ASCII."""
    one = {c: f for c, f in _number_forms().items() if len(f) == 1}
    more = {c: f for c, f in _number_forms().items() if len(f) > 1}
    simple = F.translate(text, "".join(one), "".join(one.values()))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in more.items()])
    # A table is looked up once for each character; a pattern of so many characters would be tried one by one.
    full = F.when(simple != F.translate(simple, "".join(more), ""), F.aggregate(pairs, simple, lambda t, p: F.replace(t, p["c"], p["f"]))).otherwise(simple)
    return F.when((F.octet_length(text) != F.length(text)) & text.rlike(_number_gate()), full).otherwise(text)


def numbers(text: Column) -> Column:
    """[E10] Multiset of numeric tokens of the NFKC form as a sorted array."""
    return F.sort_array(F.regexp_extract_all(number_form(text), F.lit(NUMBER), F.lit(0)))


def numbers_differ(source: Column, candidate: Column) -> Column:
    """[I3]"""
    return numbers(source) != numbers(candidate)


def conversion_candidate(source: Column, candidate: Column) -> Column:
    """[I4] Whether a numeric difference may be a localisation of the same quantity. Both in NFKC form."""
    both = F.lower(F.concat(source, F.lit("\n"), candidate))
    count = lambda t: F.regexp_count(t, F.lit(NUMBER))
    return (count(source) != count(candidate)) | both.rlike(CJK_UNITS) | both.rlike(rf"(?U)\b(?:{WORD_UNITS})\b") | both.rlike(SEPARATED)


def lost_urls(source: Column, candidate: Column) -> Column:
    """[I5] Links of the source that the candidate lacks, one for each occurrence."""
    return F.filter(F.regexp_extract_all(source, F.lit(URL), F.lit(0)), lambda u: ~F.contains(candidate, u))


def has_placeholder(candidate: Column) -> Column:
    """[I6]"""
    return candidate.rlike(PLACEHOLDER)


def is_number(text: Column) -> Column:
    """[C7] A plain decimal number once commas are gone."""
    return F.replace(text, F.lit(","), F.lit("")).rlike(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")


def is_free_provider(name: Column) -> Column:
    """[C8]"""
    return F.lower(strip(name)).isin(*FREE_PROVIDERS)


def is_transient(code: Column, interrupted: Column) -> Column:
    """[C9]"""
    return ~interrupted & code.isin(*TRANSIENT_CODES)


def language_code(name: Column) -> Column:
    """[I24] Code of a language name, or the name itself."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(name))), strip(name))


def body_limit(path: Column) -> Column:
    """[I27]"""
    table = F.create_map(*[x for k, v in BODY_LIMITS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.coalesce(F.try_element_at(table, path), F.lit(OTHER_BODY_LIMIT).cast("long"))


def retry_delay(message: Column, retry_after: Column, attempt: Column, now: Column | None = None, details: Column | None = None) -> Column:
    """[I26] Seconds before the next attempt of a rate-limited call; null if it wasn't rate-limited.

    In order: the header (seconds, or an HTTP date seen from now), the first retryDelay of the JSON details, the message, doubling.
    """
    low = F.lower(message)
    limited = F.contains(low, F.lit("429")) | F.contains(low, F.lit("resource_exhausted")) | F.contains(low, F.lit("resourceexhausted")) | F.contains(low, F.lit("rate limit"))
    named = F.regexp_extract(message, r"(?i)(?:retry[ _-]?(?:after|delay)|retry in)[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)\s*s", 1)
    backoff = F.least(F.lit(300.0), F.lit(15.0) * F.pow(F.lit(2.0), F.least(attempt, F.lit(5))))
    one = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(1.0), x))
    ways = [one(retry_after.try_cast("double"))]
    if now is not None:
        day = F.regexp_extract(retry_after, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
        at = F.try_to_timestamp(F.concat(day, F.lit(" Z")), F.lit("d MMM yyyy HH:mm:ss X"))
        ways.append(one((F.unix_seconds(at) - F.unix_seconds(now.cast("timestamp"))).cast("double")))
    if details is not None:
        given = F.transform(F.from_json(details, "array<struct<retryDelay:string>>"), lambda d: F.regexp_extract(d["retryDelay"], r"^([0-9]+(?:\.[0-9]+)?)s$", 1).try_cast("double"))
        ways.append(one(F.get(F.filter(given, lambda x: x.isNotNull()), F.lit(0))))
    return F.when(limited, F.coalesce(*ways, one(named.try_cast("double")), backoff))


def transient_delay(attempt: Column) -> Column:
    """[I26] Seconds before the next attempt after a transient failure."""
    return F.least(F.lit(30.0), F.pow(F.lit(2.0), attempt + 1))


def safe_name(path: Column) -> Column:
    """[I28] The last part of a path with either kind of slash."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)


def unfenced(text: Column) -> Column:
    """[I29] JSON without the code fence around it."""
    return F.regexp_replace(strip(text), r"^```(?:json)?\s*|\s*```$", "")


def model_id(name: Column, default: str, prefix: str) -> Column:
    """[I23] Canonical model id of a display name."""
    s = strip(name)
    s = F.when(F.lower(s).startswith("models/"), F.substr(s, F.lit(8))).otherwise(s)
    kebab = F.regexp_replace(F.regexp_replace(F.lower(s), r"\s+", "-"), r"[^a-z0-9.-]", "")
    full = F.when(kebab.startswith(prefix), kebab).otherwise(F.concat(F.lit(prefix), kebab))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(default)).when(s.rlike(f"^{prefix}[a-z0-9.-]+$"), s).otherwise(full)


def sanitized(text: Column) -> Column:
    """[I13] NUL becomes a bullet, other controls but newline, return and tab a space."""
    return F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("• ")), r"[\x01-\x08\x0B\x0C\x0E-\x1F]", " ")


def soft_breaks(text: Column) -> Column:
    """[A22]"""
    return F.replace(F.replace(text, F.lit("_x000B_"), F.lit(" ")), F.lit("\x0b"), F.lit(" "))


def edges_of(source: Column, value: Column) -> Column:
    """[B4] value with the white space around source."""
    return F.concat(F.regexp_extract(source, r"(?U)^(\s*)", 1), strip(value), F.when(blank(source), F.lit("")).otherwise(F.regexp_extract(source, r"(?U)(\s*)$", 1)))


def formula_guard(source: Column, value: Column) -> Column:
    """[B6] Whether a cell became a spreadsheet expression."""
    starts = lambda x: F.regexp_replace(x, r"(?U)^\s+", "").rlike(r"^[=+@-]")
    return starts(value) & ~starts(source)


def markdown_escaped(value: Column) -> Column:
    """[B7]"""
    return F.regexp_replace(F.regexp_replace(value, r"\s*\r?\n\s*", " "), r"([\\`*_{}\[\]()#+.!|>~\-])", r"\\$1")


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def full_lines(text: Column) -> Column:
    """Stripped lines with content."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def is_toc(text: Column) -> Column:
    """[E15] A contents page: its title in the first three lines, or four entries that are over 35 % of the lines."""
    own = F.filter(full_lines(text), lambda x: ~x.rlike(FENCE))
    entries = F.size(F.filter(own, lambda x: x.rlike(TOC_LEADER) | x.rlike(TOC_ENTRY)))
    return (F.size(own) > 0) & (F.exists(F.slice(own, 1, 3), lambda x: x.rlike(TOC_TITLE)) | ((entries >= 4) & (entries / F.greatest(F.size(own), F.lit(1)) > 0.35)))


def is_cover(text: Column) -> Column:
    """[I18] A short page without divisions, lists or tables."""
    clean = strip(F.regexp_replace(text, STAMP, ""))
    out = F.size(full_lines(clean)).between(1, 6) & (F.length(clean) < 350)
    for pattern in NOT_ON_COVERS:
        out = out & ~clean.rlike(pattern)
    return out


def _messages(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in tests]))


def draft_defects(draft: Column, english: Column) -> Column:
    """[I7] Codes of the page-draft rules that fail, in order; of the truncation patterns only the first counts."""
    none = F.coalesce(draft, F.lit("")) == ""
    truncated = F.lit(False)
    for pattern in TRUNCATED:
        truncated = truncated | draft.rlike(pattern)
    headless = draft.rlike(HEADLESS) & (F.size(lines(draft)) < 4)
    return _messages(
        (none | blank(draft), "empty"),
        (~blank(draft) & draft.startswith("*[Translation Error:"), "engine_error"),
        (truncated, "truncated"),
        (english & draft.rlike(CJK_RUN), "untranslated"),
        (headless, "missing_body"),
    )


def layout_defects(draft: Column, toc: Column, nested: Column, tiers: Column, columns: Column) -> Column:
    """[I8, E14] Codes of the page-layout rules that fail, in order."""
    own = full_lines(draft)
    pipes = F.filter(own, lambda x: x.startswith("|"))
    bars = F.transform(pipes, lambda x: F.regexp_count(x, F.lit(r"\|")))
    table = draft.rlike(r"(?i)<table\b")
    pairs = F.exists(own, lambda x: ~x.rlike(r"^(\||<tr|<table|<td)") & (F.regexp_count(x, F.lit(PAIR_ON_LINE)) >= 2))
    two = F.regexp_count(draft, F.lit(BULLET_PAIR)) >= 3
    return _messages(
        (toc & F.exists(own, lambda x: F.regexp_count(x, F.lit(DIVISION)) >= 2), "toc_concatenated"),
        (toc & draft.rlike(r"(?m)^\s*\|.*\|.*\|"), "toc_table"),
        (nested & ~toc & ~draft.rlike(r"(?m)^[ \t]*[•*\-▪]\s+"), "nested_lists"),
        (draft.rlike(LATEX), "latex"),
        (tiers & (F.size(pipes) > 0) & ~table, "multi_tier_headers"),
        (columns & ~table & ~draft.rlike(r"\|.*\|") & two, "two_column_lists"),
        ((F.size(pipes) > 0) & (F.array_max(bars) - F.array_min(bars) > 3), "ragged_table"),
        (pairs, "squashed_pairs"),
    )


def block_type(line: Column) -> Column:
    """[I14] Kind of one line of a page; rules in order, the first that fits counts."""
    s = strip(line)
    indent = F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))
    return (
        F.when(s == "", "blank")
        .when(s.rlike(FENCE), "fence")
        .when(s.rlike(r"(?i)<table\b") | s.startswith("<svg") | s.startswith('<div class="doc-svg-table"'), "markup")
        .when(s.startswith("|") | ((F.regexp_count(s, F.lit(r"\|")) >= 2) & ~s.rlike(r"^(#|Article|Chapter|Section)")), "table")
        .when(s.rlike(TREE), "tree")
        .when(s.rlike(r"^#{1,6}"), F.concat(F.lit("heading_"), F.length(F.regexp_extract(s, r"^(#{1,6})", 1)).cast("string")))
        .when(s.rlike(CHAPTER), "chapter")
        .when(s.rlike(SECTION), "section")
        .when(s.rlike(ARTICLE), "article")
        .when(s.rlike(CLAUSE), "clause")
        .when(s.rlike(ITEM), "item")
        .when(s.rlike(BULLET), F.when(indent >= 2, "sub_bullet").otherwise("bullet"))
        .when(s.rlike(SUBITEM), "subitem")
        .when(s.rlike(COUNTED), "item")
        .when(indent >= 2, "subitem_desc")
        .otherwise("paragraph")
    )


def continues(line: Column, following: Column) -> Column:
    """[F8] Whether the following line is prose that goes on from line."""
    c, n = strip(line), strip(following)
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    stop = n.rlike(NEW_BLOCK)
    barred = c.endswith(":") | line.endswith("  ") | F.contains(F.lower(line), F.lit("<br>")) | line.endswith("\\") | ((indent(following) >= 2) & (indent(following) > indent(line)))
    other = n.rlike(KEY_VALUE) | following.rlike(TREE) | following.rlike(FENCE) | following.rlike(r"(?i)<table\b")
    return F.coalesce(~blank(following) & ~barred & ~stop & ~other, F.lit(False))
