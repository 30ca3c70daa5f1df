"""License scans (op 1): ordered signature rules with a keyword prefilter.

A rule is a label, a priority, a confidence, keywords and a regex. One Aho-Corasick pass over the lower-cased text finds
the keywords; only rules with a keyword that occurs are run, so each alternative of a regex must hold one of them. Where detections overlap, the one with the higher
priority stays, then the longer one; a detection inside a kept one of the same or a higher priority is suppressed.

Beside the rules stand three base phrases, found as consecutive words; their labels always stay.

Defined results: null text is empty; a text without detections has empty labels and score 0; repeated rows are returned as often as
they come; further columns (of any name) are ignored; an empty table gives an empty one. A text of 20 MB takes about 0.5 GB in its
worker (textkit.py). The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm import textkit as tk
from quillspark.llm.license_texts import TEXTS
from quillspark.llm.shared import ship_package

BASE = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved"))


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str  # or several, with bars between
    pattern: str


#: label, SPDX identifiers, keyword, name pattern (lower case; a space stands for any run of white space, ' ?' also for none).
FAMILIES = (
    ("apache-2.0", "apache-2.0", "apache", r"apache licen[cs]e(?:,? (?:version|v\.?) ?| )2(?:\.0)?(?!\d)"),
    ("apache-1.1", "apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?:,? (?:version|v\.?) ?| )1\.1"),
    ("apache-1.0", "apache-1.0", "apache", r"apache (?:software )?licen[cs]e(?:,? (?:version|v\.?) ?| )1\.0"),
    ("mit", "mit", "mit", r"\bmit licen[cs]e\b"),
    ("mit-0", "mit-0", "attribution", r"\bmit no attribution\b"),
    ("x11", "x11", "x11", r"\bx11 licen[cs]e\b"),
    ("isc", "isc", "isc", r"\bisc licen[cs]e\b"),
    ("bsd-2-clause", r"bsd-2-clause", "bsd", r"(?:simplified bsd|bsd[ -]2[ -]clause|2[ -]clause bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", r"bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd[ -]3[ -]clause|3[ -]clause bsd) licen[cs]e"),
    ("bsd-4-clause", r"bsd-4-clause", "bsd", r"(?:original bsd|bsd[ -]4[ -]clause|4[ -]clause bsd) licen[cs]e"),
    ("0bsd", "0bsd", "bsd", r"(?:zero[ -]clause bsd|bsd zero[ -]clause) licen[cs]e"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public licen[cs]e(?:,? (?:version|v\.?) ?| )1(?:\.0)?\b"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public licen[cs]e(?:,? (?:version|v\.?) ?| )2(?:\.0)?\b"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", "general public", r"(?:gnu )?general public licen[cs]e(?:,? (?:version|v\.?) ?| )3(?:\.0)?\b"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "general public", r"library general public licen[cs]e(?:,? (?:version|v\.?) ?| )2(?:\.0)?\b"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "general public", r"lesser general public licen[cs]e(?:,? (?:version|v\.?) ?| )2\.1\b"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", "general public", r"lesser general public licen[cs]e(?:,? (?:version|v\.?) ?| )3(?:\.0)?\b"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", "general public", r"affero general public licen[cs]e(?:,? (?:version|v\.?) ?| )3(?:\.0)?\b"),
    ("agpl-1.0", r"agpl-1\.0(?:-only|-or-later)?", "general public", r"affero general public licen[cs]e(?:,? (?:version|v\.?) ?| )1(?:\.0)?\b"),
    ("gfdl-1.1", r"gfdl-1\.1(?:-only|-or-later)?", "documentation", r"free documentation licen[cs]e(?:,? (?:version|v\.?) ?| )1\.1\b"),
    ("gfdl-1.2", r"gfdl-1\.2(?:-only|-or-later)?", "documentation", r"free documentation licen[cs]e(?:,? (?:version|v\.?) ?| )1\.2\b"),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", "documentation", r"free documentation licen[cs]e(?:,? (?:version|v\.?) ?| )1\.3\b"),
    ("mpl-1.0", r"mpl-1\.0", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version|v\.?) ?| )1\.0"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version|v\.?) ?| )1\.1"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version|v\.?) ?| )2(?:\.0)?(?!\d)"),
    ("epl-1.0", r"epl-1\.0", "eclipse", r"eclipse public licen[cs]e(?:,? (?:- )?(?:version|v\.?) ?| (?:- )?)1(?:\.0)?(?!\d)"),
    ("epl-2.0", r"epl-2\.0", "eclipse", r"eclipse public licen[cs]e(?:,? (?:- )?(?:version|v\.?) ?| (?:- )?)2(?:\.0)?(?!\d)"),
    ("cddl-1.0", r"cddl-1\.0", "distribution", r"common development and distribution licen[cs]e(?:(?:,? (?:version|v\.?) ?| )1\.0)?"),
    ("cddl-1.1", r"cddl-1\.1", "distribution", r"common development and distribution licen[cs]e(?:,? (?:version|v\.?) ?| )1\.1"),
    ("cpl-1.0", r"cpl-1\.0", "common public", r"common public licen[cs]e(?:(?:,? (?:version|v\.?) ?| )1\.0)?"),
    ("epl-eu-1.1", r"eupl-1\.1", "european", r"european union public licen[cs]e(?:,? (?:version|v\.?) ?| )1\.1"),
    ("epl-eu-1.2", r"eupl-1\.2", "european", r"european union public licen[cs]e(?:,? (?:version|v\.?) ?| )1\.2"),
    ("artistic-1.0", r"artistic-1\.0", "artistic", r"artistic licen[cs]e,? (?:version|v\.?)? ?1\.0"),
    ("artistic-2.0", r"artistic-2\.0", "artistic", r"artistic licen[cs]e,? (?:version|v\.?)? ?2\.0"),
    ("bsl-1.0", r"bsl-1\.0", "boost", r"boost software licen[cs]e(?:(?:,? (?:version|v\.?) ?| )1\.0)?"),
    ("busl-1.1", r"busl-1\.1", "business source", r"business source licen[cs]e(?: 1\.1)?"),
    ("sspl-1.0", r"sspl-1\.0", "server side", r"server side public licen[cs]e"),
    ("elastic-2.0", r"elastic-2\.0", "elastic", r"elastic licen[cs]e(?: 2\.0)?"),
    ("zlib", "zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]e"),
    ("libpng", r"libpng(?:-2\.0)?", "libpng", r"\blibpng licen[cs]e"),
    ("openssl", "openssl", "openssl", r"\bopenssl licen[cs]e"),
    ("python-2.0", r"(?:python|psf)-2\.0", "python", r"python software foundation licen[cs]e"),
    ("php-3.01", r"php-3\.0?1?", "php", r"\bphp licen[cs]e"),
    ("ruby", "ruby", "ruby", r"\bruby licen[cs]e"),
    ("ofl-1.1", r"ofl-1\.[01]", "font", r"sil open font licen[cs]e"),
    ("unlicense", "unlicense", "unlicense", r"\bthe unlicense\b"),
    ("wtfpl", "wtfpl", "want to public", r"do what the f\S+ you want to public licen[cs]e"),
    ("cc0-1.0", r"cc0-1\.0", "cc0", r"\bcc0(?: 1\.0)?\b"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-\d\.\d", "cc|attribution", r"\bcc[ -]by[ -]nc[ -]sa(?: \d\.\d)?\b|attribution-noncommercial-sharealike"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-\d\.\d", "cc|attribution", r"\bcc[ -]by[ -]nc[ -]nd(?: \d\.\d)?\b|attribution-noncommercial-noderivatives"),
    ("cc-by-nc", r"cc-by-nc-\d\.\d", "cc|attribution", r"\bcc[ -]by[ -]nc(?: \d\.\d)?\b|attribution-noncommercial\b(?!-)"),
    ("cc-by-sa", r"cc-by-sa-\d\.\d", "cc|attribution", r"\bcc[ -]by[ -]sa(?: \d\.\d)?\b|attribution-sharealike"),
    ("cc-by-nd", r"cc-by-nd-\d\.\d", "cc|attribution", r"\bcc[ -]by[ -]nd(?: \d\.\d)?\b|attribution-noderiv"),
    ("cc-by", r"cc-by-\d\.\d", "cc|attribution", r"\bcc[ -]by(?: \d\.\d)?\b(?![ -](?:nc|sa|nd))|creative commons attribution(?: licen[cs]e)?\b(?!-)"),
    ("odbl-1.0", r"odbl-1\.0", "database", r"open (?:data commons open )?database licen[cs]e"),
    ("pddl-1.0", r"pddl-1\.0", "domain dedication", r"public domain dedication and licen[cs]e"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    ("afl-3.0", r"afl-[123]\.\d", "academic", r"academic free licen[cs]e"),
    ("osl-3.0", r"osl-[123]\.\d", "open software", r"open software licen[cs]e"),
    ("ms-pl", "ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("apsl-2.0", r"apsl-[12]\.\d", "apple", r"apple public source licen[cs]e"),
    ("mulan-2.0", r"mulanpsl-2\.0", "mulan", r"mulan p(?:ermissive|sl) ?(?:software )?licen[cs]e"),
    ("postgresql", "postgresql", "postgresql", r"\bpostgresql licen[cs]e"),
    ("upl-1.0", r"upl-1\.0", "universal permissive", r"universal permissive licen[cs]e"),
    ("blueoak-1.0", r"blueoak-1\.0\.0", "blue oak", r"blue oak model licen[cs]e"),
    ("openrail-m", r"(?:bigscience-)?openrail-m", "rail", r"\b(?:open)?rail(?:-m)? licen[cs]e"),
    ("llama", r"llama\d?", "llama", r"\bllama(?: \d)? community licen[cs]e"),
)

#: Rules that stand for no family, from texts and addresses.
SINGLE = (
    Rule("gpl", 20, 0.7, "general public", r"(?:gnu )?general public licen[cs]e"),
    Rule("lgpl", 21, 0.7, "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    Rule("agpl", 21, 0.7, "general public", r"(?:gnu )?affero general public licen[cs]e"),
    Rule("mit", 40, 0.95, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    Rule("bsd", 30, 0.8, "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    Rule("zlib", 40, 0.9, "as-is", r"this software is provided 'as-is', without any express or implied warranty"),
    Rule("unlicense", 40, 0.95, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    Rule("public-domain", 15, 0.6, "public domain", r"(?:released|placed|dedicated)(?: in)?(?:to)? the public domain"),
    Rule("reserved", 10, 0.6, "rights reserved", r"all rights reserved"),
    Rule("reserved", 10, 0.6, "droits", r"tous droits réservés"),
    Rule("reserved", 10, 0.6, "derechos", r"todos los derechos reservados"),
    Rule("reserved", 10, 0.6, "rechte", r"alle rechte vorbehalten"),
    Rule("copyright", 5, 0.4, "copyright", r"copyright (?:\(c\)|©)? ?\d{4}"),
    Rule("proprietary", 12, 0.6, "proprietary", r"proprietary and confidential"),
    Rule("apache-2.0", 50, 1.0, "apache.org", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0"),
    Rule("gpl", 45, 0.9, "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl[-.\w]*"),
    Rule("lgpl", 45, 0.9, "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl[-.\w]*"),
    Rule("agpl", 45, 0.9, "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/agpl[-.\w]*"),
    Rule("mit", 50, 1.0, "opensource.org", r"https?://(?:www\.)?opensource\.org/licen[cs]es?/mit\b"),
    Rule("bsd", 50, 1.0, "opensource.org", r"https?://(?:www\.)?opensource\.org/licen[cs]es?/bsd[-\w]*"),
    Rule("mpl-2.0", 50, 1.0, "mozilla.org", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0"),
    Rule("cc0-1.0", 50, 1.0, "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
    Rule("cc-by", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by/\d\.\d"),
    Rule("cc-by-sa", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by-sa/\d\.\d"),
    Rule("cc-by-nd", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by-nd/\d\.\d"),
    Rule("cc-by-nc", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by-nc/\d\.\d"),
    Rule("cc-by-nc-sa", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d"),
    Rule("cc-by-nc-nd", 50, 1.0, "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d"),
)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first: the texts and single ones, and for each family its tag, its grant and its name."""
    out = [*SINGLE, *(Rule(*x) for x in TEXTS)]
    for label, spdx, keyword, name in FAMILIES:
        out.append(Rule(label, 60, 1.0, "spdx", rf"spdx-licen[cs]e-identifier: (?:{spdx})(?![\w.-])"))
        out.append(Rule(label, 35, 0.9, keyword, rf"(?:licen[cs]ed|released|available|distributed|published|provided|covered) (?:to you )?(?:under|by)(?: the)?(?: terms of)?(?: the)?(?: gnu)? (?:{name})"))
        out.append(Rule(label, 25, 0.75, keyword, rf"(?:{name})"))
    return tuple(sorted(out, key=lambda r: -r.priority))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.patterns = [re.compile(r.pattern.replace(" ?", r"\s*").replace(" ", r"\s+"), re.S) for r in self.rules]
        self.gate = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for keyword in r.keyword.split("|"):
                by.setdefault(keyword.split(" ")[0], []).append(k)  # the first word: white space may vary
        for word, own in by.items():
            self.gate.add_word(word, own)
        self.gate.make_automaton()

    def detect(self, low: str) -> list[tuple[int, int, Rule]]:
        """Detections of a lower-cased text that stay: begin, end, rule."""
        own = {k for _, ks in self.gate.iter(low) for k in ks}
        found = [(m.start(), m.end(), self.rules[k]) for k in own for m in self.patterns[k].finditer(low)]
        return resolve(found)


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """By priority, length and place; what lies inside a kept interval goes.

    Kept intervals never contain one another, so both their ends ascend, and only the last one that begins at
    or before a new one can contain it.
    """
    from bisect import bisect_right, insort

    kept: list[tuple[int, int]] = []
    out = []
    for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        k = bisect_right(kept, (d[0], 1 << 62))
        if k and kept[k - 1][1] >= d[1]:
            continue
        # kept ones inside d have a higher priority and stay, but no longer matter as containers
        inside = [x for x in kept[k:] if x[1] <= d[1] and x[0] >= d[0]]
        for x in inside:
            kept.remove(x)
        insort(kept, d[:2])
        out.append(d)
    return sorted(out, key=lambda d: d[:2])


ASCII_LOWER = {k: k + 32 for k in range(0x41, 0x5B)}
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EDGE_L, _EDGE_R = r"(?<![0-9a-z\x80-\xff])", r"(?![0-9a-z\x80-\xff])"
BASE_PATTERNS = tuple((re.compile((_EDGE_L + _OTHER.join(words) + _EDGE_R).encode("latin-1")), label) for words, label in BASE)


@cache
def scanner() -> Scanner:
    return Scanner()


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,begin:long,end:long,priority:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, all labels, score, and detections (code points of the text)."""
    ship_package(docs.sparkSession)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = scanner()
        for batch in tk.pieces(batches):
            column = tk.texts(batch.column("text"))
            words = tk.Words(column, tk.ALNUM_WORD, lower=True)
            raw = words.data.tobytes()
            counts = words.counts
            places: dict[int, list[int]] = {}
            names: dict[int, set[str]] = {}
            for pattern, label in BASE_PATTERNS:
                at = np.array([m.start() for m in pattern.finditer(raw)], dtype=np.int64)
                if not len(at):
                    continue
                word = np.searchsorted(words.starts, at)
                row = np.searchsorted(words.offsets, word, side="right") - 1
                size = len(dict((b, a) for a, b in BASE)[label])
                for w, r in zip(word.tolist(), row.tolist(), strict=True):
                    if w + size <= words.offsets[r + 1]:  # the words of one text
                        places.setdefault(r, []).append(w - int(words.offsets[r]))
                        names.setdefault(r, set()).add(label)
            rows = []
            for r, text in enumerate(column.to_pylist()):
                found = look.detect(text.translate(ASCII_LOWER)) if text else []
                at, base = places.get(r, []), names.get(r, set())
                labels = base | {d[2].label for d in found}
                score = max([d[2].confidence for d in found] + [0.5] * bool(base), default=0.0)
                rows.append((int(counts[r]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": d[2].label, "begin": d[0], "end": d[1], "priority": d[2].priority} for d in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("detections")
