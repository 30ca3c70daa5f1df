"""Suffix-array deduplication (op 4): bytes covered by a 100-byte string that also starts earlier go.

The method is the difference-cover suffix sort: sort the triples at positions 1 and 2 modulo 3, recurse on
their names until they are unique, sort the remaining suffixes by (symbol, rank of the next), merge by the
two comparison keys, then compare the prefixes of neighbours. It is distributed by content: only suffixes
with equal 100-byte prefixes matter, and those have the same anchor (see windows.py), so that every anchor's
strings are sorted in one place, and different anchors in different tasks. Sorting the suffixes of all text
in one global array would shuffle every byte of the corpus about thirty times as rows; the anchors keep text
without repeats out of the sort altogether.

Defined results: null text is empty; texts under the width give up nothing; a null doc_id counts as the
largest; rows with equal doc_id and different text are ordered by a hash of the text; identical rows with
equal doc_id count as one document, and so have the same result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import ship_package
from quillspark.llm.windows import LAST, Units, removed_units

WIDTH = 100


def _bits(x: np.ndarray) -> int:
    return max(1, int(x.max()).bit_length()) if len(x) else 1


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One uint64 for each row that orders as the columns do; columns are made dense where 64 bits don't hold them."""
    out = columns[0]
    for x in columns[1:]:
        if _bits(out) + _bits(x) > 63:
            out, x = _dense(out), _dense(x)
        out = (out << _bits(x)) | x
    return out.astype(np.uint64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by difference cover modulo 3; a suffix that ends sorts first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, dtype=np.int64)])
    # With n = 1 modulo 3 the empty suffix joins the sample, so that the first half of the names ends in a lower one.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    key = _key([t[sample], t[sample + 1], t[sample + 2]])
    order = np.argsort(key)
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    if new.all():
        ranked = sample[order]
    else:
        names = np.empty(len(order), dtype=np.int64)
        names[order] = np.cumsum(new)
        ranked = sample[suffix_array(names)]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_key([t[zeros], rank[zeros + 1]]))]
    ranked = ranked[ranked < n]
    by_one, by_two = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]

    def place(other: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, its = keys[: len(zeros)], keys[len(zeros) :]
        return np.searchsorted(its, mine), np.searchsorted(mine, its)

    both = np.concatenate([zeros, by_one])
    ones_below, zeros_below_one = place(by_one, _key([t[both], rank[both + 1]]))
    both = np.concatenate([zeros, by_two])
    twos_below, zeros_below_two = place(by_two, _key([t[both], t[both + 1], rank[both + 2]]))
    out = np.empty(n, dtype=np.int64)
    out[np.arange(len(zeros)) + ones_below + twos_below] = zeros
    at = np.arange(len(ranked))
    before = np.empty(len(ranked), dtype=np.int64)
    before[ranked % 3 == 1], before[ranked % 3 == 2] = zeros_below_one, zeros_below_two
    out[at + before] = ranked
    return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether data[a:a+width] == data[b:b+width], eight bytes at a time; pairs that differ drop out early."""
    step = min(8, width)
    wide = np.zeros(len(data) - step + 1, dtype=np.uint64)
    for k in range(step):
        wide = (wide << np.uint64(8)) | data[k : len(data) - step + 1 + k].astype(np.uint64)
    alive = np.arange(len(a))
    for k in [*range(0, width - step + 1, step), width - step]:
        alive = alive[wide[a[alive] + k] == wide[b[alive] + k]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def decide(units: Units, data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray):
    """Windows of the packed strings that also start at an earlier place among them."""
    starts = tk.within(offsets, units.width)
    is_start = np.zeros(len(data) + 1, dtype=bool)
    is_start[starts] = True
    order = suffix_array(data)
    order = order[is_start[order]]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ~same_prefix(data, order[:-1], order[1:], units.width)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(order)]]))
    many = np.repeat(size > 1, size)
    at, group = order[many], np.cumsum(new)[many]
    row = np.searchsorted(offsets, at, side="right") - 1
    begin = start[row] + at - offsets[row]
    by = np.lexsort((begin, tie[row], doc[row], group))
    at, group, row, begin = at[by], group[by], row[by], begin[by]
    lead = np.ones(len(at), dtype=bool)
    lead[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(at) else np.zeros(0, dtype=np.int64)
    late = (doc[row] != doc[row[head]]) | (tie[row] != tie[row[head]]) | (begin != begin[head])
    at = np.sort(at[late])
    return at, np.searchsorted(offsets, at, side="right") - 1


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, tie, spans: byte intervals that each document must give up."""
    ship_package(docs.sparkSession)
    gram = max(4, width // 4)
    return removed_units(docs, Units(False, width, min(gram, width)), decide, "suffix")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the spans of each row (null if it has none)."""
    mine = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"))
    return mine.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (begin, end in bytes, maximal)."""

    @tk.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            kept, total, gone, runs = [], [], [], []
            for text, flat in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = tk.union(zip(flat[0::2], flat[1::2], strict=True)) if flat else []
                out, at = [], 0
                for a, b in spans:
                    out.append(raw[at:a])
                    at = b
                kept.append(b"".join([*out, raw[at:]]))
                total.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                runs.append([x for s in spans for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return with_spans(docs, repeated_spans(docs, width)).mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<long>")


def digest(docs: DataFrame) -> DataFrame:
    done = deduplicate(docs)
    return done.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
