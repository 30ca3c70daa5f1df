"""Substring deduplication (op 7) on 50-word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hash of their word 8-grams) travel as one packed
string to the minimiser's bucket, where sorting the windows counts them exactly: they are numbered by their words, not told
apart by hashes. See windows.py for the way there and back, and for minimisers that hold very many different strings.

Defined results: null text has no words; texts under the width give up nothing; a null doc_id counts as the
largest; a window must start in a document with a strictly smaller doc_id, so repeats inside a document and
between rows with equal doc_id stay. Repeated rows are returned as often as they come, and further columns (of any name) are
ignored; an empty table gives an empty one. A text of 20 MB takes about 0.5 GB in its worker (textkit.py). The session's
Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import ship_package
from quillspark.llm.suffix_dedup import with_spans
from quillspark.llm.windows import Units, removed_units

WIDTH = 50


def decide(units: Units, names: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tie, start):
    """Windows of the packed strings that a smaller document holds too. Windows are numbered by their words, so equal numbers are equal windows."""
    at = tk.within(offsets, units.width)
    row = np.searchsorted(offsets, at, side="right") - 1
    if not len(at):
        return at, row
    window = tk.window_names(names, units.width)[at]
    least = np.full(int(window.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, window, doc[row])
    late = doc[row] > least[window]
    return at[late], row[late]


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, tie, spans: word intervals that each document must give up."""
    ship_package(docs.sparkSession)
    return removed_units(docs, Units(True, width, min(8, width)), decide, "substring")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, kept (words that stay, joined by one space), n_words, n_removed, spans (begin, end in words, maximal)."""

    @tk.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            words = tk.Words(tk.texts(batch.column("text")))
            data, starts, ends = words.joined()
            kept, gone, runs = [], [], []
            for flat, a, b in zip(batch.column("spans").to_pylist(), words.offsets[:-1], words.offsets[1:], strict=True):
                spans = tk.union(zip(flat[0::2], flat[1::2], strict=True)) if flat else []
                out, at = [], 0
                for x, y in [*spans, (b - a, b - a)]:
                    if x > at:
                        out.append(data[starts[a + at] : ends[a + x - 1]].tobytes())
                    at = y
                kept.append(b" ".join(out))
                gone.append(sum(y - x for x, y in spans))
                runs.append([v for s in spans for v in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int64()))], names=["doc_id", "kept", "n_words", "n_removed", "spans"])

    return with_spans(docs, repeated_spans(docs, width)).mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long, spans array<long>")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
