"""Repeated windows of fixed width, by content anchors; shared by byte-wise and word-wise deduplication.

A window's anchor is the least hash of the grams in it, so equal windows have equal anchors. Consecutive
windows that share an anchor travel as one packed string (a super-k-mer) to the anchor's bucket:

1. `anchors`: one row for each run of windows with an anchor, without the text; a partial aggregate finds the anchors
   that can hold a repeat.
2. `fragments`: the runs with such an anchor, packed. A size-checked Bloom filter drops the others before
   the text is packed. Beyond its bound the runs' places are joined with the anchors first, and only what is left is
   packed from the texts.
3. equal packed strings are combined map-side, so a thousand copies reach the bucket as one row.
4. anchors whose distinct strings take over HOT bytes are cut again by another hash, twice at most, and at last by the
   whole window, where a run is at most LAST_RUN equal windows. So every bucket is of bounded size, and all are decided alike.
5. `decide` sorts each bucket and returns the runs of windows that occur earlier elsewhere. It takes whole
   anchors, about CHUNK bytes at a time, and compares the units themselves, never hashes of them.
6. the decisions go back to all places that hold the string, as unit intervals for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bloom_has, bloom_of, materialise

LAST = (1 << 63) - 1
#: An anchor with more bytes of distinct packed strings than this isn't sorted in one task.
HOT = 1 << 21
#: Cuts of anchors by other hashes, before the cut by whole windows.
LEVELS = 2
#: Most windows in one run, and most equal windows in one where whole windows are anchors.
LONGEST_RUN, LAST_RUN = 1 << 14, 1 << 10
#: Packed bytes that a bucket task sorts at once; whole anchors, so it may be exceeded by HOT.
CHUNK = 1_500_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc: doc_id, null as the largest; tie: tells rows with equal doc_id apart by their text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie"), F.col("text"))


class Units:
    """How texts are cut into units. bytes: unit = byte, packed as it is; words: unit = word, packed with one space."""

    def __init__(self, words: bool, width: int, gram: int):
        self.words, self.width, self.gram = words, width, gram

    def parts(self, batches: Iterator[pa.RecordBatch], column: str = "text"):
        """Pieces of batches: rows, base (units before the piece's first in its row, if it is a slice of one), and the cut text:
        unit codes, n + 1 unit offsets, packed bytes, byte start of each unit, byte end of each unit."""
        for batch in tk.pieces(batches, column):
            text = batch.column(column).cast(pa.large_binary())
            if self.words:
                w = tk.Words(tk.texts(text.cast(pa.large_string())))
                data, starts, ends = w.joined()
                yield batch, 0, (w.hashes, w.offsets, data, starts, ends)
                continue
            data, off = tk.buffer(tk.pc.fill_null(text, b""))
            if batch.num_rows == 1 and len(data) > tk.PIECE:
                for base in range(0, len(data), tk.PIECE):
                    own = data[base : base + tk.PIECE + self.width - 1]
                    at = np.arange(len(own))
                    yield batch, base, (tk.BYTE_CODE[own], np.array([0, len(own)]), own, at, at + 1)
            else:
                at = np.arange(len(data))
                yield batch, 0, (tk.BYTE_CODE[data], off, data, at, at + 1)

    def runs(self, codes: np.ndarray, offsets: np.ndarray, level: int = 0):
        """Runs of windows of one row with equal anchor: anchor, first window, last window, row, occurrences of the anchor's gram."""
        starts = tk.within(offsets, self.width)
        if not len(starts):
            e = np.zeros(0, dtype=np.int64)
            return e.astype(tk.U), e, e, e, e
        if level > LEVELS:
            least, longest = tk.window_hashes(codes, self.width, tk.BASE_2)[starts], LAST_RUN
        else:
            grams, longest = tk.window_hashes(codes, self.gram, tk.BASE_2), LONGEST_RUN
            if level:
                grams = tk.mix(grams + tk.U(level))
            least = tk.window_min(grams, self.width - self.gram + 1)[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        if longest < len(starts):  # long runs are cut, each from its own start
            new |= (np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))) % longest == 0
            first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
        h, a, b = least[first], starts[first], starts[last]
        row = np.searchsorted(offsets, a, side="right") - 1
        if self.words or level:
            times = np.ones(len(h), dtype=np.int64)
        else:
            spread, off = tk.gather(grams, a, b + self.width - self.gram + 1)
            times = np.add.reduceat((spread == np.repeat(h, np.diff(off))).astype(np.int64), off[:-1])
        return h, a, b, row, times


PLACES = "h long, doc long, tie long, start long, windows long, times long"


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """The runs of all texts, without their strings: where each starts, and how many windows it has."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, (codes, offsets, *_) in units.parts(batches):
            h, a, b, row, times = units.runs(codes, offsets)
            doc, tie = (batch.column(k).to_numpy()[row] for k in ("doc", "tie"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), doc, tie, a - offsets[row] + base, b - a + 1, times)], names=["h", "doc", "tie", "start", "windows", "times"])

    return rows.mapInArrow(scan, PLACES)


FRAGMENT = "h long, packed binary, doc long, tie long, start long, units long"


def _packed(units: Units, data, starts, ends, h, first, windows, doc, tie, start) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(h), 20_000):
        s = slice(k, k + 20_000)
        strings = tk.binary_array(*tk.gather(data, starts[first[s]], ends[first[s] + windows[s] + units.width - 2]))
        yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), strings, *[pa.array(x[s]) for x in (doc, tie, start)], pa.array(windows[s] + units.width - 1)], names=["h", "packed", "doc", "tie", "start", "units"])


def fragments(rows: DataFrame, units: Units, bloom) -> DataFrame:
    """Packed runs with an anchor of the Bloom filter."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, (codes, offsets, data, starts, ends) in units.parts(batches):
            h, a, b, row, _ = units.runs(codes, offsets)
            keep = bloom_has(bloom.value, h)
            h, a, b, row = h[keep], a[keep], b[keep], row[keep]
            doc, tie = (batch.column(k).to_numpy()[row] for k in ("doc", "tie"))
            yield from _packed(units, data, starts, ends, h, a, b - a + 1, doc, tie, a - offsets[row] + base)

    return rows.mapInArrow(scan, FRAGMENT)


def fragments_of(rows: DataFrame, places: DataFrame, units: Units) -> DataFrame:
    """Packed runs at the given places: one row for each text with all of them, so that a text is packed from once."""
    own = places.groupBy("doc", "tie").agg(F.collect_set(F.struct("start", "h", "windows")).alias("runs"))

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            lists = batch.column("runs")
            flat, size = lists.flatten(), tk.pc.list_value_length(lists).to_numpy()
            start, h, windows = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(len(size)), size)
            if units.words:
                w = tk.Words(tk.texts(batch.column("text")))
                offsets, (data, starts, ends) = w.offsets, w.joined()
            else:
                data, offsets = tk.buffer(tk.texts(batch.column("text")))
                starts = np.arange(len(data))
                ends = starts + 1
            doc, tie = (batch.column(k).to_numpy()[row] for k in ("doc", "tie"))
            yield from _packed(units, data, starts, ends, h, offsets[row] + start, windows, doc, tie, start)

    return rows.dropDuplicates(["doc", "tie"]).join(own, ["doc", "tie"]).select("doc", "tie", "text", "runs").mapInArrow(scan, FRAGMENT)


def recut(found: DataFrame, units: Units, level: int) -> DataFrame:
    """Packed runs cut again by the anchors of another level."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, base, (codes, offsets, data, starts, ends) in units.parts(batches, "packed"):
            h, a, b, row, _ = units.runs(codes, offsets, level)
            doc, tie, start = (batch.column(k).to_numpy()[row] for k in ("doc", "tie", "start"))
            yield from _packed(units, data, starts, ends, tk.mix(h + tk.U(level)), a, b - a + 1, doc, tie, start + a - offsets[row] + base)

    return found.select("h", "packed", "doc", "tie", "start", "units").mapInArrow(scan, FRAGMENT)


def _packed_units(units: Units, column: pa.Array):
    """Names and n + 1 unit offsets of packed strings: equal names are equal units."""
    if units.words:
        w = tk.Words(column.cast(pa.large_binary()).cast(pa.large_string()))
        return w.names, w.offsets
    return tk.buffer(column.cast(pa.large_binary()))


def _string_id():
    return F.substring(F.unhex(F.sha2("packed", 256)), 1, 16)


def removed_units(docs: DataFrame, units: Units, decide: Callable, label: str) -> DataFrame:
    """Rows doc, tie, spans (sorted array of begin, end in units): what a document must give up.

    decide(units, packed, doc, tie, start) -> (window start in the concatenated strings, string number) of the
    windows whose sequence also occurs at an earlier place; see the two callers for what earlier means.
    """
    rows = keyed(docs)
    by_place = not units.words
    places = anchors(rows, units)
    seen = places.groupBy("h").agg(F.sum("times").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    repeated = materialise(seen.filter(F.col("n") > 1 if by_place else F.col("a") < F.col("b")).select("h"), f"{label}-anchors")
    bloom = bloom_of(repeated, repeated.count())
    found = fragments(rows, units, bloom) if bloom is not None else fragments_of(rows, places.join(repeated, "h", "left_semi"), units)
    found = materialise(found.withColumn("id", _string_id()), f"{label}-fragments")

    place = F.struct("doc", "tie", "start") if by_place else F.struct("doc")
    strings = lambda rows: materialise(rows.groupBy("h", "packed").agg(F.min(place).alias("first")).select("h", "packed", "first.*"), f"{label}-distinct")
    distinct = strings(found)
    for level in range(1, LEVELS + 2):
        hot = materialise(distinct.groupBy("h").agg(F.sum(F.octet_length("packed")).alias("bytes")).filter(F.col("bytes") > HOT).select("h"), f"{label}-hot")
        if hot.isEmpty():
            break
        again = materialise(recut(found.join(hot, "h", "left_semi"), units, level).withColumn("id", _string_id()), f"{label}-fragments")
        found = found.join(hot, "h", "left_anti").unionByName(again)
        distinct = distinct.join(hot, "h", "left_anti").unionByName(strings(again))
    width = units.width

    @tk.tidy
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_anchors(batches):
            packed = part.column("packed").combine_chunks()
            get = lambda name: part.column(name).to_numpy() if name in part.column_names else None
            codes, offsets = _packed_units(units, packed)
            at, row = decide(units, codes, offsets, get("doc"), get("tie"), get("start"))
            begin, end, of = tk.merged(at, width, row)
            begin, end = begin - offsets[of], end - offsets[of]
            yield _decisions(part, begin, end, of)

    names = [c for c in ("h", "packed", "doc", "tie", "start") if c in distinct.columns]
    decided = distinct.select(names).repartition("h").sortWithinPartitions("h").mapInArrow(bucket, "packed binary, spans array<long>")
    decided = decided.select(_string_id().alias("id"), "spans")
    firsts = distinct.select(_string_id().alias("id"), *[F.col(c).alias(f"first_{c}") for c in names[2:]])
    # A table of its own, so that the join below may split a string with very many places.
    decided = materialise(decided.join(firsts, "id", "right"), f"{label}-decided")

    own = F.col("doc") == F.col("first_doc")
    if by_place:
        own = own & (F.col("tie") == F.col("first_tie")) & (F.col("start") == F.col("first_start"))
    spans = F.when(own, F.coalesce("spans", F.array().cast("array<long>"))).otherwise(F.array(F.lit(0).cast("long"), F.col("units")))
    moved = F.transform(spans, lambda x: x + F.col("start"))
    placed = found.select("id", "doc", "tie", "start", "units").join(decided, "id").select("doc", "tie", moved.alias("spans")).filter(F.size("spans") > 0)
    return placed.groupBy("doc", "tie").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _decisions(part: pa.Table, begin: np.ndarray, end: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    rows, times = np.unique(of, return_counts=True)
    flat = np.empty(2 * len(begin), dtype=np.int64)
    flat[0::2], flat[1::2] = begin, end
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * times)]).astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([part.column("packed").combine_chunks().take(pa.array(rows)), lists], names=["packed", "spans"])


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole anchors, about CHUNK packed bytes each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in tk.pieces([batch], "packed", CHUNK):
            held.append(piece)
            size += piece.column("packed").nbytes
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
            size = sum(b.column("packed").nbytes for b in held) if cut else 0
    if held:
        yield pa.Table.from_batches(held)
