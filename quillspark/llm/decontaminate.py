"""Benchmark decontamination (op 2): size-partitioned MinHash containment, then exact shingle containment.

Items are put in size classes (powers of two of their shingle count). An item's sketch is its bottom-k MinHash,
k the least number of its shingles that a containing document can't miss: a document that holds at least
80 % of q distinct shingles lacks q - ceil(0.8 q) of them, so it holds one of any q - ceil(0.8 q) + 1. For
each class, only document shingles at or below the class's largest sketch hash are looked up. Long documents
are no harder than short ones, and no contained item is missed. Candidates are confirmed on the shingles of both whole
texts, compared word by word (no hashes).

Defined results: words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; items
with one to four words are one shingle of that many words; null or empty items are never contained; null
text holds nothing; null ids are returned as they are; repeated rows are returned once; tables without rows give none.
`clean` keeps all columns of docs, of any name. A text of 20 MB takes about 0.5 GB in its worker (textkit.py). The session's
Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import fresh, materialise, ship_package

WIDTH, PERCENT = 5, 80
#: Benchmarks with more bytes (texts, sketches, 32 a row) than this are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _words(column: pa.Array) -> tk.Words:
    return tk.Words(tk.texts(column), tk.ALNUM_WORD, lower=True)


def _grams(words: tk.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of one width in all texts, and the owners."""
    if len(words.starts) < width:
        return np.zeros(0, dtype=tk.U), np.zeros(0, dtype=np.int64)
    at = tk.within(words.offsets, width)
    return tk.mix(tk.gram_hashes(words.hashes, width)[at] + tk.U(width)), np.searchsorted(words.offsets, at, side="right") - 1


class Sets:
    """The different shingles of texts, numbered by their words."""

    def __init__(self, column: pa.Array):
        self.words = _words(column)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, row: int, width: int) -> np.ndarray:
        if width not in self.made:
            words, offsets = self.words, self.words.offsets
            names = tk.window_names(words.names, width)
            at = tk.within(offsets, width) if len(names) else np.zeros(0, dtype=np.int64)
            owner = np.searchsorted(offsets, at, side="right") - 1
            many = int(names.max()) + 1 if len(names) else 1
            owner, name = np.divmod(tk.different(owner * many + names[at]), many)
            self.made[width] = name, np.searchsorted(owner, np.arange(len(offsets)))
        name, ends = self.made[width]
        return name[ends[row] : ends[row + 1]]


def _confirmed(docs: pa.Array, items: pa.Array, pairs: list[tuple[int, int]], width: list[int] | np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """document, item, n_item_shingles, n_shared of the pairs of places whose item is contained. Each text is cut once."""
    if not pairs:
        return []
    rows, own = (np.unique([p[k] for p in pairs]) for k in (0, 1))
    sets = Sets(pa.concat_arrays([tk.texts(docs.take(pa.array(rows))), tk.texts(items.take(pa.array(own)))]))
    out = []
    for r, i in pairs:
        full = sets.of(len(rows) + int(np.searchsorted(own, i)), int(width[i]))
        shared = len(np.intersect1d(full, sets.of(int(np.searchsorted(rows, r)), int(width[i])), assume_unique=True))
        if 100 * shared >= percent * len(full):
            out.append((r, i, len(full), shared))
    return out


def items(benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, text, width, size_class, sketch (sorted uint64 as bytes), top (largest sketch hash less 2**63)."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            words = _words(batch.column("text"))
            out = []
            for width in range(1, WIDTH + 1):
                g, row = _grams(words, width)
                edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                for k in np.flatnonzero(words.counts == width if width < WIDTH else words.counts >= WIDTH):
                    full = tk.different(g[edge[k] : edge[k + 1]])
                    q = len(full)
                    sketch = full[: q - (percent * q + 99) // 100 + 1]
                    out.append((int(k), width, int(q).bit_length(), sketch.tobytes(), int(sketch[-1]) - (1 << 63)))
            at = pa.array([r[0] for r in out], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), batch.column("text").take(at), *[pa.array([r[i + 1] for r in out], t) for i, t in enumerate(kinds)]], names=["item_id", "text", "width", "size_class", "sketch", "top"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(scan, "item_id long, text string, width int, size_class int, sketch binary, top long")


RESULT = "doc_id long, tie long, item_id long, n_item_shingles long, n_shared long"


def _result(batch: pa.RecordBatch, item_ids: pa.Array, rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    at, item = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tie").take(at), item_ids.take(item), *[pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3)]], names=["doc_id", "tie", "item_id", "n_item_shingles", "n_shared"])


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie (hash of the text), item_id, n_item_shingles, n_shared of all contained items."""
    spark = docs.sparkSession
    ship_package(spark)
    known = materialise(items(benchmark, percent), "items")
    total = known.agg(F.coalesce(F.sum(F.octet_length("sketch") + F.octet_length("text") + 32), F.lit(0)).cast("long")).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    if total > BROADCAST_BYTES:
        return _contained_by_join(rows, known, percent)
    table = known.select("item_id", "text", "width", "size_class", "sketch").toArrow().combine_chunks()
    item_ids, texts = (table.column(k).combine_chunks() for k in ("item_id", "text"))
    width, size_class = (table.column(k).to_numpy() for k in ("width", "size_class"))
    raw, ends = tk.buffer(table.column("sketch").combine_chunks().cast(pa.large_binary()))
    sketches, ends = np.frombuffer(raw.tobytes(), dtype=tk.U), ends // 8
    of = np.repeat(np.arange(len(width)), np.diff(ends))
    classes = []
    for key in np.unique(np.stack([width, size_class], axis=1), axis=0).tolist():
        own = (width[of] == key[0]) & (size_class[of] == key[1])
        order = np.argsort(sketches[own], kind="stable")
        classes.append((key[0], sketches[own][order], of[own][order]))
    sent = spark.sparkContext.broadcast((item_ids, texts, width, classes))

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, texts, width, classes = sent.value
        for batch in tk.pieces(batches):
            words = _words(batch.column("text"))
            grams = {w: _grams(words, w) for w in {c[0] for c in classes}}
            pairs: set[tuple[int, int]] = set()
            for w, hashes, of in classes:
                g, row = grams[w]
                low = np.flatnonzero(g <= hashes[-1])
                first = np.searchsorted(hashes, g[low])
                hit = hashes[first] == g[low]
                for k, x, r in zip(first[hit].tolist(), g[low][hit].tolist(), row[low][hit].tolist(), strict=True):
                    while k < len(hashes) and hashes[k] == x:
                        pairs.add((r, int(of[k])))
                        k += 1
            yield _result(batch, item_ids, _confirmed(batch.column("text"), texts, sorted(pairs), width, percent))

    return rows.mapInArrow(scan, RESULT).distinct()


def _contained_by_join(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The same for benchmarks of any size: sketches and low document shingles meet in a shuffled join, partitioned by width and size class.

    The largest sketch hash of each class bounds what documents send to it, so short items, whose sketches reach far up, don't make documents
    send what only the large classes could need.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ends = tk.buffer(batch.column("sketch").cast(pa.large_binary()))
            at = pa.array(tk.owner(ends // 8))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("width", "size_class")], pa.array(np.frombuffer(raw.tobytes(), dtype=np.int64)), batch.column("item_id").take(at)], names=["width", "size_class", "g", "item_id"])

    sketch = known.select("width", "size_class", "item_id", "sketch").mapInArrow(sketches, "width int, size_class int, g long, item_id long")
    # One row for each width and bit length of a number of shingles: WIDTH * 64 at most.
    tops = [(r.width, r.size_class, r.top + (1 << 63)) for r in known.groupBy("width", "size_class").agg(F.max("top").alias("top")).collect()]

    @tk.tidy
    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            words = _words(batch.column("text"))
            grams = {w: _grams(words, w) for w in {t[0] for t in tops}}
            for w, size_class, top in tops:
                g, row = grams[w]
                at = np.flatnonzero(g <= tk.U(top))
                same = [pa.array(np.full(len(at), x, dtype=np.int32)) for x in (w, size_class)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(g[at].view(np.int64)), batch.column("doc_id").take(pa.array(row[at])), batch.column("tie").take(pa.array(row[at]))], names=["width", "size_class", "g", "doc_id", "tie"])

    sent = rows.mapInArrow(low, "width int, size_class int, g long, doc_id long, tie long").distinct()
    pairs = sent.join(sketch, ["width", "size_class", "g"]).select("doc_id", "tie", "item_id").distinct()
    pairs = materialise(pairs, "candidates")
    full = pairs.join(known.select("item_id", "width", F.col("text").alias("item")), pairs["item_id"].eqNullSafe(known["item_id"])).select("doc_id", "tie", pairs["item_id"], "width", "item")
    texts = rows.dropDuplicates(["doc_id", "tie"]).withColumnsRenamed({"doc_id": "d", "tie": "t"})
    both = full.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))

    @tk.tidy
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            pairs = [(k, k) for k in range(batch.num_rows)]
            yield _result(batch, batch.column("item_id"), _confirmed(batch.column("text"), batch.column("item"), pairs, batch.column("width").to_numpy(), percent))

    return both.select("doc_id", "tie", "item_id", "width", "item", "text").mapInArrow(confirm, RESULT).distinct()


def report(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared."""
    return contained(docs, benchmark, percent).drop("tie").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    d, t = fresh(docs, "quill_doc", "quill_tie")
    bad = contained(docs, benchmark, percent).select(F.col("doc_id").alias(d), F.col("tie").alias(t)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(t)), "left_anti")
