"""Ranked lexical search (op 12) by windowed bucket scoring.

Every document is scored for every item of a query table. One pass over the texts keeps, of each document, its number of terms
and its postings: which terms of the items it holds, how often. Sorted by doc_id, documents fall into windows of WINDOW; in a
window the postings are turned into one list of places for each term. For each item the lists of its terms are traversed: a
posting's impact is added to the bucket of its place, an array that stays in the cache, and the lists' bitsets are joined to
the window's occupancy. Occupied buckets are harvested into the item's heap of `top` documents, and emptied. A task gives
its heaps, and a window over items ranks what all tasks found.

Weights and impacts are the 64-bit integers of the query's contract: w = floor(1000 ln((2N + 2) / (2 df + 1))), and
w * ((10^9 tf) div (1000 tf + 8 m)) with m = 25 + ((75 n N) div L), for each term of the item, repeats included.

Items are dealt by hash into blocks of some BLOCK bytes of terms; only a block's terms are sent to the tasks, and each block
goes over all documents. A single item must fit a worker's memory. The check's benchmark is one block.

Defined results: a term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased; null and
empty texts have none, are no part of N and never found; rows with equal item_id (null too) are one item; rows with equal doc_id and
repeated rows are documents of their own; null doc_id comes first; equal scores are ranked by doc_id. An item without terms, or
whose terms no document holds, has no rows. Empty tables give no rows. Other columns are ignored.
Memory: some 25 bytes a byte of a text. The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import materialise, ship_package

#: Documents of a window: 128 KB of buckets.
WINDOW = 1 << 14
#: Bytes of terms (with 16 for each) in one block of items.
BLOCK = 16 << 20
#: Bytes of postings at which a window ends earlier.
WINDOW_BYTES = 64 << 20
#: Posting lists of a window that are held at once, with 2 KB of bitset each.
LISTS = 1 << 14
TOP = 10


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms of a piece, each with a space behind it; the number of each term in order; n + 1 offsets of the texts."""
    words = tk.Words(column, tk.ALNUM_WORD, lower=True)
    data, starts, _ = words.joined()
    coded = tk.binary_view(data, np.append(starts, len(data))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), words.offsets


def _counted(rows: np.ndarray, terms: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of times of the different pairs, in order."""
    pairs, times = np.unique(rows * many + terms, return_counts=True)
    return *np.divmod(pairs, many), times


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (bytes, with a space behind), times."""
    ship_package(items.sparkSession)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            names, index, offsets = _terms(tk.texts(batch.column("text")))
            row, term, times = _counted(tk.owner(offsets), index, max(len(names), 1))
            ids = batch.column("item_id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), names.take(pa.array(term)).cast(pa.binary()), pa.array(times.astype(np.int64))], names=["item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, term binary, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Block:
    """A block of items: their ids, the different terms, and of each item the terms' numbers and times."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        coded = rows.column("term").combine_chunks().dictionary_encode()
        self.terms = coded.dictionary.cast(pa.large_binary())
        ids = rows.column("item_id").to_pylist()
        self.items = sorted(set(ids), key=lambda k: (k is not None, k))
        number = {k: j for j, k in enumerate(self.items)}
        item = np.array([number[k] for k in ids], dtype=np.int64)
        order = np.argsort(item, kind="stable")
        self.ends = np.searchsorted(item[order], np.arange(len(self.items) + 1))
        self.numbers = coded.indices.to_numpy().astype(np.int64)[order]
        self.times = rows.column("times").to_numpy()[order]


def blocks(items: DataFrame) -> Iterator[Block]:
    """All items, in blocks. Only the sum of the terms' sizes and one block at a time come to the driver."""
    terms = materialise(item_terms(items), "item-terms")
    size = terms.agg(F.sum(F.length("term") + 16)).first()[0]
    if not size:
        return
    many = -(-size // BLOCK)
    for k in range(many):
        rows = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).toArrow()
        if rows.num_rows:
            yield Block(rows)


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, n (its terms with repeats), terms (the numbers of those in `terms` that it holds), tfs, for each document with a term."""
    ship_package(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(terms)

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(len(known.value), 1)
        for batch in tk.pieces(batches):
            names, index, offsets = _terms(tk.texts(batch.column("text")))
            number = pc.fill_null(pc.index_in(names, value_set=known.value), -1).to_numpy().astype(np.int64)[index]
            hit = number >= 0
            row, term, times = _counted(tk.owner(offsets)[hit], number[hit], many)
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            ends = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(kind))) for x, kind in ((term, np.int32), (times, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Scorer:
    """Buckets, heaps and the statistics that scores need."""

    def __init__(self, block: Block, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.block, self.weights, self.n_docs, self.n_terms, self.top = block, weights, n_docs, n_terms, top
        self.buckets = np.zeros(WINDOW, dtype=np.int64)
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in block.items]
        self.seen = 0

    def window(self, ids: list[int | None], n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Scores a window: ids and n of its documents, and its postings (place, term, tf)."""
        m = 25 + 75 * n * self.n_docs // self.n_terms
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        doc, impact = doc[order], impact[order]
        ends = np.searchsorted(term[order], np.arange(len(self.weights) + 1))
        lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for j in range(len(self.block.items)):
            occupied = np.zeros(WINDOW // 8, dtype=np.uint8)
            own = slice(self.block.ends[j], self.block.ends[j + 1])
            for t, times in zip(self.block.numbers[own].tolist(), self.block.times[own].tolist(), strict=True):
                found = lists.get(t)
                if found is None:
                    a, b = ends[t], ends[t + 1]
                    if a == b:
                        continue
                    place = np.zeros(WINDOW, dtype=bool)
                    place[doc[a:b]] = True
                    if len(lists) >= LISTS:
                        lists.clear()
                    found = lists[t] = doc[a:b], impact[a:b], np.packbits(place)
                self.buckets[found[0]] += found[1] if times == 1 else times * found[1]
                occupied |= found[2]
            self._harvest(self.heaps[j], np.flatnonzero(np.unpackbits(occupied)), ids)
        self.seen += len(ids)

    def _harvest(self, heap: list[tuple[int, int, int | None]], places: np.ndarray, ids: list[int | None]) -> None:
        """The best occupied buckets go into the heap; ties go to the earlier document, and documents come in order."""
        scores = self.buckets[places]
        self.buckets[places] = 0
        least = heap[0][0] if len(heap) == self.top else 0
        good = scores > least
        places, scores = places[good], scores[good]
        if len(scores) > self.top:
            bound = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            some = scores >= bound
            places, scores = places[some], scores[some]
            best = np.lexsort((places, -scores))[: self.top]
            places, scores = places[best], scores[best]
        for place, score in zip(places.tolist(), scores.tolist(), strict=True):
            entry = (score, -(self.seen + place), ids[place])
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _scored(docs: DataFrame, block: Block, top: int) -> DataFrame:
    spark = docs.sparkSession
    held = materialise(postings(docs, block.terms), "postings")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(block.terms), dtype=np.int64)
    for t, df in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term of the block at most
        frequency[t] = df
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.int64)
    shared = spark.sparkContext.broadcast((block, weights))
    # Repeated doc_ids are dealt apart by their place in the table.
    placed = held.withColumn("place", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.col("place")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "place").drop("place")

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        scorer = Scorer(own, w, n_docs, n_terms, top)
        for window in _windows(batches):
            tfs, terms = (window.column(k).combine_chunks() for k in ("tfs", "terms"))
            doc = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64))
            scorer.window(window.column("doc_id").to_pylist(), window.column("n").to_numpy(), doc, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy())
        rows = [(k, score, doc) for k, heap in zip(own.items, scorer.heaps, strict=True) for score, _, doc in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item_id", "score", "doc_id"])

    return ordered.mapInArrow(run, "item_id long, score long, doc_id long")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at most WINDOW rows, which end at WINDOW_BYTES."""
    held: list[pa.RecordBatch] = []
    have = size = 0
    for batch in batches:
        while have + batch.num_rows >= WINDOW:
            yield pa.Table.from_batches([*held, batch.slice(0, WINDOW - have)])
            batch, held, have, size = batch.slice(WINDOW - have), [], 0, 0
        if batch.num_rows:
            held.append(batch)
            have, size = have + batch.num_rows, size + batch.nbytes
        if size >= WINDOW_BYTES:
            yield pa.Table.from_batches(held)
            held, have, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` documents of positive score."""
    found = None
    for block in blocks(items):
        part = _scored(docs, block, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
