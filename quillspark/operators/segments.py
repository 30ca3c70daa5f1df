"""Segments of documents: extraction, addresses, batches, contexts, and the way back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


_PIECES = re.compile(r"[^\r\n]+|[\r\n]+")
_LINES = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("source", pa.string()), ("context", pa.string())])


def line_segments(docs: DataFrame, part: str = "txt", around: int = 150) -> DataFrame:
    """[A10, A16, F3, I1] One row for each line with a letter: doc_id, line_no, segment_id, part, location, source, context.

    Narrow, and one pass over each text: offsets in code points would be counted from the start for every line by column functions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, m in enumerate(_PIECES.finditer(text)):
                    if any(map(str.isalpha, m[0])):
                        rows.append((doc, k, *m.span(), m[0].strip(), text[max(0, m.start() - around) : m.end() + around]))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)

    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, line_no long, begin long, end long, source string, context string")
    location = F.concat(F.lit("offset:"), F.col("begin"), F.lit(":"), F.col("end"))
    return rows.select("doc_id", "line_no", T.stable_id(F.lit(part), location).alias("segment_id"), F.lit(part).alias("part"), location.alias("location"), "source", "context")


def batches(segments: DataFrame, key: str, order: str, size: int = 24) -> DataFrame:
    """batch: number of the batch of `size` rows by position."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return segments.withColumn("batch", F.floor(at / size).cast("long"))


def neighbours(segments: DataFrame, key: str, order: str, before: int = 3, after: int = 3, limit: int = 5000) -> DataFrame:
    """[F2, G7] around: sources of the rows before and after, joined by a space."""
    near = Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)
    return segments.withColumn("around", F.left(F.array_join(F.collect_list("source").over(near), " "), F.lit(limit)))


def context_dictionary(segments: DataFrame, key: str, order: str) -> DataFrame:
    """[C1] context_ref: context_0.. in order of first appearance inside the key."""
    first = segments.groupBy(key, "context").agg(F.min(order).alias("_first"))
    named = first.withColumn("context_ref", F.concat(F.lit("context_"), F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1)).drop("_first")
    return segments.join(named, [key, "context"])


def spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """[B3, B4] text with the spans (begin, end, value; ascending) replaced, each value with the white space that was around its source."""
    out, at = [], 0
    for begin, end, value in spans:
        own = text[begin:end]
        bare = own.strip()
        left = own[: len(own) - len(own.lstrip())]
        out += [text[at:begin], left, value.strip(), own[len(left) + len(bare) :]]
        at = end
    return "".join([*out, text[at:]])


def replaced(docs: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """[B3, B4, D12] docs with each segment's candidate in place of its source: doc_id, rendered. Linear in the text."""
    both = segments.join(candidates.select("doc_id", "segment_id", "candidate"), ["doc_id", "segment_id"]).filter(~T.blank(F.col("candidate")))
    begin, end = (F.split("location", ":")[k].cast("int") for k in (1, 2))
    spans = both.groupBy("doc_id").agg(F.collect_list(F.struct(begin.alias("begin"), end.alias("end"), F.col("candidate").alias("value"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (batch.column(k).to_pylist() for k in range(3))
            rendered = [t if t is None or not own else spliced(t, sorted((x["begin"], x["end"], x["value"]) for x in own)) for t, own in zip(texts, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rendered, pa.string())], names=["doc_id", "rendered"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, rendered string")
