"""Empty tables, columns with the names that operators use, null keys, repeated rows and very long texts."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import chat, decontaminate, licenses, mixing, neardup, quality, substring_dedup, suffix_dedup, tokens, warc
from tests.llm.test_operators import docs, prose, rows_of

ITEM = "item_id long, text string"
NAMES = ["_q", "_w", "_l", "_d", "_t", "_u", "_gone", "src", "cdf", "draws", "rate", "n_copies", "Copy", "order_key", "quill_quality", "QUILL_ROW", "quill_words", "quill_lines", "quill_key", "quill_copy", "quill_doc", "quill_tie", "quill_us", "quill_src", "quill_draws", "quill_cdf", "doc", "tie", "spans", "place"]
GOOD = [(k, ". ".join(prose(9) for _ in range(9)) + ".") for k in range(6)]


def clashing(spark, texts):
    rows = [(k, t, "en", f"s{(k or 0) % 2}", len(t or ""), *range(len(NAMES))) for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES))


def test_empty_tables(spark):
    none, items = docs(spark, []), spark.createDataFrame([(1, "five words are one item")], ITEM)
    assert licenses.digest(none).count() == suffix_dedup.digest(none).count() == substring_dedup.digest(none).count() == 0
    assert tokens.digest(none).count() == quality.digest(none).count() == quality.clean(none).count() == mixing.mix(none).count() == 0
    assert neardup.deduplicate(none).count() == decontaminate.report(none, items).count() == decontaminate.clean(none, items).count() == 0
    full = docs(spark, GOOD)
    assert decontaminate.report(full, spark.createDataFrame([], ITEM)).count() == 0 and decontaminate.clean(full, spark.createDataFrame([], ITEM)).count() == 6
    talks = "conv_id long, turn long, role string, text string, tree string, node long, kind string"
    assert [r.conv_id for r in chat.digest(spark.createDataFrame([], talks)).collect()] == [-1]
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_columns_that_clash(spark):
    table = clashing(spark, GOOD + [(7, "short"), (7, "short"), (None, GOOD[0][1]), (None, None), (None, prose(80)), (None, prose(80) + " x")])
    items = spark.createDataFrame([(1, GOOD[2][1][:80])], ITEM)
    cleaned = quality.clean(table)
    assert cleaned.columns == table.columns and {r.doc_id for r in cleaned.collect()} == {0, 1, 2, 3, 4, 5, None}
    assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in cleaned.collect())
    once = neardup.deduplicate(table)
    assert once.columns == table.columns
    kept = [(r.doc_id, r.text) for r in once.collect()]
    assert kept.count((7, "short")) == 1 and (None, GOOD[0][1]) not in kept and kept.count((None, None)) == 1 and len(kept) == len(set(kept))
    left = decontaminate.clean(table, items)
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} == {0, 1, 3, 4, 5, 7, None}
    mixed = mixing.mix(table)
    assert mixed.columns == [*table.columns, "rate_", "n_copies_", "copy_", "order_key_"]
    assert all(tuple(r)[5 : len(table.columns)] == tuple(range(len(NAMES))) for r in mixed.collect())
    for digest in (licenses.digest, suffix_dedup.digest, substring_dedup.digest, tokens.digest, quality.digest):
        assert digest(table).count() == 12
    assert neardup.link(table).count() == 12


def test_a_conversation_named_minus_one(spark):
    rows = [(-1, 0, "user", "own"), (None, 1, "user", "b"), (None, 0, "user", "a")]
    got = chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("-1", 1), ("-1", 2), ("None", 2)]


def test_pipeline_without_rows(spark, tmp_path):
    clashing(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], ITEM).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def long_texts():
    rnd = random.Random(6)
    words = [f"word{k}" for k in range(20_000)]
    text = "\n".join(" ".join(rnd.choice(words) for _ in range(12)) + "." for _ in range(8_000))
    return [(1, text), (2, text[300_000:420_000]), (3, "x" * 300_000)]


def test_very_long_texts(spark, long_texts):
    table = docs(spark, long_texts)
    one, two, three = (len(t) for _, t in long_texts)
    got = {r.doc_id: r for r in suffix_dedup.digest(table).collect()}
    assert [(got[k].n_bytes, got[k].n_removed) for k in (1, 2, 3)] == [(one, 0), (two, two), (three, three - 1)]
    got = {r.doc_id: r for r in substring_dedup.digest(table).collect()}
    assert got[1].n_words == 96_000 and got[1].n_removed == 0 and 0 <= got[2].n_words - got[2].n_removed <= 2 and got[3].n_words == 1
    assert {r.doc_id: r.n_words for r in licenses.digest(table).collect()} == {1: 96_000, 2: got[2].n_words, 3: 1}
    items = spark.createDataFrame([(1, long_texts[0][1][600_000:600_600])], ITEM)
    assert [(r.doc_id, r.item_id) for r in decontaminate.report(table, items).collect()] == [(1, 1)]
    assert {r.doc_id: r.n_shingles for r in neardup.signatures(table).collect()}[3] == 1
    assert sum(r.n_tokens for r in tokens.digest(table).collect()) > 96_000
    judged = {r.doc_id: r for r in quality.digest(table).collect()}
    assert judged[1].n_words == 96_000 and judged[1].kept and not judged[3].kept
    pages = spark.createDataFrame([(k, "u", t) for k, t in long_texts], "page_id long, url string, html string")
    assert rows_of(warc.digest(pages).select("page_id", "payload_bytes")) == [(1, one), (2, two), (3, three)]
