"""Equality by content: sequences whose polynomial hashes collide, long chains, hot buckets, and joins past the broadcast bounds."""

import random

import pytest

from quillspark.llm import decontaminate, neardup, substring_dedup, suffix_dedup, suffix_global, windows
from tests.llm.test_operators import CORPUS, brute_components, brute_substring, brute_suffix, docs, rows_of


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


TM, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")
HEAD = " ".join(f"w{k}" for k in range(49))


def test_equal_polynomial_hashes(spark):
    words = [(1, f"{HEAD} {TM}"), (2, f"{HEAD} {OTHER}"), (3, TM), (4, OTHER)]
    texts = words + [(5, " ".join(TM)), (6, " ".join(OTHER)), (7, " ".join(TM[:64])), (8, " ".join(OTHER[:64]))]
    assert rows_of(substring_dedup.digest(docs(spark, texts))) == brute_substring(texts)
    assert rows_of(suffix_dedup.digest(docs(spark, texts))) == brute_suffix(texts)
    assert rows_of(neardup.link(docs(spark, texts), 85)) == brute_components(texts, 85)
    items = spark.createDataFrame([(1, TM), (2, f"{HEAD} {TM}")], "item_id long, text string")
    assert rows_of(decontaminate.report(docs(spark, [(4, OTHER), (3, TM)]), items)) == [(3, 1, 1, 1)]


@pytest.mark.parametrize("n", [1000])
def test_chain_in_few_rounds(spark, monkeypatch, n):
    monkeypatch.setattr(neardup, "BLOCK_LINKS", 0)
    labels = []
    plain = neardup.materialise
    monkeypatch.setattr(neardup, "materialise", lambda df, label: labels.append(label) or plain(df, label))
    links = spark.range(1, n).selectExpr("id as a", "id + 1 as b")
    assert {r.c for r in neardup.components(links).collect()} == {1}
    assert labels.count("links") <= 15 and labels.count("hooks") <= 15


@pytest.mark.parametrize("block", [neardup.BLOCK_LINKS, 20])
def test_components_of_mixed_order(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_LINKS", block)
    rnd = random.Random(3)
    path = list(range(600))
    rnd.shuffle(path)
    pairs = list(zip(path[:400], path[1:401], strict=False)) + [(path[k], path[500]) for k in range(401, 500)]
    got = {r.v: r.c for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: min(path[:401]) for v in path[:401]} | {v: min(path[401:501]) for v in path[401:501]}


RUNS = [(20 + k, "a" * (90 + 40 * k)) for k in range(12)] + [(40 + k, "x " * (30 + 25 * k)) for k in range(8)] + [(60, "ab" * 900), (61, "ba" * 700)]


@pytest.mark.parametrize("hot", [900, 0])
def test_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "LONGEST_RUN", 300)
    monkeypatch.setattr(windows, "LAST_RUN", 64)
    texts = CORPUS + RUNS
    assert rows_of(suffix_dedup.digest(docs(spark, texts))) == brute_suffix(texts)
    assert rows_of(substring_dedup.digest(docs(spark, texts))) == brute_substring(texts)


def test_without_bloom(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.shared.BLOOM_MAX_KEYS", -1)
    texts = CORPUS + RUNS
    assert rows_of(substring_dedup.digest(docs(spark, texts))) == brute_substring(texts)
    assert rows_of(suffix_dedup.digest(docs(spark, texts))) == brute_suffix(texts)


def test_sliced_texts(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.textkit.PIECE", 5_000)
    texts = CORPUS + RUNS
    assert rows_of(suffix_dedup.digest(docs(spark, texts))) == brute_suffix(texts)
    assert rows_of(substring_dedup.digest(docs(spark, texts))) == brute_substring(texts)


def test_symbols_of_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_global, "RUN", 2)
    got = lambda texts: sorted((r.pos, r.sym) for r in suffix_global.symbols_of(docs(spark, texts)).collect())
    assert got([]) == []
    assert got([(1, ""), (2, "a"), (3, None), (4, "bc")]) == [(0, 1), (1, 99), (2, 1), (3, 1), (4, 100), (5, 101), (6, 1)]


def test_global_suffix_array(spark):
    rnd = random.Random(2)
    texts = [(2, "".join(rnd.choice("ab") for _ in range(25))), (1, "é"), (None, "")]
    rows = sorted((r.pos, r.sym) for r in suffix_global.symbols_of(docs(spark, texts)).collect())
    assert [s for _, s in rows] == [b + 2 for b in "é".encode()] + [1] + [b + 2 for b in texts[0][1].encode()] + [1, 1]
    symbols = [s for _, s in rows]
    got = {r.pos: r.rank for r in suffix_global.ranks(spark.createDataFrame(rows, "pos long, sym long")).collect()}
    assert sorted(got, key=got.get) == sorted(range(len(symbols)), key=lambda k: symbols[k:]) and sorted(got.values()) == list(range(1, len(symbols) + 1))
