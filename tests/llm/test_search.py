"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.llm import search
from tests.llm.test_edges import clashing
from tests.llm.test_operators import docs, rows_of

ITEM = "item_id long, text string, score int, rank string, term string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(texts, items, top=10):
    bags = [(k, Counter(terms(t))) for k, t in texts if terms(t)]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    queries = {}
    for k, t in items:
        queries.setdefault(k, Counter()).update(terms(t))
    out = []
    for item, query in queries.items():
        found = []
        for k, b in bags:
            m = 25 + 75 * b.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, times in query.items() if b[t])
            if score > 0:
                found.append((-score, k is not None, k or 0, k))
        out += [(item, rank, k, -score) for rank, (score, _, _, k) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n, seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(120)] + ["été", "漢字", "X9"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    return [(k, " ".join(rnd.choices(vocab, weights, k=rnd.choice([1, 3, 30, 200])))) for k in range(n)], rnd


@pytest.mark.parametrize("window", [4, 64, 1 << 14])
def test_same_as_a_plain_loop(spark, monkeypatch, window):
    monkeypatch.setattr(search, "WINDOW", 8 * max(1, window // 8))
    texts, rnd = corpus(300, window)
    texts += [(400, None), (401, ""), (402, "... !"), (None, texts[5][1]), (None, texts[5][1]), (7, texts[5][1]), (403, "W1 w1\x00W1 été"), (404, "w3 " * 60_000)] + [(500 + k, texts[3][1]) for k in range(40)]
    items = [(k, texts[rnd.randrange(300)][1]) for k in range(12)] + [(20, None), (21, ""), (22, "nowhere to be found"), (23, "w1 w1 W1"), (None, "w2 été"), (24, texts[3][1]), (25, "w7"), (25, "w8")]
    rows = spark.createDataFrame([(*r, 1, "x", "y") for r in items], ITEM)
    got = search.search(docs(spark, texts), rows)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows_of(got) == brute(texts, items)
    if window == 64:
        monkeypatch.setattr(search, "BLOCK", 200)  # many blocks of items
        monkeypatch.setattr(search, "LISTS", 3)
        monkeypatch.setattr(search, "WINDOW_BYTES", 2000)
        assert rows_of(search.search(docs(spark, texts), rows, 3)) == brute(texts, items, 3)


def test_empty_and_clashing_tables(spark):
    items = spark.createDataFrame([(1, "w1", 1, "x", "y")], ITEM)
    none = spark.createDataFrame([], ITEM)
    assert search.search(docs(spark, []), items).count() == search.search(docs(spark, [(1, "w1")]), none).count() == 0
    assert search.search(docs(spark, [(1, None), (2, "")]), items).count() == 0
    assert rows_of(search.search(clashing(spark, [(3, "w1 w2"), (4, "w2")]), items)) == brute([(3, "w1 w2"), (4, "w2")], [(1, "w1")])
