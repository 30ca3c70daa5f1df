"""The Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

from quillspark.llm import merkle
from tests.llm.test_edges import NAMES
from tests.llm.test_operators import rows_of

TABLE = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The top, and of each node the steps to it: (siblings before, siblings behind)."""
    paths = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for path, at in zip(paths, place, strict=True):
            run = runs[at // 8]
            path.append((run[: at % 8], run[at % 8 + 1 :]))
        place = [p // 8 for p in place]
        nodes = [sha(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in rows if r[2] == g), key=lambda x: x[:3]) for g in langs}
    low = {g: tree([x[2] for x in own[g]]) for g in langs}
    if not rows:
        return []
    root, high = tree([low[g][0] for g in langs])
    out = []
    for g, above in zip(langs, high, strict=True):
        for (_, _, digest, r), path in zip(own[g], low[g][1], strict=True):
            changed = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and changed is not None:
                changed = "".join(c.lower() if c.isascii() else c for c in changed)
            fold = leaf((*r[:4], changed))
            for before, behind in path + above:
                fold = sha(*before, fold, *behind)
            out.append((r[0], digest, low[g][0], root, sha(*(x for step in path + above for part in step for x in part)), fold, fold == root))
    return sorted(out, key=repr)


def check(spark, rows):
    assert rows_of(merkle.digest(spark.createDataFrame(rows, TABLE))) == brute(rows)


def test_same_as_a_plain_tree(spark):
    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice("aBcÉ é\n:-1") for _ in range(rnd.randrange(30)))
    langs = ["en"] * 600 + ["de"] * 65 + ["fr"] * 8 + ["é"] * 9 + ["lone"] + [None] * 70 + ["", "EN"]
    rows = [(k, rnd.choice(["a", None, ""]), g, rnd.choice([None, 5, -3]), rnd.choice([None, "", text(), text()])) for k, g in enumerate(langs)]
    rnd.shuffle(rows)
    rows += rows[:5] + rows[:5] + [(None, None, None, None, None)] * 3 + [(None, "a", "en", 1, "A"), (None, "a", "en", 1, "B"), (3, "x", "en", 1, "Long " * 200_000)]
    check(spark, rows)


def test_small_tables(spark):
    check(spark, [])
    check(spark, [(6, "a", "en", 1, "A")])
    check(spark, [(k, "a", "en", 1, "A") for k in range(9)])
    check(spark, [(1, "a", f"l{k:02}", 1, "A") for k in range(20)])
    check(spark, [(1, "a", "en", 1, "same")] * 100)


def test_columns_that_clash(spark):
    names = [*NAMES, "grp", "key", "digest", "claimed", "idx", "cnt", "path"]
    rows = [(k, "a", "en", 1, "Text") for k in range(12)]
    table = spark.createDataFrame([(*r, *range(len(names))) for r in rows], TABLE + ", " + ", ".join(f"{n} int" for n in names))
    assert rows_of(merkle.digest(table)) == brute(rows)


def test_a_moved_border_between_columns_changes_the_leaf(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("-", "abc")], "x string, y string")
    assert df.select(merkle.leaf(df.x, df.y)).distinct().count() == 4
