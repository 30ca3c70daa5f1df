"""Regions, tails of files, guidance as of a time, letters and dominant values."""

import datetime as dt
import random
from collections import Counter

from pyarrow import fs
from pyspark.sql import functions as F

from quillspark.operators import feedback, names, regions
from quillspark.sources import folders, tail

BOX = "page long, kind string, box_no long, x0 double, y0 double, x1 double, y1 double"


def test_glyphs(spark):
    boxes = [(1, "block", 1, 0.0, 0.0, 200.0, 100.0), (1, "cell", 9, 10.0, 10.0, 60.0, 60.0), (1, "cell", 8, 60.0, 10.0, 90.0, 60.0), (1, "block", 0, 60.0, 60.0, 70.0, 70.0), (2, "cell", 3, -30.0, -30.0, -10.0, -10.0)]
    points = [(1, 1, 5.0, 5.0), (1, 2, 60.0, 60.0), (1, 3, 65.0, 65.0), (1, 4, 300.0, 5.0), (2, 5, -10.0, -20.0), (3, 6, 0.0, 0.0), (1, 7, 200.0, 100.0), (1, 8, None, 3.0)]
    want = {1: ("block", 1), 2: ("cell", 8), 3: ("block", 0), 4: ("page", None), 5: ("cell", 3), 6: ("page", None), 7: ("block", 1), 8: ("page", None)}
    for spread in (1, 3):
        got = regions.placed(spark.createDataFrame(points, "page long, point long, x double, y double"), spark.createDataFrame(boxes, BOX), 25.0, spread)
        assert {r.point: (r.kind, r.box_no) for r in got.collect()} == want


def test_overlapping_boxes(spark):
    rnd = random.Random(2)
    chain = [(1, k, 10.0 * k, 0.0, 10.0 * k + 10, 5.0) for k in range(200)]
    rnd.shuffle(chain)
    names_ = list(range(200))
    rnd.shuffle(names_)
    chain = [(1, names_[k], *rest) for _, k, *rest in chain]
    loose = [(2, k, (x := rnd.random() * 300), (y := rnd.random() * 300), x + rnd.random() * 40, y + rnd.random() * 40) for k in range(60)]
    boxes = chain + loose
    parent = {b[:2]: b[:2] for b in boxes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in boxes:
        for b in boxes:
            if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]:
                u, v = sorted((find(a[:2]), find(b[:2])))
                parent[v] = u
    rounds = []

    def keep(df, label):
        rounds.append(label)
        return folders.written(df, label)

    got = regions.merged(spark.createDataFrame(boxes, "page long, box_no long, x0 double, y0 double, x1 double, y1 double"), keep=keep).collect()
    assert {(r.page, r.box_no): r.region for r in got} == {k: find(k)[1] for k in parent}
    assert len(rounds) < 25  # a chain of 200 in a few rounds
    one = next(r for r in got if r.page == 1)
    assert (one.rx0, one.ry0, one.rx1, one.ry1) == (0.0, 0.0, 2000.0, 5.0)


def test_tails(spark, tmp_path):
    rnd = random.Random(1)
    texts = ["", "\n", "\n\n", "one", "one\n", "a\nb", "a\r\nb\r\n", "é" * 50 + "\nlast", *("".join(rnd.choice("ab\n") for _ in range(rnd.randrange(60))) for _ in range(200))]
    for k, text in enumerate(texts):
        path = tmp_path / f"f{k}"
        path.write_bytes(text.encode())
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        lines = lines[:-1] if lines[-1] == "" else lines
        for n in (1, 2, 7):
            for block in (1, 3, 1000):
                assert tail.last_lines(fs.LocalFileSystem(), str(path), n, block) == lines[-n:], (text, n, block)
    big = tmp_path / "big"
    with big.open("wb") as out:
        out.truncate(3 << 30)  # a sparse file of 3 GB
        out.seek(0, 2)
        out.write(b"\nx\ny\n")
    spark.dataSource.register(tail.TailSource)
    read = lambda paths, n: sorted((r.path.rpartition("/")[2], r.from_end, r.line) for r in spark.read.format("quill_tail").option("paths", paths).option("lines", n).load().collect())
    assert read(str(big), 2) == [("big", 1, "y"), ("big", 2, "x")]
    assert read(f"{tmp_path}/f5;{tmp_path}/f0", 5) == [("f5", 1, "b"), ("f5", 2, "a")] and read("", 5) == []


def test_guidance(spark):
    day = lambda n, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=h)
    versions = [("a", day(3), "r1", True), ("a", day(5), "r2", False), ("a", day(5, 1), "r3", True), ("a", day(5, 1), "r0", False), ("b", day(1), "q", True)]
    asked = {1: ("a", day(2), "missing", None), 2: ("a", day(3), "active", "r1"), 3: ("a", day(5), "inactive", None), 4: ("a", day(5, 2), "active", "r3"), 5: ("b", day(3), "active", "q"), 6: ("b", day(3, 1), "stale", None), 7: ("b", day(90), "stale", None), 8: ("c", day(3), "missing", None), 9: (None, day(3), "missing", None)}
    docs = spark.createDataFrame([(k, kind, ts) for k, (kind, ts, _, _) in asked.items()], "doc_id long, kind string, ts timestamp_ntz")
    got = feedback.guidance(docs, spark.createDataFrame(versions, "kind string, ts timestamp_ntz, rule string, active boolean"), 2).collect()
    assert {r.doc_id: (r.state, r.rule) for r in got} == {k: v[2:] for k, v in asked.items()}


def test_letters_and_dominant_values(spark):
    rnd = random.Random(7)
    texts = [("".join(rnd.choice("aAéß漢1 -\n𝒳") for _ in range(rnd.randrange(30))), "".join(rnd.choice("aAéß漢1 -\n𝒳") for _ in range(rnd.randrange(30)))) for _ in range(300)] + [("", ""), ("a" * 3000 + "b", "a" * 2999)]
    letters = lambda t: Counter(c for c in t if c.isalnum())
    rows = spark.createDataFrame(texts, "a string, b string").select("a", "b", names.missing_letters(F.col("a"), F.col("b")).alias("m")).collect()
    for r in rows:
        assert sorted(r.m) == sorted(letters(r.a) - letters(r.b)), (r.a, r.b)
    got = names.dominant(spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (2, "y"), (2, "y"), (3, None)], "k int, v string"), "k", "v").collect()
    assert sorted((r.k, r.v, r.n) for r in got) == [(1, "a", 1), (2, "y", 2), (3, None, 1)]


def test_points_are_shuffled_once_and_guidance_is_no_join(spark):
    """Points meet boxes where they are grouped (F12); documents stand among versions, and are joined with none."""
    import __spark_entry__ as entry

    plan = lambda name: entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan("rule_guidance").optimizedPlan().toString().count("Join ") == 1  # the first times of the kinds
    df = regions.placed(spark.createDataFrame([(1, 1, 5.0, 5.0)], "page long, point long, x double, y double").hint("merge"), spark.createDataFrame([(1, "cell", 9, 0.0, 0.0, 60.0, 60.0)], BOX))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_covered_tiles(spark):
    """Boxes behind one that covers a tile are dropped there alone, and bounds on edges of tiles hold what they held."""
    rnd = random.Random(5)
    boxes = [(1, rnd.choice(["cell", "block"]), k, (x := 5.0 * rnd.randrange(40)), (y := 5.0 * rnd.randrange(40)), x + 5.0 * rnd.randrange(-1, 30), y + 5.0 * rnd.randrange(-1, 30)) for k in range(150)]
    points = [(1, k, 2.5 * rnd.randrange(100), 2.5 * rnd.randrange(100)) for k in range(400)]
    got = {r.point: (r.kind, r.box_no) for r in regions.placed(spark.createDataFrame(points, "page long, point long, x double, y double"), spark.createDataFrame(boxes, BOX)).collect()}
    for _, k, x, y in points:
        best = min(((b[1] != "cell", b[2], b[1]) for b in boxes if b[3] <= x <= b[5] and b[4] <= y <= b[6]), default=(0, None, "page"))
        assert got[k] == (best[2], best[1])


def test_guidance_in_order(spark):
    """Versions at a document's own time count, those of no kind don't, and days behind the last version are told apart."""
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    versions = [("a", t(1, 5), "r1", True), ("a", t(1, 5), "r2", True), ("a", t(3, 9), "r3", False), (None, t(1), "r", True)]
    docs = [(1, "a", t(1, 4)), (2, "a", t(1, 5)), (3, "a", t(2, 7)), (4, "a", t(3, 8)), (5, "a", t(3, 9)), (6, "a", t(5, 9)), (7, "a", t(5, 10)), (8, "a", t(20)), (9, None, t(2)), (10, "b", t(2))]
    out = feedback.guidance(spark.createDataFrame(docs, "doc_id long, kind string, ts timestamp_ntz"), spark.createDataFrame(versions, "kind string, ts timestamp_ntz, rule string, active boolean"), 2)
    want = {1: "missing", 2: "active", 3: "active", 4: "stale", 5: "inactive", 6: "inactive", 7: "stale", 8: "stale", 9: "missing", 10: "missing"}
    rows = {r.doc_id: (r.state, r.rule) for r in out.collect()}
    assert {k: s for k, (s, _) in rows.items()} == want and rows[3][1] == "r2" and rows[5][1] is None


def test_links_grow_with_boxes_not_pairs(spark):
    """300 boxes over one spot, and one that touches the last of them by an edge, take links by the crossings of the grid under them."""
    boxes = [(1, k, 0.0, 0.0, 60.0 + k, 60.0) for k in range(300)] + [(1, 300, 359.0, 60.0, 370.0, 70.0), (1, 301, 371.0, 0.0, 380.0, 70.0)]
    written = []

    def keep(df, label):
        out = folders.written(df, label)
        written.append(out.count() if label == "links" else 0)
        return out

    got = regions.merged(spark.createDataFrame(boxes, "page long, box_no long, x0 double, y0 double, x1 double, y1 double"), keep=keep).collect()
    assert {r.box_no: r.region for r in got} == {k: 0 for k in range(301)} | {301: 301}
    assert 0 < sum(written) < 300 * 299 / 10  # two for each of a box's crossings at most, where all pairs are 89,700 rows
