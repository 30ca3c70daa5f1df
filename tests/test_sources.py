"""Publication by lease, state with fallbacks, resumed streams and the page loop."""

import glob
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import pages
from quillspark.sources import publish, state
from quillspark.streaming import resume


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(publish.PublishSource)
    spark.dataSource.register(state.StateSource)


def published(spark, place):
    return sorted(r.k for r in spark.read.format("quill_publish").option("path", place).load().collect())


def into(df, place, owner="a", mode="overwrite"):
    df.write.format("quill_publish").mode(mode).option("path", place).option("lease", f"{place}/lease.json").option("owner", owner).save()


def staged(place):
    return glob.glob(f"{place}/.staged/*")


def test_publication(spark, tmp_path):
    place = str(tmp_path / "out")
    os.makedirs(place)
    rows = lambda a, b: spark.range(a, b, 1, 4).select(F.col("id").alias("k"))
    with pytest.raises(Exception, match="nothing is published"):
        published(spark, place)
    with pytest.raises(Exception, match="LeaseLost"):
        into(rows(0, 9), place)  # there is no lease
    publish.put_json(f"{place}/lease.json", {"owner": "a", "until": time.time() + 600})
    into(rows(0, 100), place)
    assert published(spark, place) == list(range(100))
    assert os.listdir(place) and not [n for n in os.listdir(place) if n.endswith(".tmp")]
    # A task that dies half way: nothing of the write can be read, and nothing is left.
    before = set(staged(place))
    bad = rows(0, 4000).select(F.when(F.col("k") == 3999, F.raise_error(F.lit("died"))).otherwise(F.col("k")).alias("k"))
    with pytest.raises(Exception, match="died"):
        into(bad, place)
    assert published(spark, place) == list(range(100)) and set(staged(place)) == before
    with pytest.raises(Exception, match="LeaseLost"):
        into(rows(0, 5), place, "b")
    with pytest.raises(Exception, match="replaced as a whole"):
        into(rows(0, 5), place, mode="append")
    into(rows(7, 7), place)
    assert published(spark, place) == []


def test_a_lease_that_ends_before_the_commit(tmp_path):
    """What was staged goes, and the last publication stays."""
    from pyspark.sql.types import LongType, StructType

    import pyarrow as pa

    place = str(tmp_path)
    lease = f"{place}/lease.json"
    publish.put_json(lease, {"owner": "a", "until": time.time() + 600})
    options = {"path": place, "owner": "a", "lease": lease}
    schema = StructType().add("k", LongType())
    batch = pa.RecordBatch.from_pydict({"k": pa.array([1, 2], pa.int64())})
    first = publish.PublishWriter(options, schema)
    first.commit([first.write(iter([batch])), first.write(iter([]))])
    kept = publish.get_json(f"{place}/manifest.json")
    late = publish.PublishWriter(options, schema)
    messages = [late.write(iter([batch])), None]
    late.write(iter([batch]))  # a second attempt of a task, whose message was lost
    publish.put_json(lease, {"owner": "b", "until": time.time() + 600})
    with pytest.raises(publish.LeaseLost):
        late.commit(messages)
    assert publish.get_json(f"{place}/manifest.json") == kept and len(staged(place)) == 1
    for lease_ in (None, {"owner": "a"}, {"owner": "a", "until": 5}, {"owner": "b", "until": 99}, []):
        assert not publish.holds(lease_, "a", 10)


def test_state_with_fallbacks(spark, tmp_path):
    good = {"version": 1, "entries": [{"key": "k", "value": "v"}, {"key": "n", "value": None}]}
    texts = {
        "a": {1: json.dumps(good)[:20], 2: json.dumps({"version": 2, "entries": []}), 3: json.dumps({"version": 1, "entries": [{"key": 5}]}), 4: "[1]", 5: json.dumps(good), 6: b"\xff\xfe"},
        "b": {k: json.dumps({"version": 1, "entries": []} if k == 2 else good) for k in (0, 1, 2, 3, 4, 6)},
    }
    for place, own in texts.items():
        os.makedirs(tmp_path / place)
        for k, text in own.items():
            (tmp_path / place / f"shard-{k}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    df = spark.read.format("quill_state").option("places", f"a={tmp_path}/a;b={tmp_path}/b;c={tmp_path}/none").option("shards", 8).load()
    got = sorted({(r.shard, r.place, r.failures) for r in df.collect()}, key=repr)
    why = {0: "missing", 1: "damaged", 3: "form", 4: "version", 6: "damaged"}
    assert got == sorted([*((k, "b", f"a:{v}") for k, v in why.items()), (5, "a", ""), (7, None, "a:missing,b:missing,c:missing")], key=repr)
    assert sorted((r.key, r.value) for r in df.filter("shard = 5").collect()) == [("k", "v"), ("n", None)]


SCHEMA = "k long, draft string"


def test_a_killed_run_goes_on(spark, tmp_path):
    """The second batch dies after half of its work; the next run does it again, and nothing twice."""
    source, folder = tmp_path / "in", f"file://{tmp_path}/state"
    for n in range(4):
        spark.range(n * 10, n * 10 + 12).select(F.col("id").alias("k")).coalesce(1).write.parquet(str(source / f"f{n}"))
    stream = lambda: spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    calls = []

    def work(batch, dies=False):
        calls.append(sorted(r.k for r in batch.collect()))
        bad = F.raise_error(F.lit("killed")) if dies and len(calls) == 2 else F.lit("")
        return batch.select("k", F.concat(F.lit("draft "), F.col("k").cast("string"), F.when(F.col("k") % 10 == 5, bad).otherwise("")).alias("draft"))

    with pytest.raises(Exception, match="killed"):
        resume.upsert(stream(), folder, "f1", lambda b: work(b, True), ["k"]).awaitTermination()
    first = {r.k for r in resume.accepted(spark, folder, "f1", SCHEMA, ["k"]).collect()}
    assert first == set(calls[0]) and len(first) == 12
    resume.upsert(stream(), folder, "f1", work, ["k"]).awaitTermination()
    assert calls[2] == calls[1] and len(calls) == 5  # the killed batch again, then the two after it; the first isn't done twice
    rows = [(r.k, r.draft) for r in resume.accepted(spark, folder, "f1", SCHEMA, ["k"]).collect()]
    assert sorted(rows) == [(k, f"draft {k}") for k in range(42)]
    resume.upsert(stream(), folder, "f1", work, ["k"]).awaitTermination()
    assert len(calls) == 5 and resume.accepted(spark, folder, "other", SCHEMA, ["k"]).count() == 0


def test_page_loop_like_a_plain_one(spark):
    rnd = random.Random(6)
    marks = ["[text continues]", "\\frac{1}{2}", "TODO", "| a | b |", "$$", "- item", "漢" * 12, "Article 5"]
    rows = [(k, 0, "\n".join(rnd.choice([*marks, "plain text", "more"]) for _ in range(rnd.randrange(5))) or None, k % 3 == 0, k % 4 == 1, k % 2 == 0, True) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, body string, toc boolean, nested boolean, tiers boolean, columns boolean")
    translate = lambda b, n: F.when(n == 1, b).otherwise(F.replace(b, F.when(n == 2, "[text continues]").otherwise("TODO"), F.lit("x")))
    lay = lambda d, n: F.when(n == 1, d).otherwise(F.replace(d, F.when(n == 2, "$$").otherwise("\\frac{1}{2}"), F.lit("y")))
    got = {r.doc_id: (r.draft, r.translations, r.formats, list(r.defects), r.status) for r in pages.page_loop(df, translate, lay).collect()}
    assert len(got) == 120 and {g[4] for g in got.values()} == {"passed", "needs_review"} and {g[1] for g in got.values()} == {1, 2, 3}
    # One page at a time, judged by the same critics.
    tries = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("d", translate(F.col("body"), F.col("n"))).withColumn("dd", T.draft_defects(F.col("d"), F.lit(True)))
    drafts = {(r.doc_id, r.n): (r.d, list(r.dd)) for r in tries.collect()}
    layouts = tries.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("l", lay(F.col("d"), F.col("m"))).withColumn("ld", T.layout_defects(F.col("l"), *map(F.col, ("toc", "nested", "tiers", "columns"))))
    laid = {(r.doc_id, r.n, r.m): (r.l, list(r.ld)) for r in layouts.collect()}
    for k in range(120):
        n = 1
        while drafts[k, n][1] and n < 3:
            n += 1
        m = 1
        while laid[k, n, m][1] and m < 3:
            m += 1
        defects = drafts[k, n][1] + laid[k, n, m][1]
        assert got[k] == (laid[k, n, m][0], n, m, defects, "needs_review" if defects else "passed"), k


def test_image_headers(spark):
    """Real files written by hand: segments with lengths, padding, restart marks, frames of several kinds, and broken ones."""
    from quillspark.sources.images import header

    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\0\0\0\0\2\x08"
    jpeg = lambda frame: b"\xff\xd8\xff\xe1\0\x04ab\xff\xff\xd0\xff\xc4\0\x03x" + frame
    webp = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + body
    assert header(png) == ("PNG", 256, 2) and header(png[:20]) is None and header(png.replace(b"IHDR", b"IDAT")) is None and header(png.replace(b"\0\0\1\0", b"\0\0\0\0")) is None
    assert header(jpeg(b"\xff\xc0\0\x11\x08\0\x05\1\0")) == ("JPEG", 256, 5) and header(jpeg(b"\xff\xcf\0\x11\x08\0\x05\0\x07")) == ("JPEG", 7, 5)
    assert header(jpeg(b"\xff\xc0\0\x11\x08\0")) is None and header(jpeg(b"\xff\xda\0\x02zz")) is None and header(b"\xff\xd8") is None
    assert header(webp(b"VP8X", b"\0" * 4 + b"\x09\0\0\x01\x01\0")) == ("WEBP", 10, 258)
    assert header(webp(b"VP8L", b"\x2f" + (9 | 4 << 14).to_bytes(4, "little"))) == ("WEBP", 10, 5)
    assert header(webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a\x0a\0\x05\x40")) == ("WEBP", 10, 5)
    assert header(webp(b"VP8 ", b"\0" * 12)) is None and header(b"") is None and header(b"text") is None


def test_image_headers_wider_than_a_jpeg_frame(spark, tmp_path):
    """Widths over 65535 don't fit the 16 bits of a JPEG frame."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame([(n, 65_500 + n * 7) for n in range(1, 40)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    with duckdb.connect() as con:
        con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        want = con.execute(entry.oracle_sql()["image_headers"]).fetchall()
    assert sorted(map(tuple, entry.queries()["image_headers"](spark, str(tmp_path)).collect())) == sorted(want)


def test_asked_again_and_in_halves(spark):
    from quillspark.operators import answers

    ids = lambda *x: list(x)
    batches = [(1, ids(1, 2, 3)), (2, ids(4, 13, 5, 6, 7)), (3, ids(13)), (4, ids()), (5, None), (6, ids(*range(20, 33)))]
    bad = lambda i: F.exists(i, lambda x: x == 13)
    late = lambda i, n: (n == 1) & F.exists(i, lambda x: x == 20)
    answer = lambda i, n: F.struct(F.when(bad(i) | late(i, n), F.slice(i, 1, F.greatest(F.size(i) - 1, F.lit(0)))).otherwise(i).alias("ids"), F.when(bad(i) | late(i, n), F.slice(F.transform(i, lambda x: x.cast("string")), 1, F.greatest(F.size(i) - 1, F.lit(0)))).otherwise(F.transform(i, lambda x: x.cast("string"))).alias("texts"))
    got = answers.asked(spark.createDataFrame(batches, "k long, ids array<long>"), answer).collect()
    rows = sorted((r.k, list(r.ids), r.error, r.depth, r.attempt, None if r.answer is None else list(r.answer.texts)) for r in got)
    assert rows == [
        (1, [1, 2, 3], None, 0, 1, ["1", "2", "3"]), (2, [4], None, 2, 1, ["4"]), (2, [5, 6, 7], None, 1, 1, ["5", "6", "7"]), (2, [13], "omitted", 2, 2, None), (3, [13], "omitted", 0, 2, None),
        (4, [], None, 0, 1, []), (5, [], None, 0, 1, []), (6, list(range(20, 33)), None, 0, 2, [str(x) for x in range(20, 33)]),
    ]
