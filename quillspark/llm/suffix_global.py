"""One global suffix array of all texts by a distributed difference-cover sort (cover modulo 3).

It is right, and no query uses it: its sorts and joins move every byte of the corpus many hundred times (README has the measured
figures), against four times that are allowed. op 4 applies the same sort to each bucket of strings that can repeat.

In each level the triples at places 1 and 2 modulo 3 are named by a distributed sort, the names are sorted by recursion unless
all differ, places 0 modulo 3 are sorted by (symbol, rank of the next), and each place's rank is its rank among its own kind and
the number of the other kind's keys below it.

Defined results: a null or empty text is its end mark alone; rows with equal doc_id and text are taken once; null doc_id is the last; an empty table
has no symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import materialise
from quillspark.llm.windows import keyed


#: Texts whose sizes one task sums.
RUN = 1 << 16


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with number (from 1) in the given order: sorted partitions, and the rows of all partitions before."""
    ranged = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    sizes = {r.p: r.n for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    before, pairs = 0, []
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(before)]
        before += sizes[p]
    start = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return ranged.withColumn("number", start + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at")


def _ahead(rows: DataFrame, table: DataFrame, value: str, step: int, name: str) -> DataFrame:
    """rows with the value that stands `step` places on; 0 behind the end."""
    there = table.select((F.col("pos") - step).alias("pos"), F.col(value).alias(name))
    return rows.join(there, "pos", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def ranks(symbols: DataFrame) -> DataFrame:
    """pos, rank of the suffixes of symbols(pos from 0, sym over 0)."""
    symbols = materialise(symbols.select(F.col("pos").cast("long").alias("pos"), F.col("sym").cast("long").alias("sym")), "symbols")
    n = symbols.count()
    if n < 4:
        row = sorted(symbols.collect())  # three rows at most
        order = sorted(range(len(row)), key=lambda k: [r.sym for r in row[k:]])
        return symbols.sparkSession.createDataFrame([(row[k].pos, i + 1) for i, k in enumerate(order)], "pos long, rank long")
    extra = symbols.sparkSession.createDataFrame([(n, 0)] if n % 3 == 1 else [], "pos long, sym long")  # the empty suffix ends the first half of the names
    sample = symbols.unionByName(extra).filter("pos % 3 <> 0")
    triples = materialise(_ahead(_ahead(sample, symbols, "sym", 1, "s1"), symbols, "sym", 2, "s2"), "triples")
    names = materialise(_numbered(triples.select("sym", "s1", "s2").distinct(), "sym", "s1", "s2").withColumnRenamed("number", "name"), "names")
    named = triples.join(names, ["sym", "s1", "s2"]).select("pos", "name")
    half = (n + (n % 3 == 1) + 1) // 3  # places 1 modulo 3
    if names.count() < triples.count():
        place: Column = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(half + F.floor(F.col("pos") / 3))
        inner = ranks(named.select(place.alias("pos"), F.col("name").alias("sym")))
        back = F.when(F.col("pos") < half, F.col("pos") * 3 + 1).otherwise((F.col("pos") - half) * 3 + 2)
        named = inner.select(back.alias("pos"), F.col("rank").alias("name"))
    named = materialise(named, "named")
    zeros = _ahead(symbols.filter("pos % 3 = 0"), named, "name", 1, "r1")
    others = _ahead(_ahead(symbols.filter("pos % 3 <> 0"), symbols, "sym", 1, "s1"), named, "name", 1, "r1")
    full = _ahead(others, named, "name", 2, "r2")
    zeros = materialise(_ahead(_ahead(zeros, symbols, "sym", 1, "s1"), named, "name", 2, "r2"), "zeros")
    kind = (F.col("pos") % 3).cast("int")
    all_ones = zeros.select("pos", "sym", F.lit(0).cast("long").alias("mid"), F.col("r1").alias("r")).unionByName(full.filter("pos % 3 = 1").select("pos", "sym", F.lit(0).cast("long").alias("mid"), F.col("r1").alias("r")))
    all_twos = zeros.select("pos", "sym", F.col("s1").alias("mid"), F.col("r2").alias("r")).unionByName(full.filter("pos % 3 = 2").select("pos", "sym", F.col("s1").alias("mid"), F.col("r2").alias("r")))
    # In the order of zeros and ones (or twos) together, a place's number less its number among its own is what stands below it of the other.

    def below(rows: DataFrame, label: str) -> DataFrame:
        both = materialise(_numbered(rows, "sym", "mid", "r"), label).select("pos", F.col("number").alias("both"))
        mine = [_numbered(both.filter(kind == k), "both").select("pos", "number", (F.col("both") - F.col("number")).alias("below")) for k in (0, 1, 2)]
        return materialise(mine[0].unionByName(mine[1]).unionByName(mine[2]), label)

    one, two = below(all_ones, "ones"), below(all_twos, "twos")
    zero = one.filter(kind == 0).join(two.filter(kind == 0).select("pos", F.col("below").alias("more")), "pos").select("pos", (F.col("number") + F.col("below") + F.col("more")).alias("rank"))
    alone = materialise(_numbered(named.filter(F.col("pos") < n), "name").select("pos", "number"), "sample")
    rest = alone.join(one.filter(kind == 1).unionByName(two.filter(kind == 2)).select("pos", "below"), "pos").select("pos", (F.col("number") + F.col("below")).alias("rank"))
    return materialise(zero.unionByName(rest), "ranks")


def symbols_of(docs: DataFrame) -> DataFrame:
    """pos, sym: the bytes of all texts one after the other, each text with an end mark, in the order of doc_id."""
    rows = keyed(docs).dropDuplicates(["doc", "tie"]).select("doc", "tie", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    rows = _numbered(rows, "doc", "tie").withColumn("size", F.octet_length("raw") + 1)
    # Sums before each text: inside runs of RUN texts by a window for each, and over the runs' own sums.
    sizes = rows.select("number", "size", F.expr(f"number div {RUN}").alias("run"))
    runs = sizes.groupBy("run").agg(F.sum("size").alias("total")).selectExpr("run", "sum(total) over (order by run rows between unbounded preceding and 1 preceding) as ahead")
    inside = sizes.selectExpr("number", "run", "sum(size) over (partition by run order by number rows between unbounded preceding and 1 preceding) as here")
    before = inside.join(runs, "run").select("number", (F.coalesce("here", F.lit(0)) + F.coalesce("ahead", F.lit(0))).alias("base"))
    none, end = F.array().cast("array<bigint>"), F.array(F.lit(1).cast("long"))
    codes = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.conv(F.hex(F.substring("raw", k, F.lit(1))), 16, 10).cast("long") + 2)
    each = rows.join(before, "number").select("base", F.posexplode(F.concat(F.when(F.col("size") > 1, codes).otherwise(none), end)).alias("k", "sym"))  # sequence(1, 0) would run downwards
    return each.select((F.col("base") + F.col("k")).alias("pos"), "sym")


