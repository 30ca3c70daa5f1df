"""Merkle manifest of a dataset (op 13), with inclusion proofs, by window-based levels.

Each row is a leaf: the SHA-256 of its columns, each as its length in UTF-8 bytes, a colon and its value, or `-` for null.
In each group the leaves, in the order of the key, are cut into runs of FAN; a run's digests, concatenated as lowercase hex,
give the digest of its parent, and so on until one node is left, the group's subroot. The subroots, in the order of the groups,
are the leaves of a last tree, whose top is the root.

A level is one window over (group, parent): the ordered full-frame list of its digests gives both the parent's preimage
and each node's siblings, split into those before and those behind it. The first node of each run stands for the parent in the
next level. From the top down, each node's path is its own step and its parent's path, so levels are joined once. A leaf's
path proves it: `folded` recomputes the root from any claimed leaf, whose siblings stay those of the manifest.

Leaves are numbered without a window over a group: they are sorted by range of (group, key, digest), and each (part, group)
starts where the parts before it end. Groups may be of any size and number; every window holds FAN rows, and every
level is written to the shared folder. Equal rows are dealt by their place in the table.

Defined results: null groups are a group, before all others; null keys come first; rows with equal key are ordered by their digest,
and repeated rows are leaves of their own; a group of one leaf has it as its subroot, and one group's subroot is the root;
the proof of a lone leaf is empty; an empty table gives no rows. Very long texts are hashed as a whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import materialise

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """The digest of a row's values: none can be moved from one to another without a change."""

    def field(value: Column) -> Column:
        raw = F.encode(value.cast("string"), "UTF-8")
        return F.coalesce(F.concat(F.encode(F.concat(F.octet_length(raw).cast("string"), F.lit(":")), "UTF-8"), raw), F.encode(F.lit("-"), "UTF-8"))

    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(nodes: DataFrame, label: str) -> DataFrame:
    """nodes (grp, key, digest and more) with idx (from 0 in the group) and cnt (nodes of the group), written down."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.col("digest"), F.col("place")]
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")
    rows = materialise(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), label)
    runs = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        F.col("grp").alias("g"), F.col("part").alias("p"), F.sum("n").over(Window.partitionBy("grp")).alias("cnt"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    joined = rows.join(starts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("g", "p", "part", "at", "shift")


def _levels(nodes: DataFrame, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of each level: the nodes that have siblings or are a run's only one, with parent, step and up (the parent's digest); and the subroots found there."""
    levels, tops = [], []
    while True:
        tops.append(nodes.filter("cnt = 1"))
        run = Window.partitionBy("grp", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        grouped = nodes.filter("cnt > 1").withColumn("parent", F.expr(f"idx div {FAN}")).withColumn("run", F.collect_list("digest").over(run))
        own = (F.col("idx") % FAN).cast("int")
        step = F.struct(F.concat_ws("", F.slice("run", F.lit(1), own)).alias("before"), F.concat_ws("", F.slice("run", own + 2, F.lit(FAN))).alias("behind"))
        level = materialise(grouped.withColumn("step", step).withColumn("up", F.sha2(F.concat_ws("", "run"), 256)).drop("run"), f"{label}-{len(levels)}")
        if level.isEmpty():
            return levels, tops
        levels.append(level)
        nodes = level.filter(f"idx % {FAN} = 0").select("grp", F.col("up").alias("digest"), F.col("parent").alias("idx"), F.expr(f"(cnt + {FAN - 1}) div {FAN}").alias("cnt"))


def _paths(levels: list[DataFrame], tops: list[DataFrame], ends: DataFrame, kept: list[str]) -> DataFrame:
    """grp, kept columns of the lowest nodes, path (steps from the node to the root), subroot, root. ends: grp, subroot, root and the subroot's path."""
    ends = ends.withColumnRenamed("grp", "g")
    finished = [t.join(ends, F.col("grp").eqNullSafe(F.col("g"))).drop("g") for t in tops]
    above = None
    for k in reversed(range(len(levels) + 1)):
        keep = kept if k == 0 else []
        rows = finished[k].select("grp", "idx", *keep, "path", "subroot", "root")
        if above is not None:
            parents = above.select(F.col("grp").alias("g"), F.col("idx").alias("i"), F.col("path").alias("rest"), "subroot", "root")
            joined = levels[k].join(parents, F.col("grp").eqNullSafe(F.col("g")) & (F.col("parent") == F.col("i")))
            rows = joined.select("grp", "idx", *keep, F.concat(F.array("step"), F.col("rest")).alias("path"), "subroot", "root").unionByName(rows)
        above = rows
    return above.drop("idx")


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: grp, key, digest, and columns to carry. Gives them with path (steps from the leaf to the root), subroot and root."""
    rows = materialise(leaves, "leaves")
    kept = [c for c in rows.columns if c != "grp"]
    levels, tops = _levels(_numbered(rows, "leaf-order"), "level")
    subroots = None
    for t in tops:
        part = t.select("grp", F.col("digest").alias("subroot"))
        subroots = part if subroots is None else subroots.unionByName(part)
    subroots = materialise(subroots, "subroots")
    over = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("digest"))
    upper, last = _levels(_numbered(over, "subroot-order"), "top")
    none = "cast(array() as array<struct<before:string,behind:string>>)"
    root = last[-1].select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root")).withColumn("path", F.expr(none))
    found = _paths(upper, last, root, ["key", "digest"])
    ends = found.select(F.col("key").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    return _paths(levels, tops, ends, kept)


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["behind"]))), 256)


def folded(claimed: Column, path: Column) -> Column:
    """The root that a claimed leaf would give."""
    return F.aggregate(path, claimed, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["behind"]), 256))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a document whose text was changed to lower case where 3 divides the CRC-32 of its id; the true leaf elsewhere, and for null ids."""
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    text = F.when(F.coalesce(hit, F.lit(False)), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return leaf(*(text if c == "text" else F.col(c) for c in COLUMNS))


def digest(docs: DataFrame) -> DataFrame:
    leaves = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").alias("key"), leaf(*map(F.col, COLUMNS)).alias("digest"), tampered(docs).alias("claimed"))
    rows = manifest(leaves)
    out = rows.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
