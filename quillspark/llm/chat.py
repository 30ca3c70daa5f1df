"""Chat formatting (op 3) from reply trees, in DataFrame functions only.

Messages are nodes with a parent. Iterative self-joins with doubled reach (the ancestor 1, 2, 4, ... steps
up) enumerate all nodes on the way from each leaf to its root; branches are ranked within their tree by the
mean score of their messages; each chosen branch is formatted as one conversation.

Template: <|im_start|>role, newline, text, <|im_end|>, newline. In texts and roles & becomes &amp; and <|
becomes &lt;|; in roles a newline becomes &#10;. No control string can come out of an escaped text, and the
way back is exact.

Defined results: null text, role or score is empty, empty or 0; null conv_id is one conversation; repeated rows are turns of their own,
and turns with equal numbers go by role and text; further columns (of any name) are ignored; empty tables give none; a node whose parent is missing is a root; nodes
that only lead into a cycle are on no root-to-leaf path and aren't returned; ties in score go to the smaller leaf.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def branches(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up (steps from the leaf): all root-to-leaf paths of nodes(tree, node, parent)."""
    nodes = materialise(nodes.select("tree", "node", "parent"), "nodes")
    known = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above"))
    links = materialise(links, "links")
    roots = nodes.join(links, ["tree", "node"], "left_anti").select("tree", "node")
    paths = nodes.join(links.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    jump = links
    for k in range(max(1, math.ceil(math.log2(deepest + 1)))):
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = materialise(paths.unionByName(further), "paths")
        jump = jump.join(jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top")), ["tree", "above"]).select("tree", "node", F.col("top").alias("above"))
        jump = materialise(jump, "jumps")
        if jump.isEmpty():
            break
    ends = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf")
    return paths.join(ends, ["tree", "leaf"], "left_semi")


def best_branches(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, rank, turns (array of step, role, text from the root on) of the best branches of nodes(tree, node, parent, role, text, score)."""
    steps = branches(nodes)
    scored = steps.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    totals = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))).filter(F.col("rank") <= per_tree)
    chosen = steps.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])
    filled = chosen.join(nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    turn = F.struct((-F.col("up")).alias("step"), "role", "text")
    return filled.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans (start from 0 and length of each assistant text, in code points of formatted)."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), _escape_role(t["role"]), F.lit("\n")).alias("head"), _escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = conversations.withColumn("_p", pieces)
    tail = CLOSE + "\n"
    out = out.withColumn("formatted", F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        span = F.struct(begin.alias("start"), F.length(p["body"]).alias("size"))
        return F.struct((begin + F.length(p["body"]) + len(tail)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return out.withColumn("loss_spans", F.aggregate("_p", start, step, lambda a: a["spans"])).drop("_p")


def parsed(text: Column) -> Column:
    """Array of role, text, read back from a formatted conversation."""
    parts = F.slice(F.split(text, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(CLOSE) - 1)).alias("text")))


def chain(conversations: DataFrame, tree: Column | None = None) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees with one branch, named by conv_id or by `tree`; null conv_id is one conversation."""
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")) if tree is None else tree
    rows = conversations.select(name.alias("tree"), "turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


CONTROL = CLOSE + OPEN + "assistant ok"


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's digest. The added conversation stays apart from one of the table that has the id -1, too."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit("own ").alias("kind")).unionByName(extra.withColumn("kind", F.lit("added ")))
    done = formatted(best_branches(materialise(chain(rows, F.concat("kind", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))), "chain")))
    back = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["size"]))), "")
    return done.select(
        F.substring_index("tree", " ", -1).try_cast("long").alias("conv_id"),
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
