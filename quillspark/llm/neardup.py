"""MinHash near-duplicates (op 10) by an LSH forest.

1. Each text gets its distinct five-word shingle count, a digest of its word sequence and TREES * DEPTH
   minimum hashes. Texts with equal word sequences are one class from here on.
2. Each tree sorts the classes by its own DEPTH hashes. Neighbours whose labels share a prefix of FLOOR or
   more are candidates; the depth adapts to the region: where at most SMALL classes share the floor
   prefix all of them meet, in a larger region each meets the NEAR neighbours with the longest common prefix.
3. Candidates are confirmed on the shingles of their whole texts, compared word by word (no hashes), and confirmed links
   are joined to components.
4. A large region may hide a link between neighbours that are not next to each other (copies that resemble
   the original, but not one another). So each class of a large region next meets the leader of its region,
   the class with the most confirmed links, unless it is in its component already; this goes on until no
   component changes.
5. That is only to leave fewer components. In each large region that still has several, all classes outside its
   largest component then meet all others of the region, block by block: shared shingles are counted by products of
   0/1 matrices, and only links that join components leave a block. So no two classes that share a floor prefix
   in a tree go without comparison, unless they are in one component already.

Regions may hold any share of all rows: what is joined by region is salted, and so are classes with very many pairs.

Defined results: null text is empty; an empty shingle set links with nothing; a null doc_id is never
linked by `link` (component null, kept); rows with equal doc_id are one node of the graph, and each is returned;
repeated rows, ties and further columns (of any name) change nothing; an empty table gives an empty one. See
`deduplicate` for what it does with null doc_ids and repeated rows. The session's Arrow batch limits are set (shared.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import textkit as tk
from quillspark.llm.shared import bloom_has, bloom_of, fresh, materialise, ship_package

TREES, DEPTH, FLOOR = 16, 8, 3
SMALL, NEAR = 16, 3
#: About so many classes, and so many bytes of them, are one block of a large region; columns of one product.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 6 << 20, 4096
#: Parts that each region is dealt to in joins, and pairs of one class that a task takes.
SALTS, PAIRS = 64, 4096
#: Links that one task joins to components.
BLOCK_LINKS = 1 << 18
#: Rows of one region that a task holds at once; the rest of the region goes on as a large one.
HELD = 1 << 16

_salts = tk.mix(np.arange(1, TREES * DEPTH + 1, dtype=tk.U) * tk.U(0xA24BAED4963EE407))
MULTIPLY = (_salts & tk.U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
CHANGE = (_salts >> tk.U(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, size (bytes), words (digest of the word sequence), labels (for each tree DEPTH big-endian hashes)."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(batches):
            column = tk.texts(batch.column("text"))
            words = tk.Words(column, lower=True)
            names, codes, offsets = tk.shingles(words)
            n = len(offsets) - 1
            sizes = np.bincount(tk.distinct(names, offsets)[0], minlength=n)
            full = np.flatnonzero(sizes > 0)
            least = np.zeros((n, TREES * DEPTH), dtype=">u4")
            if len(full):
                x = (codes >> tk.U(16)).astype(np.uint32)
                at = offsets[:-1][full]
                for k in range(TREES * DEPTH):
                    least[full, k] = np.minimum.reduceat((x ^ CHANGE[k]) * MULTIPLY[k], at)
            data, starts, ends = words.joined()
            raw = data.tobytes()
            digests = [hashlib.blake2b(raw[starts[a] : ends[b - 1]] if b > a else b"", digest_size=16).digest() for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
            flat = least.tobytes()
            width = 4 * TREES * DEPTH
            labels = [flat[k * width : (k + 1) * width] if sizes[k] else None for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.diff(tk.buffer(column)[1])), pa.array(digests, pa.binary()), pa.array(labels, pa.binary())], names=["doc_id", "n_shingles", "size", "words", "labels"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, size long, words binary, labels binary")


def _pairs_in(tree: np.ndarray, label: np.ndarray, rep: np.ndarray, size: np.ndarray, percent: int, large_before: bool, fresh: int):
    """Candidate pairs of sorted rows, less those whose set sizes rule a link out; pairs of two rows before `fresh` were given already. Also: rows in large regions."""
    n = len(rep)
    same = np.zeros(n, dtype=bool)
    same[1:] = (tree[1:] == tree[:-1]) & (label[1:, :FLOOR] == label[:-1, :FLOOR]).all(axis=1)
    region = np.cumsum(~same)
    large = np.bincount(region)[region] > SMALL
    if large_before:
        large |= region == region[0]
    a, b = [], []
    for k in range(1, min(SMALL, n)):
        i = np.arange(max(0, fresh - k), n - k)
        ok = (region[i] == region[i + k]) & (~large[i] | (k <= NEAR))
        ok &= 100 * np.minimum(size[i], size[i + k]) >= percent * np.maximum(size[i], size[i + k])
        if not ok.any():
            continue
        a.append(rep[i[ok]])
        b.append(rep[i[ok] + k])
    a = np.concatenate(a) if a else rep[:0]
    b = np.concatenate(b) if b else rep[:0]
    return np.minimum(a, b), np.maximum(a, b), large


def candidates(reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs a < b of classes; rows region, rep of the classes in large regions)."""
    width = 4 * DEPTH
    trees = reps.select("rep", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("labels"), t * width + 1, F.lit(width)))).alias("tree", "label"))
    sorted_rows = trees.repartition("tree", F.substring("label", 1, 4 * FLOOR)).sortWithinPartitions("tree", "label", "rep")

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large_before, fresh = False, 0

        def give(table: pa.Table, large_before: bool, fresh: int):
            tree = table.column("tree").to_numpy()
            rep = table.column("rep").to_numpy()
            raw, _ = tk.buffer(table.column("label").combine_chunks().cast(pa.large_binary()))
            label = raw.reshape(-1, width).view(">u4").astype(np.uint32)
            a, b, large = _pairs_in(tree, label, rep, table.column("n").to_numpy(), percent, large_before, fresh)
            name = tk.keyed_hashes(raw, np.arange(len(rep)) * width, np.arange(len(rep)) * width + 4 * FLOOR) ^ tk.mix(tree.astype(tk.U) + tk.U(1))
            mine = large & (np.arange(len(rep)) >= fresh)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=["region", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(name[mine].view(np.int64)), pa.array(rep[mine]), pa.nulls(int(mine.sum()), pa.int64())], names=["region", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            tree = table.column("tree").to_numpy()
            heads = np.array([x[: 4 * FLOOR] for x in table.column("label").to_pylist()], dtype=f"S{4 * FLOOR}")
            last = np.flatnonzero((tree == tree[-1]) & (heads == heads[-1]))
            cut = int(last[0])
            if len(last) > HELD:  # one region: give what is there, keep the rows that later ones may meet
                yield from give(table, large_before, fresh)
                keep = SMALL
                held, large_before, fresh = table.slice(len(tree) - keep).to_batches(), True, keep
            elif cut > 0:
                yield from give(table.slice(0, cut), large_before, min(fresh, cut))
                held, large_before, fresh = table.slice(cut).to_batches(), False, 0
        if held:
            yield from give(pa.Table.from_batches(held), large_before, fresh)

    found = materialise(sorted_rows.mapInArrow(scan, "region long, a long, b long"), "forest")
    pairs = found.filter("region is null and a < b").select("a", "b").distinct()
    return pairs, found.filter("region is not null").select("region", F.col("a").alias("rep")).distinct()


def class_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents named by ids(id)."""
    bloom = bloom_of(ids, ids.count())
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    if bloom is not None:

        @tk.tidy
        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(bloom_has(bloom.value, batch.column("id").to_numpy().astype(tk.U))))

        mine = mine.mapInArrow(prune, "id long, text string")
    return mine.join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b with 100 * shared >= percent * united. A class with over PAIRS pairs is dealt to several tasks."""

    @tk.tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.pieces(tk.pieces(batches, "x"), "y"):
            x, y, both = tk.shared(tk.texts(batch.column("x")), tk.texts(batch.column("y")))
            yield batch.select(["a", "b"]).filter(pa.array((both > 0) & (100 * both >= percent * (x + y - both))))

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts")).filter("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    left = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("x")).join(many, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    two = left.join(right, ["a", "salt"]).join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _joins_in(row: np.ndarray, name: np.ndarray, c: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that links between rows `one` and rows `two` (masks) join, less those that follow from the rest. row, name: the different shingles of all rows."""
    sizes = np.bincount(row, minlength=len(c))
    column = np.unique(name, return_inverse=True)[1]
    same = bool((one & two).all())
    many = int(column.max()) + 1 if len(column) else 0
    times = lambda of: np.bincount(column[of[row]], minlength=many)
    shared = np.bincount(column, minlength=many) > 1 if same else (times(one) > 0) & (times(two) > 0)
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = np.flatnonzero(one), np.flatnonzero(two)
    both = np.zeros((len(a), len(b)), dtype=np.float32)  # counts below 2**24 are exact
    total = int(shared.sum())
    for at in range(0, total, COLUMNS):
        width = min(COLUMNS, total - at)
        lo, hi = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(c), width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        both += dense[a] @ dense[b].T
    both = both.astype(np.int64)
    linked = (both > 0) & (100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)) & (c[a][:, None] != c[b][None, :])
    i, j = np.nonzero(linked)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    out = []
    ends = np.unique(np.stack([np.minimum(c[a[i]], c[b[j]]), np.maximum(c[a[i]], c[b[j]])], axis=1), axis=0)
    for x, y in ends.tolist():
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _with_region(members: DataFrame, table: DataFrame) -> DataFrame:
    """members joined with table, one row for each region, in SALTS parts: a region may hold a large share of all classes."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["region", "salt"]).drop("salt")


def region_links(regions: DataFrame, known: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b: components joined by links between classes of one large region, each class outside the region's largest component against all."""
    sizes = reps.groupBy("rep").agg(F.sum("size").alias("n"))
    members = regions.join(known.select(F.col("v").alias("rep"), "c"), "rep", "left").join(sizes, "rep").select("region", "rep", F.coalesce("c", "rep").alias("c"), "n")
    members = materialise(members, "members")
    parts = members.groupBy("region", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    blocks = lambda rows, n: F.ceil(F.greatest(F.lit(1), rows / BLOCK, n / BLOCK_BYTES)).cast("int")
    top = F.max(F.struct("rows", "n", "c"))
    sums = parts.groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), top.alias("top")).filter("rows > top.rows")
    plan = sums.select("region", F.col("top.c").alias("top"), blocks(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("minor"), blocks(F.col("top.rows"), F.col("top.n")).alias("major"))
    # Blocks 0, 1, ... are of the other components, blocks -1, -2, ... of the largest.
    dealt = _with_region(members, plan).withColumn("is_top", F.col("c") == F.col("top"))
    dealt = dealt.withColumn("block", F.when(F.col("is_top"), -1 - F.pmod(F.xxhash64("rep"), "major")).otherwise(F.pmod(F.xxhash64("rep"), "minor")).cast("int"))
    pair = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    minors, majors = F.sequence(F.lit(0), F.col("minor") - 1), F.sequence(F.lit(-1), -F.col("major"), F.lit(-1))
    of_minor = F.concat(F.transform(minors, lambda k: pair(F.least(k, "block"), F.greatest(k, "block"))), F.transform(majors, lambda k: pair(F.col("block"), k)))
    to = F.when(F.col("is_top"), F.transform(minors, lambda k: pair(k, F.col("block")))).otherwise(of_minor)
    rows = dealt.select("region", "rep", "c", "block", F.explode(to).alias("to")).select("region", "to.x", "to.y", "rep", "c", "block")

    def scan(key, table):  # without hints: Spark reads them
        names, _, offsets = tk.shingles(tk.Words(tk.texts(table.column("text")), lower=True))
        block = table.column("block").to_numpy()
        one, two = block == key[1].as_py(), block == key[2].as_py()
        joins = _joins_in(*tk.distinct(names, offsets), table.column("c").to_numpy(), one, two, percent) if one.any() and two.any() else []
        return pa.table({"a": pa.array([a for a, _ in joins], pa.int64()), "b": pa.array([b for _, b in joins], pa.int64())})

    held = rows.join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    return held.groupBy("region", "x", "y").applyInArrow(scan, "a long, b long")


def _joined_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, to for all nodes of the links a, b of one task: to is the smallest id that v is connected with."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            u, v = find(x), find(y)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["v", "to"])


def components(links: DataFrame) -> DataFrame:
    """v, c: for each end of a link the smallest id that it is connected with.

    Contraction in random order: in each round every node has a new random rank, hooks to its least neighbour if that
    ranks below it, hooks are followed to their ends by pointer doubling, and links are renamed to the ends. Of any nodes
    with links at most half are expected to rank below all their neighbours, so the rounds are logarithmic in the
    nodes, and chains of hooks are short. Least neighbours are combined map-side, so a node with very many links is one
    sum. The first round ranks by id, which ends most graphs at once. As soon as what is left fits a block of BLOCK_LINKS
    links, one task joins it.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("c", F.col("v"))
    rename = lambda df, table: df.join(table.select(F.col("v").alias("c"), "to"), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    rounds = 0
    while edges.count() > BLOCK_LINKS:
        rank = (lambda x: F.col(x)) if not rounds else (lambda x, k=rounds: F.xxhash64(F.lit(k), x))
        place = lambda x: F.struct(rank(x).alias("rank"), F.col(x).alias("to"))
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = both.groupBy("v").agg(F.min(place("w")).alias("least"))
        hooks = materialise(least.filter(F.col("least") < place("v")).select("v", F.col("least.to").alias("to")), "hooks")
        twice = lambda h: h.join(h.select(F.col("v").alias("to"), F.col("to").alias("on")), "to", "left").select("v", F.coalesce("on", "to").alias("to"))
        while not hooks.join(hooks.select(F.col("v").alias("to")), "to", "left_semi").isEmpty():
            hooks = materialise(twice(twice(hooks)), "hooks")
        nodes = rename(nodes, hooks)
        one = edges.join(hooks.select(F.col("v").alias("a"), "to"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        two = one.join(hooks.select(F.col("v").alias("b"), "to"), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        edges = materialise(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
        rounds += 1
    last = edges.repartition(1).mapInArrow(_joined_in_block, "v long, to long")
    if not rounds:
        return materialise(last.withColumnRenamed("to", "c"), "labels")
    nodes = materialise(rename(nodes, last), "labels")
    return materialise(nodes.join(nodes.groupBy("c").agg(F.min("v").alias("least")), "c").select("v", F.col("least").alias("c")), "labels")


def _stars(known: DataFrame) -> DataFrame:
    """The links of known components, one for each member."""
    return known.filter("v <> c").select(F.col("c").alias("a"), F.col("v").alias("b"))


def link(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose shingle sets are percent % alike."""
    ship_package(docs.sparkSession)
    signed = materialise(signatures(docs), "signatures")
    full = signed.filter("doc_id is not null and n_shingles > 0")
    reps = full.groupBy("words").agg(F.min("doc_id").alias("rep"), F.first("labels").alias("labels"), F.max("n_shingles").alias("n"), F.max("size").alias("size"))
    reps = materialise(reps, "classes")
    pairs, regions = candidates(reps.select("rep", "labels", "n"), percent)
    pairs = materialise(pairs, "pairs")
    regions = materialise(regions, "regions")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(regions.select(F.col("rep").alias("id"))).distinct()
    texts = materialise(class_texts(docs, materialise(ids, "ids")), "texts")
    # Rows that share a doc_id but not their words are one node: its classes are linked outright.
    twins = full.select("doc_id", "words").distinct().join(reps.select("words", "rep"), "words").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = materialise(confirm(pairs, texts, percent), "confirmed")
    tried = pairs
    known = components(links)
    large = not regions.isEmpty()
    while large:
        # Of each class its links and its component, so that a region's rows look both up at once.
        ends = links.select(F.explode(F.array("a", "b")).alias("rep"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("c"))
        nodes = ends.unionByName(known.select(F.col("v").alias("rep"), F.lit(0).alias("n"), "c")).groupBy("rep").agg(F.sum("n").alias("n"), F.max("c").alias("c"))
        members = materialise(regions.join(nodes, "rep", "left").select("region", "rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", "rep").alias("c")), "members")
        # Components only grow, so a region that lies in one component is done with; the others go on.
        leaders = members.groupBy("region").agg(F.max(F.struct("n", (-F.col("rep")).alias("minus"), "c")).alias("l"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
        waiting = materialise(_with_region(members, leaders.select("region", (-F.col("l.minus")).alias("leader"), F.col("l.c").alias("lc"))), "waiting")
        regions = waiting.select("region", "rep")
        more = waiting.filter("c <> lc").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        more = materialise(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        found = materialise(confirm(more, texts, percent), "confirmed")
        tried = tried.unionByName(more)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        known = components(_stars(known).unionByName(found))
    if large:
        joins = materialise(region_links(regions, known, reps, texts, percent).distinct(), "joins")
        if not joins.isEmpty():
            known = components(_stars(known).unionByName(joins))
    # Copies hang on their class; classes hang on their component.
    joined = known if twins.isEmpty() else components(_stars(known).unionByName(twins))
    of_class = reps.select("words", "rep").join(joined.select(F.col("v").alias("rep"), "c"), "rep", "left").select("words", F.coalesce("c", "rep").alias("class"))
    linked = full.select("doc_id", "n_shingles", "words").join(materialise(of_class, "classes"), "words").select("doc_id", "n_shingles", F.col("class").alias("component_id"))
    alone = signed.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the first of its component, with all their columns; of rows with equal doc_id and text one stays.

    Rows with null doc_id take part under a key made from their text, behind all others; ids are less than 2**62.
    """
    key, copy = fresh(docs, "quill_key", "quill_copy")
    own = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)))
    gone = link(own.select(F.col(key).alias("doc_id"), "text"), percent).filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    order = Window.partitionBy(key, F.md5(F.coalesce("text", F.lit("")))).orderBy(key)
    return own.join(gone, key, "left_anti").withColumn(copy, F.row_number().over(order)).filter(F.col(copy) == 1).select(docs.columns)
