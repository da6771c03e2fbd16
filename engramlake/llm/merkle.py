"""Merkle dataset manifest: every document is a leaf, every source a tree, and one root covers all.

Nodes are digests as lowercase hex text.  The nodes of a tree are cut into aligned blocks, and a block
keeps each of its levels as one concatenated string of digests.  The parents of a level are the hashes
of its fixed-width substrings (``fanout`` digests each), and what flanks a node's own digest in its
substring are its siblings, so that building, proving and verifying are SQL functions on strings.  The
roots of a tree's blocks are the nodes of the same problem, a block's size smaller, and recurse until a
tree has one block; the roots of the trees, in order of their source, are the nodes of the last tree.

No row holds more than a block (``fanout ** BLOCK_LEVELS`` digests).  Texts are hashed where they are
read, and only digests are sorted.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

FANOUT = 16
WIDTH = 64  # hex digits of a digest
BLOCK_LEVELS = 2  # levels that a block keeps below its root
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 4_000  # blocks or trees, with paths of a few kB each, of which the other side of a join may be sent to all


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def framed(value: Column) -> Column:
    """`-` if null, else the count of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return digest(F.concat(*(framed(text if name == "text" else F.col(name)) for name in FIELDS)))


def tampered_rows() -> Column:
    """Rows whose text is tampered with in the drill: 5 divides the crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """With ``n``, a row's place (from 0) in the order of ``by``, which nulls begin.

    Rows are dealt by ranges, numbered in each, and the counts of the ranges before are added: no
    window sees all rows.  The ranges are written once, so that no later read can deal them anew."""
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))  # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(counts), "_part").withColumn("n", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def sized(small: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def parents(level: Column, fanout: int) -> Column:
    """The next level's string: hashes of the fixed-width substrings of this one's."""
    wide = fanout * WIDTH
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / wide).cast("int"))
    return F.array_join(F.transform(runs, lambda k: digest(F.substring(level, k * wide + 1, F.lit(wide)))), "")


def flanks(level: Column, at: Column, fanout: int) -> Column:
    """What stands left and right of digest ``at`` in its substring: its siblings, in order."""
    wide = fanout * WIDTH
    first = F.floor(at / fanout).cast("int") * wide
    own = (at % fanout).cast("int") * WIDTH
    run = F.substring(level, first + 1, F.lit(wide))
    return F.struct(F.substring(run, F.lit(1), own).alias("left"), F.substring(run, own + WIDTH + 1, F.lit(wide)).alias("right"))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings, level by level, lead to."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def blocks_of(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """``nodes(tree, size, place, node, *carried)`` of trees with ``size`` nodes to one row a block: its
    items in order and its levels from below, the last of which is one digest.

    A tree of several blocks has full ones and a last one, all folded by the same number of levels; the
    only block of a tree is folded until one node remains, and one node by none."""
    span = fanout**BLOCK_LEVELS
    item = F.struct(F.col("place"), F.col("node"), *carried)
    rows = nodes.groupBy("tree", F.floor(F.col("place") / span).alias("block")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("level0", F.array_join(F.col("items.node"), ""))
    for k in range(BLOCK_LEVELS):
        below = F.col(f"level{k}")
        # a level is folded if the tree still has several nodes there
        rows = rows.withColumn(f"level{k + 1}", F.when(F.col("size") > fanout**k, parents(below, fanout)))
    levels = F.filter(F.array(*(f"level{k}" for k in range(BLOCK_LEVELS + 1))), lambda s: s.isNotNull())
    return rows.select("tree", "block", "size", "items", levels.alias("levels"))


def own_path(levels: Column, at: Column, fanout: int) -> Column:
    """Siblings on the way from place ``at`` of a block to the block's root."""
    return F.transform(F.slice(levels, 1, F.size(levels) - 1), lambda level, k: flanks(level, F.floor(at / F.pow(F.lit(fanout), k)).cast("int"), fanout))


def tree_roots(nodes: DataFrame, fanout: int, *carried: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks of all trees, of each tree its root, and of each block the siblings above it.

    Each turn writes a table of blocks, of which there are ``fanout ** BLOCK_LEVELS`` times fewer than
    nodes; it ends when every tree has one block."""
    span, turns, roots = fanout**BLOCK_LEVELS, [], []
    while True:
        blocks = stored(blocks_of(nodes, fanout, *(carried if not turns else ())), "blocks")
        turns.append(blocks)
        tops = blocks.select("tree", F.col("block").alias("place"), "size", F.element_at("levels", -1).alias("node"))
        roots.append(tops.filter(F.col("size") <= span).select("tree", F.col("node").alias("subroot")))
        more = tops.filter(F.col("size") > span)
        if more.isEmpty():
            break
        nodes = more.withColumn("size", F.ceil(F.col("size") / span))
    above = None
    for blocks in reversed(turns[1:]):
        below = blocks.select("tree", "block", "levels", F.explode("items.place").alias("place"))
        here = below.select("tree", F.col("block").alias("_block"), F.col("place").alias("block"), own_path(F.col("levels"), (F.col("place") % span).cast("int"), fanout).alias("path"))
        if above is not None:
            up = above.select("tree", F.col("block").alias("_block"), F.col("path").alias("_up"))
            here = here.join(sized(up), ["tree", "_block"], "left").withColumn("path", F.concat("path", F.coalesce("_up", no_path())))
        above = stored(here.select("tree", "block", "path"), "above")
    every = roots[0]
    for some in roots[1:]:
        every = every.unionByName(some)
    if above is None:
        above = turns[0].limit(0).select("tree", "block", no_path().alias("path"))
    return turns[0], stored(every, "roots"), above


def no_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def manifest(docs: DataFrame, *, fanout: int = FANOUT) -> DataFrame:
    """Of each document: doc_id, source, leaf, subroot, root, proof_sha256 (of the siblings from leaf
    to root, left to right), folded_root (from the tampered leaf where the drill tampers, else the
    leaf, and the original siblings), tampered, and verified (folded_root is the root).

    Nulls are framed as `-` and an empty text as `0:`.  A null source is a tree of its own, the first;
    rows without doc_id come first in their tree and are never tampered with.  Rows that repeat a
    doc_id in a source follow the order of their leaves; equal rows are leaves of their own.  Other
    columns are left alone; an empty table gives no row."""
    changed = F.when(tampered_rows(), leaf(F.translate("text", UPPER, LOWER)))
    hashed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(F.col("text")).alias("leaf"), changed.alias("changed")), "leaves")

    # a document's place in its tree, and the tree's place among all
    placed = numbered(hashed, "source", "doc_id", "leaf")
    trees = stored(placed.groupBy("source").agg(F.min("n").alias("first"), F.count("*").alias("size")), "trees")
    trees = stored(numbered(trees, "source").withColumnsRenamed({"n": "tree", "source": "_source"}), "numbered_trees")
    nodes = placed.join(sized(trees), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    nodes = nodes.select("tree", "size", (F.col("n") - F.col("first")).alias("place"), F.col("leaf").alias("node"), "doc_id", "changed")
    blocks, subroots, above = tree_roots(nodes, fanout, "doc_id", "changed")

    # the tree of trees: its leaves are the subroots
    count = trees.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).alias("size"), F.col("tree").alias("place"), F.col("subroot").alias("node"))
    top_blocks, top_root, top_above = tree_roots(tops, fanout)
    span = fanout**BLOCK_LEVELS
    top_up = top_above.select("block", F.col("path").alias("_up"))
    last = top_blocks.select("block", "levels", F.explode("items").alias("item")).join(sized(top_up), "block", "left")
    last = last.select(
        F.col("item.place").alias("tree"),
        F.col("item.node").alias("subroot"),
        F.concat(own_path(F.col("levels"), (F.col("item.place") % span).cast("int"), fanout), F.coalesce("_up", no_path())).alias("_last"),
    )
    root = top_root.select(F.col("subroot").alias("root"))  # one row
    last = stored(last.crossJoin(F.broadcast(root)), "tops")
    names = trees.select("tree", F.col("_source").alias("source"))
    last = sized(stored(last.join(sized(names), "tree"), "named_tops"))

    whole = blocks.join(sized(above), ["tree", "block"], "left").join(last, "tree")
    whole = whole.withColumn("_above", F.concat(F.coalesce("path", no_path()), "_last"))

    def proven(item: Column) -> Column:
        path = F.concat(own_path(F.col("levels"), (item["place"] % span).cast("int"), fanout), F.col("_above"))
        proof = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
        return F.struct(item["doc_id"].alias("doc_id"), item["node"].alias("leaf"), digest(proof).alias("proof_sha256"), folded(F.coalesce(item["changed"], item["node"]), path).alias("folded_root"), item["changed"].isNotNull().alias("tampered"))

    out = whole.select("source", "subroot", "root", F.explode(F.transform("items", proven)).alias("d"))
    return out.select("d.doc_id", "source", "d.leaf", "subroot", "root", "d.proof_sha256", "d.folded_root", "d.tampered", (F.col("d.folded_root") == F.col("root")).alias("verified"))
