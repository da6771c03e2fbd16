"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each distinct set of word n-grams has a signature of ``trees * depth`` minimum hashes.  A tree is the
prefix trie of one stretch of ``depth`` of them, kept as its sorted branches: rows are dealt by tree
and by the shortest prefix that may be needed, and sorted by branch, so that what shares a prefix of
any length stands side by side.

Matches begin with whole branches and the prefixes are shortened level by level.  What a set has
matched so far tells how close its neighbours are, and so which part of them prefixes of this length
find in all trees together; once that reaches the target recall, the set stops asking for shorter
ones.  A set without matches goes down to the length at which a pair just at the threshold still
meets in some tree with the target recall.

Copies (equal sets) are one row from the start.  A pair is judged in the tree where it shares the
longest prefix, so that each link counts once although no pair is ever shuffled: the tasks send one
row per member, with its count of links and one link of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, rows_of, shingle_hashes, stored, word_hashes
from .components import connected_components

TREES, DEPTH = 20, 7
BLOCK_ROWS, BLOCK_ITEMS = 400, 2_000_000  # of a block of a large trie node
NODE_ROWS, NODE_BYTES = 4096, 32_000_000  # of whole nodes that are held at once
PAIRS = 50_000  # compared at once
SLACK = 0.25  # signatures that agree in less than the threshold minus this rule a pair out (over six deviations)

MARGIN = 0.1  # below the threshold down to which matches speak of links that may be missed (three deviations)


def prefix_depth(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with this probability."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The n smallest hashes of a set, each under a permutation of its own, 16 bits each."""
    a, b = _permutations(n)
    best = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(best, (shingles[at : at + 256, None] * a + b).min(axis=0), out=best)
    return (mix64(best) >> np.uint64(48)).astype(">u2")  # bytes in this order sort as the numbers do


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return np.array([mix64(shingles).sum(), mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum()], dtype=np.uint64).tobytes()


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, the key of its n-gram set (null: no word), its size and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sizes, sigs = [], [], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "set_key", "size", "sig"])
            for x in (ids, keys, sizes, sigs):
                x.clear()
            return out

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            shingles = shingle_hashes(word_hashes(text or ""), n)
            ids.append(doc_id)
            sizes.append(len(shingles))
            keys.append(set_key(shingles) if len(shingles) else None)
            sigs.append(signature(shingles, TREES * DEPTH).tobytes() if len(shingles) else None)
            if len(ids) == 2048:
                yield batch()
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_key binary, size long, sig binary")


class Members:
    """Rows of trie nodes as arrays: the members of whole nodes, side by side, sorted by branch."""

    def __init__(self, batch: pa.RecordBatch, trees: int, depth: int, short: int, recall: float):
        col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        self.trees, self.depth, self.short, self.recall = trees, depth, short, recall
        self.node = np.stack([col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tree", "path", "cell")], axis=1)
        self.tree, self.block, self.rep, self.copies, self.size = (col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("tree", "block", "rep", "copies", "size"))
        self.sig = np.frombuffer(b"".join(col["sig"].to_pylist()), dtype=np.uint16).reshape(batch.num_rows, TREES, DEPTH)[:, :trees, :depth]
        self.key = col["set_key"]
        self.items = [np.frombuffer(x, dtype=np.uint64) for x in col["items"].to_pylist()] if "items" in col else None

    def ends(self) -> np.ndarray:
        """For each length of prefix (0: the node) and each row, where the rows that share it end."""
        n = len(self.node)
        branch = self.sig[np.arange(n), self.tree]
        same = np.zeros((self.depth + 1, n), dtype=bool)  # as the next row
        same[0, :-1] = (self.node[1:] == self.node[:-1]).all(axis=1)
        for d in range(1, self.depth + 1):
            same[d, :-1] = same[d - 1, :-1] & (branch[1:, d - 1] == branch[:-1, d - 1])
        out = np.where(same, n, np.arange(1, n + 1))
        return np.minimum.accumulate(out[:, ::-1], axis=1)[:, ::-1]

    def pairs(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of each row with those from ``low`` to ``high``, some at a time, of which one at least is wanted."""
        left, right, n = [], [], 0
        for i in np.flatnonzero(high > low).tolist():
            j = np.arange(low[i], high[i])
            if not wanted[i]:
                j = j[wanted[j]]
            left.append(np.full(len(j), i))
            right.append(j)
            n += len(j)
            if n >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
        if n:
            yield np.concatenate(left), np.concatenate(right)

    def meets(self, s: np.ndarray, d: int) -> np.ndarray:
        """The probability that sets of this similarity share a prefix of a length in some tree."""
        return 1 - (1 - s**d) ** self.trees

    def links(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs to be judged here that are links; without the sets, those that may be.

        How close matches are is estimated by their signatures, so that both ways stop alike."""
        ends, n = self.ends(), len(self.node)
        asking = np.ones(n, dtype=bool)
        found, missed = np.zeros((self.depth + 1, n)), np.zeros((self.depth + 1, n))
        for d in range(self.depth, self.short - 1, -1):
            low = np.arange(1, n + 1) if d == self.depth else ends[d + 1]
            for a, b in self.pairs(low, ends[d], asking):
                # a cell of two blocks of a large node judges what lies across them, a cell of one block the rest
                two = self.node[a, 2] // 65536 != self.node[a, 2] % 65536
                keep = (~two | (self.block[a] != self.block[b])) & (np.minimum(self.size[a], self.size[b]) >= threshold * np.maximum(self.size[a], self.size[b]) - 1e-9)
                a, b = a[keep], b[keep]
                equal = self.sig[a] == self.sig[b]
                close = equal.mean(axis=(1, 2))
                keep = close >= threshold - SLACK
                a, b, equal, close = a[keep], b[keep], equal[keep], close[keep]
                # matches as a sample of the neighbours: each stands for as many as its chance to be met in one tree says
                near = close >= threshold - MARGIN
                for k in range(self.short, d + 1):
                    every = close[near] ** -float(k)
                    lost = every * (1 - self.meets(close[near], k))
                    for side in (a[near], b[near]):
                        found[k] += np.bincount(side, every, n)
                        missed[k] += np.bincount(side, lost, n)
                shared = np.logical_and.accumulate(equal, axis=2).sum(axis=2)
                keep = shared.argmax(axis=1) == self.tree[a]  # the first of the longest
                a, b = a[keep], b[keep]
                if self.items is not None and len(a):
                    both = self.shared(a, b)
                    keep = both >= threshold * (self.size[a] + self.size[b] - both) - 1e-9
                    a, b = a[keep], b[keep]
                if len(a):
                    yield a, b
            asking &= (found[d] == 0) | (missed[d] > (1 - self.recall) * found[d])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of pairs of sets; a is in ascending order."""
        used = np.unique(np.concatenate((a, b)))
        words, ids = np.unique(np.concatenate([self.items[i] for i in used]), return_inverse=True)
        own = dict(zip(used.tolist(), np.split(ids, np.cumsum([len(self.items[i]) for i in used])[:-1])))
        marked, out = np.zeros(len(words), dtype=bool), np.empty(len(a), dtype=np.int64)
        edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))).tolist()
        for i, j in zip(edges[:-1], edges[1:]):
            marked[own[int(a[i])]] = True
            others = [own[x] for x in b[i:j].tolist()]
            out[i:j] = np.add.reduceat(marked[np.concatenate(others)], np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
            marked[own[int(a[i])]] = False
        return out


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of trie nodes, regrouped so that no node is cut."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            if sum(b.num_rows for b in held) < NODE_ROWS and sum(b.nbytes for b in held) < NODE_BYTES:
                continue
            now = joined()
            node = np.stack([now.column(now.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("tree", "path", "cell")], axis=1)
            edges = np.flatnonzero((node[1:] != node[:-1]).any(axis=1))
            held = [now]
            if len(edges):
                yield now.slice(0, int(edges[-1]) + 1)
                held = [now.slice(int(edges[-1]) + 1)]
    if sum(b.num_rows for b in held):
        yield joined()


def similarity_classes(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, class_id, n_links, copy_of, n_copies.

    Words are runs of letters, digits and underscores in lower case; a text of fewer than n words is
    one n-gram, and a text without words (or null) is linked to nothing.  class_id is the smallest
    doc_id that chains of links of Jaccard similarity >= threshold reach (found with the given recall); n_links counts the
    documents linked directly, copies included; copy_of is the smallest doc_id with the same n-grams
    and n_copies the number of such documents.  Rows that repeat a doc_id count as copies or links
    of each other like any others.  A null doc_id takes no part and has a null class.  Other columns
    are ignored."""
    if not 0 < threshold <= 1 or trees > TREES or depth > DEPTH:
        raise ValueError("threshold must be in (0, 1], trees and depth at most the signature's")
    short = prefix_depth(threshold, recall, trees, depth)
    prints = stored(fingerprints(docs.filter(F.col("doc_id").isNotNull()), n), "fingerprints")
    # equal sets are one from here on: rep stands for all its copies
    reps = stored(prints.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")), "sets")

    # the trie nodes at the shortest prefix that more than one set reaches
    def branch(n: int) -> Column:
        return F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * n})")

    paths = reps.select("set_key", "size", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig")
    paths = paths.select("set_key", "size", "tree", F.xxhash64("tree", branch(short)).alias("path"))
    nodes = paths.groupBy("tree", "path").agg(F.count("*").alias("members"), F.sum("size").alias("items")).filter("members > 1")
    # a large node is cut into blocks, and each pair of blocks is a cell of its own
    nodes = nodes.select("tree", "path", F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("items") / BLOCK_ITEMS)).alias("blocks"))
    member = paths.join(nodes, ["tree", "path"]).select("tree", "path", "set_key", "blocks", F.pmod(F.xxhash64("set_key"), "blocks").alias("block"))
    member = member.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("tree", "path", (F.least("block", "with") * 65536 + F.greatest("block", "with")).alias("cell"), "block", "set_key")
    member = member.join(reps, "set_key").select("tree", "path", "cell", "block", "set_key", "rep", "copies", "size", "sig")

    def by_node(df: DataFrame) -> DataFrame:
        # ranges hold about as many rows each, whatever the sizes of the cells; a cell is never cut
        return df.repartitionByRange("tree", "path", "cell").sortWithinPartitions("tree", "path", "cell", branch(depth))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members that may have a link to be judged in their cell."""
        for batch in whole_nodes(batches):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, b in Members(batch, trees, depth, short, recall).links(threshold):
                keep[a] = keep[b] = True
            yield batch.filter(pa.array(keep))

    likely = stored(by_node(member).mapInArrow(screen, member.schema), "likely")

    # the sets themselves, only of what is left
    # the list of them grows with the documents and is never broadcast
    wanted = docs.select("doc_id", "text").join(likely.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            shingles = shingle_hashes(word_hashes(text or ""), n)
            if len(shingles):
                yield pa.RecordBatch.from_arrays([pa.array([set_key(shingles)], pa.binary()), pa.array([shingles.tobytes()], pa.binary())], names=["set_key", "items"])

    items = wanted.mapInArrow(sets, "set_key binary, items binary").dropDuplicates(["set_key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each member: the documents linked to it here, and a link of a spanning forest."""
        for batch in whole_nodes(batches):
            m = Members(batch, trees, depth, short, recall)
            links, root, group = np.zeros(batch.num_rows, dtype=np.int64), list(range(batch.num_rows)), np.arange(batch.num_rows)

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in m.links(threshold):
                links += np.bincount(a, m.copies[b], len(links)).astype(np.int64) + np.bincount(b, m.copies[a], len(links)).astype(np.int64)
                apart = group[a] != group[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                    root[top(y)] = top(x)
                if apart.any():
                    group = np.array([top(x) for x in range(batch.num_rows)])
            found = np.flatnonzero(links)
            other = m.rep[[top(x) for x in found.tolist()]] if len(found) else m.rep[:0]
            yield pa.RecordBatch.from_arrays([m.key.take(pa.array(found)), pa.array(m.rep[found]), pa.array(links[found]), pa.array(other)], names=["set_key", "rep", "links", "other"])

    judged = by_node(likely.join(items, "set_key")).mapInArrow(verify, "set_key binary, rep long, links long, other long")
    judged = stored(judged, "judged")

    groups = connected_components(judged.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    linked = judged.groupBy("set_key").agg(F.sum("links").alias("links"))
    known = reps.select("set_key", "rep", "copies").join(linked, "set_key", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("set_key", F.col("rep").alias("copy_of"), F.col("copies").alias("n_copies"), F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # copies make a skewed join key, which Spark can split against a table that is read, not made, there
    out = prints.select("doc_id", "set_key").join(stored(known, "classes"), "set_key", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    none = F.lit(None).cast("long")
    return out.union(docs.filter(F.col("doc_id").isNull()).select(none, none, F.lit(0).cast("long"), none, F.lit(1).cast("long")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each class, every column kept.

    Of rows that repeat a doc_id one stays; rows without a doc_id all stay."""
    found = similarity_classes(docs, **options).filter("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.union(docs.filter(F.col("doc_id").isNull()))
