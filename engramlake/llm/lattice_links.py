"""Embedding near-duplicates by lattice hashing.

Directions are projected at random to eight dimensions and decoded to the nearest point of the lattice
E8, in several tables (larger collections use several such points a table).  Near vectors mostly decode to
the same point or to neighbouring ones, so besides its own cell a vector enters the neighbouring cells
that lie closest to it.  Vectors that meet in a cell, at least one of them at home there, are compared by
cosine, in double precision.

Equal vectors are one node with a count.  A cell with many nodes is dealt into blocks, whose pairs
are cells of their own, so memory is bounded, nothing is capped, and no pair is ever written: a cell
sends of each node with links their number and one link of a spanning forest.  A pair is counted in the
first cell in which it meets, which its vectors' codes tell.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, mix64, stored
from .components import connected_components

THRESHOLD, RECALL = 0.95, 0.998  # recall of a pair right at the threshold; nearer pairs are surer
BLOCK = 2048  # nodes of a cell that are compared at once
ROWS = 256  # of a block, whose cosines are held at once
ENTRIES_A_TASK = 50_000
HOT_CELLS = 200_000  # cells of several blocks whose sizes may be sent to all tasks
#: Lattice points a table, width of the projection in lattice units, neighbouring cells entered, and up to
#: how many nodes: about 1,000 of them then meet a vector by chance in a cell, if directions are evenly spread.
LADDER = ((1, 1.5, 2, 100_000), (1, 2.0, 2, 1_000_000), (2, 1.5, 4, 20_000_000), (2, 2.0, 4, 500_000_000), (3, 2.0, 8, None))


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point: E8 is D8 and D8 moved by a half in every coordinate."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to a cell's neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


@dataclass(frozen=True)
class Plan:
    """How vectors of one length are hashed."""

    dims: int
    points: int
    width: float
    probes: int
    tables: int

    def projections(self) -> np.ndarray:
        """(table, dims, 8 * points): orthonormal directions, scaled so that directions get the width."""
        rng = np.random.default_rng(20_240_812 + self.dims)
        rank = max(8, self.dims)
        out = []
        for _ in range(self.tables):
            drawn = [np.linalg.qr(rng.normal(size=(rank, rank)))[0] for _ in range(-(-8 * self.points // rank))]
            out.append(np.concatenate(drawn, axis=1)[: self.dims, : 8 * self.points] * np.sqrt(rank / 8) * self.width)
        return np.stack(out)


@lru_cache(maxsize=8)
def _combinations(points: int, choices: int) -> np.ndarray:
    return np.array(list(itertools.product(range(choices), repeat=points)))[1:]


def cells(x: np.ndarray, points: int, probes: int, salt: int) -> np.ndarray:
    """Hashes (row, 1 + probes) of a row's own cell and of the neighbouring cells closest to it."""
    own, cost, step = [], [], []
    r, choices = roots(), probes + 1
    for p in range(points):
        part = x[:, 8 * p : 8 * p + 8]
        e = nearest_e8(part)
        along = (part - e) @ r.T
        best = np.argpartition(-along, choices - 1, axis=1)[:, : choices - 1]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(along, best, 1), axis=1, kind="stable"), 1)
        own.append(e)
        cost.append(np.concatenate([np.zeros((len(x), 1)), 2 - 2 * np.take_along_axis(along, best, 1)], axis=1))
        step.append(np.concatenate([np.zeros((len(x), 1, 8)), r[best]], axis=1))
    combos = _combinations(points, choices)
    total = sum(cost[p][:, combos[:, p]] for p in range(points))
    chosen = combos[np.argsort(total, axis=1, kind="stable")[:, :probes]]  # row, probe, point
    out = np.full((len(x), 1 + probes), np.uint64(salt + 1))
    for p in range(points):
        moved = own[p][:, None] + np.concatenate([np.zeros((len(x), 1, 8)), np.take_along_axis(step[p], chosen[:, :, p][:, :, None], 1)], axis=1)
        for k in range(8):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + (moved[:, :, k] * 2).astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def plan(n: int, dims: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """Points, width and probes by the ladder; as many tables as a simulated pair at the threshold needs."""
    points, width, probes, _ = next(x for x in LADDER if x[3] is None or n <= x[3])
    one = Plan(dims, points, width, probes, 1)
    if dims < 2:
        return one
    rng = np.random.default_rng(7)
    met = []
    for k in range(4):
        a = unit(rng.normal(size=(2000, dims)))
        b = rng.normal(size=(2000, dims))
        b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        b = threshold * a + np.sqrt(1 - threshold**2) * b
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0] @ one.projections()[0]
        met.append(meets(cells(a @ turn, points, probes, 0), cells(b @ turn, points, probes, 0)))
    share = min(max(float(np.mean(met)), 1e-3), 1 - 1e-9)
    return Plan(dims, points, width, probes, max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - share)))))


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes (own cell first) of one table meet: one is at home where the other comes."""
    return (b == a[:, :1]).any(axis=1) | (a == b[:, :1]).any(axis=1)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, v, vec_id (the smallest) and copies: a row for each different vector that can have links."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    v = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    same = v.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    return stored(same.select(F.monotonically_increasing_id().alias("node"), "v", "vec_id", "copies"), "nodes")


def coded(nodes: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """node, copies, v, dims and codes: of each table the own cell and those entered besides, in a row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = kept_by_worker("lattice", tuple(plans.values()), lambda: {d: p.projections() for d, p in plans.items()})
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for d in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == d))
                p = plans[int(d)]
                m = unit(rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
                codes = np.concatenate([cells(m @ turns[int(d)][t], p.points, p.probes, t) for t in range(p.tables)], axis=1)
                wide = codes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * wide, pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_pydict({"node": rows.column("node"), "copies": rows.column("copies"), "v": rows.column("v"), "dims": pa.array(np.full(len(m), d), pa.int32()), "codes": lists})

    kind = nodes.schema["v"].dataType.simpleString()
    return nodes.select("node", "copies", "v").mapInArrow(code, f"node long, copies long, v {kind}, dims int, codes array<long>")


@dataclass
class Block:
    """Nodes of a cell: unit vectors, codes (table, cell) and copies."""

    node: np.ndarray
    unit: np.ndarray
    codes: np.ndarray
    copies: np.ndarray


def compare(a: Block, b: Block | None, cell: int, table: int, wide: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the nodes of two blocks of a cell, or within one: for each node (those of a, then
    of b) the copies linked to it by pairs that meet here first, and the first node of its local
    component; and which nodes have a link."""
    left, other = a.unit, a if b is None else b
    right, codes_a, codes_b, copies_a, copies_b = other.unit, a.codes, other.codes, a.copies, other.copies
    home_a, home_b = codes_a[:, table * wide] == cell, codes_b[:, table * wide] == cell
    n, m = len(left), len(right)
    shift = 0 if b is None else n
    links, label = np.zeros(n + (0 if b is None else m), dtype=np.int64), np.arange(n + (0 if b is None else m))
    for at in range(0, n, ROWS):
        near = left[at : at + ROWS] @ right.T >= threshold
        near &= home_a[at : at + ROWS, None] | home_b
        if b is None:
            near &= np.arange(at, min(n, at + ROWS))[:, None] < np.arange(m)
        i, j = np.nonzero(near)
        i += at
        if not len(i):
            continue
        first = np.ones(len(i), dtype=bool)
        for t in range(table):
            u, v = codes_a[i, t * wide : (t + 1) * wide], codes_b[j, t * wide : (t + 1) * wide]
            first &= ~meets(u, v)
        u, v = codes_a[i, table * wide : (table + 1) * wide], codes_b[j, table * wide : (table + 1) * wide]
        twice = (v == u[:, :1]).any(axis=1) & (u == v[:, :1]).any(axis=1)  # each comes to the other's cell
        first &= ~twice | (np.minimum(u[:, 0], v[:, 0]) == cell)
        np.add.at(links, i[first], copies_b[j[first]])
        np.add.at(links, j[first] + shift, copies_a[i[first]])
        # components of the cell: larger labels are hooked onto smaller ones until no pair is apart
        j = j + shift
        apart = label[i] != label[j]
        while apart.any():
            i, j = i[apart], j[apart]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            parent = np.arange(len(label))
            np.minimum.at(parent, high, low)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
            apart = label[i] != label[j]
    linked = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
    return links, label, linked


def link_counts(codes: DataFrame, plans: dict[int, Plan], entries: int, threshold: float) -> DataFrame:
    """``(node, links, root)``, a row for each node with links in a cell: copies linked to it by pairs
    that meet there first, and a node of the same local component; ``entries`` of vectors in cells there are."""
    wide = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(d), F.lit(p.probes + 1)) for d, p in plans.items())), F.col("dims"))
    entry = F.posexplode("codes").alias("at", "cell")
    table = F.floor(F.col("at") / wide).cast("int").alias("t")
    sizes = codes.select("dims", "codes").select("dims", entry).groupBy("dims", table, "cell").agg(F.count("*").alias("n"), F.count_if(F.col("at") % wide == 0).alias("home"))
    hot = stored(sizes.filter((F.col("n") > BLOCK) & (F.col("home") > 0)).select("dims", "t", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot_cells")
    if hot.count() <= HOT_CELLS:
        hot = F.broadcast(hot)
    rows = codes.withColumn("wide", wide).select("node", "copies", "v", "dims", "codes", "wide", entry)
    rows = rows.withColumn("t", F.floor(F.col("at") / F.col("wide")).cast("int")).join(hot, ["dims", "t", "cell"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
    # a block meets itself and every other: cells (low, high)
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    rows = rows.select("node", "copies", "v", "dims", "codes", "wide", "t", "cell", "block", F.explode(meet).alias("m")).select("*", "m.low", "m.high").drop("m")
    key = ["dims", "t", "cell", "low", "high"]
    tasks = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES_A_TASK))
    rows = rows.repartition(tasks, *key).sortWithinPartitions(*key, "block")

    def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is None and held is None:
                return
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            rows = rows.combine_chunks()
            keys = np.stack([rows.column(k).to_numpy() for k in key], axis=1)
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            whole = len(edges) - 1 if batch is None else len(edges) - 2  # the last cell may go on in the next batch
            held = None if batch is None else rows.slice(edges[whole])
            yield from _cells_of(rows, keys, edges[: whole + 1], threshold)

    return rows.select(*key, "block", "wide", "node", "copies", "v", "codes").mapInArrow(cell_links, "node long, links long, root long")


def _cells_of(rows: pa.Table, keys: np.ndarray, edges: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The links of whole cells, which stand one after the other in a table."""
    column = {c: rows.column(c).to_numpy() for c in ("block", "wide", "node", "copies")}
    lists = {c: rows.column(c).combine_chunks() for c in ("v", "codes")}
    lists = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in lists.items()} if rows.num_rows else {}
    flat = {c: (x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py()) for c, x in lists.items()}

    def block(start: int, end: int) -> Block:
        v, codes = (f[o[start] : o[end]].reshape(end - start, -1) for f, o in (flat["v"], flat["codes"]))
        return Block(column["node"][start:end], unit(v.astype(np.float64)), codes, column["copies"][start:end])

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, end in zip(edges[:-1], edges[1:]):
        _, table, cell, low, high = keys[start]
        if end - start < 2:
            continue
        if low == high:
            a, b = block(start, end), None
        else:
            cut = start + np.searchsorted(column["block"][start:end], high)
            if cut in (start, end):
                continue
            a, b = block(start, cut), block(cut, end)
        links, label, linked = compare(a, b, cell, int(table), int(column["wide"][start]), threshold)
        ids = a.node if b is None else np.concatenate([a.node, b.node])
        out.append((ids[linked], links[linked], ids[label[linked]]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["node", "links", "root"])


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links (other rows linked directly, by a cosine of the threshold or more), component_id
    (the smallest vec_id that links reach) and kept (component_id is the vec_id), a row for each row.

    A pair right at the threshold is found with the given recall, nearer ones more surely; none below
    the threshold is linked.  Only vectors of one length link.  Vectors that are null, empty or zero or
    hold null or non-finite components have no links and are components of their own, as are rows
    without vec_id, whose component_id is null and kept false.  Rows that repeat a vec_id count as rows,
    copies of each other if their vectors are equal.  An empty table gives no row."""
    nodes = nodes_of(vectors)
    sizes = {r["dims"]: r["n"] for r in nodes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}
    plans = {d: plan(n, d, threshold, recall) for d, n in sizes.items()}
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    if not plans:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    entries = sum(sizes[d] * p.tables * (1 + p.probes) for d, p in plans.items())
    found = stored(link_counts(stored(coded(nodes, plans), "codes"), plans, entries, threshold), "cell_links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = nodes.select("node", "vec_id").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = nodes.join(counts, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")).join(least, "component")
    known = stored(known.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "known")
    able = F.col("vec_id").isNotNull()
    out = rows.join(known, (rows["v"] == known["v"]) & able, "left")
    component = F.when(able, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
