"""Vector code compression: product codes whose codebooks are fitted by ball k-means, in integers.

Vectors are cut into equal parts, and each part position has a codebook.  The parts of an entry are a
ball around it, with the farthest part's distance as radius.  Another entry can only win a part of the
ball if it is closer to the centre than twice the radius: such entries are the ball's neighbours, and
all others are left out.  A part closer to its entry than half the way to the nearest neighbour lies in
the stable core and keeps its entry without work; farther out, each neighbour's half way begins an
annular ring, and a part is compared with the neighbours of its own ring and those further in.

All distances are integers, so these bounds are exact, ties included.  A round is one pass over the
vectors and one small sum: tasks send count and sum of each entry, pre-aggregated by batch, and the
driver holds the codebooks alone.  No state of a vector is kept between rounds: a task repeats the rounds
before from the codebooks it was sent, where the balls make each round start from the last one's entries.
Fitting r rounds so costs r passes over the columns read, and r (r + 1) / 2 assignments a vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
ROOM = 2.0**28  # components below ROOM / (scale * sqrt(length of a part)) keep all sums of squares below 2^63
TOGETHER = 65536  # vectors that a task works on at once
BROADCAST_LABELS = 100_000


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of vectors that are not null or empty and hold finite numbers only."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), label, e.alias("embedding"))


def integer_parts(flat: np.ndarray, dims: int, parts: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x) as (part, row, component)."""
    largest = ROOM / (scale * np.sqrt(dims // parts))
    if len(flat) and np.abs(flat).max() > largest:
        raise ValueError(f"components beyond {largest:g} leave no room for exact sums of squares")
    v = np.floor(flat * scale).astype(np.int64).reshape(-1, parts, dims // parts)
    return np.ascontiguousarray(v.transpose(1, 0, 2))


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = points - entry
    return np.einsum("ij,ij->i", d, d)


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each point by comparing all: the first round has no balls yet."""
    best, code = squared(points, book[0]), np.zeros(len(points), dtype=np.int64)
    for j in range(1, len(book)):
        d = squared(points, book[j])
        closer = d < best
        best[closer], code[closer] = d[closer], j
    return code


def reassign(points: np.ndarray, book: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry of each point, beginning with the balls of the entries they had; and the
    number of distances to other entries that were computed."""
    between = np.stack([squared(book, c) for c in book])
    out, work = code.copy(), 0
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(book) + 1))
    for i in range(len(book)):
        members = order[edges[i] : edges[i + 1]]
        if not len(members):
            continue
        own = squared(points[members], book[i])
        # neighbours: half the way to them is within the ball (4 r^2 >= D^2); ties count as within
        near = np.flatnonzero(between[i] <= 4 * own.max())
        near = near[near != i]
        near = near[np.argsort(between[i][near], kind="stable")]
        ring = np.searchsorted(between[i][near], 4 * own, side="right")  # 0 in the stable core
        best, entry = own.copy(), np.full(len(members), i, dtype=np.int64)
        for k, j in enumerate(near):
            rows = np.flatnonzero(ring > k)
            d = squared(points[members[rows]], book[j])
            work += len(rows)
            wins = (d < best[rows]) | ((d == best[rows]) & (j < entry[rows]))
            best[rows[wins]], entry[rows[wins]] = d[wins], j
        out[members] = entry
    return out, work


def assigned(parts: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Codes (part, row) under the last of ``books``, by way of all of them."""
    codes = np.stack([nearest(p, b) for p, b in zip(parts, books[0])])
    for book in books[1:]:
        codes = np.stack([reassign(p, b, c)[0] for p, b, c in zip(parts, book, codes)])
    return codes


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _parts_of(rows: pa.Table, dims: int, parts: int, scale: int) -> np.ndarray:
    flat = rows.column("embedding").combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return integer_parts(flat.flatten().to_numpy(zero_copy_only=False), dims, parts, scale)


def seeds(kept: DataFrame, parts: int, entries: int, scale: int) -> tuple[int, np.ndarray]:
    """The dimension, and the first codebooks: the parts of the rows with the smallest vec_ids."""
    rows = kept.filter("vec_id is not null").orderBy("vec_id", "embedding").limit(entries).collect()
    if not rows:
        return 0, np.empty((parts, 0, 0), dtype=np.int64)
    dims = len(rows[0]["embedding"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    rows = [r["embedding"] for r in rows if len(r["embedding"]) == dims]
    return dims, integer_parts(np.array(rows, dtype=np.float64).ravel(), dims, parts, scale)


def fit(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks (part, entry, component) before and after each round; the last are the final ones."""
    kept = kept_vectors(vectors)
    dims, first = seeds(kept, parts, entries, scale)
    books = [first]
    if not dims:
        return books
    wide = dims // parts
    kept = kept.filter(F.size("embedding") == dims).select("embedding")
    columns = [f"s{k}" for k in range(wide)]
    for _ in range(rounds):
        known = list(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _together(batches):
                cut = _parts_of(rows, dims, parts, scale)
                codes = assigned(cut, known)
                for p in range(parts):
                    count = np.bincount(codes[p], minlength=len(known[0][p]))
                    used = np.flatnonzero(count)
                    total = np.zeros((len(count), wide), dtype=np.int64)
                    np.add.at(total, codes[p], cut[p])
                    data = {"part": np.full(len(used), p), "entry": used, "n": count[used]} | {c: total[used, k] for k, c in enumerate(columns)}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in data.items()})

        found = kept.mapInArrow(sums, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in columns))
        # sums of sums are exact decimals, whatever the number of vectors
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        mean = [F.floor((exact(c) - F.pmod(exact(c), exact("n"))) / exact("n")).cast("long").alias(c) for c in columns]
        new = books[-1].copy()
        for row in found.groupBy("part", "entry").agg(*mean).collect():  # parts x entries rows
            new[row["part"], row["entry"]] = [row[c] for c in columns]
        books.append(new)
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], *, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits an entry, in part order) and error (the squared distances,
    summed over parts) of all kept vectors, under the last of ``books``."""
    parts, entries, wide = books[-1].shape
    kept = kept_vectors(vectors)
    label = kept.schema["label"].dataType.simpleString()
    dims = parts * wide
    kept = kept.filter(F.size("embedding") == dims)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(entries)])
        for rows in _together(batches):
            cut = _parts_of(rows, dims, parts, scale)
            code = assigned(cut, books)
            error = sum(squared(cut[p], books[-1][p][code[p]]) for p in range(parts))
            text = ["".join(c) for c in digits[code.T]]
            for batch in rows.select(["vec_id", "label"]).append_column("code", pa.array(text, pa.string())).append_column("error", pa.array(error, pa.int64())).to_batches(10_000):
                yield batch

    return kept.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def codebooks_digest(book: np.ndarray) -> str:
    """sha256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of a label, null being one) and
    codebooks_sha256 of each vector.

    Left out are vectors that are null or empty or hold null or non-finite components, and those whose
    length isn't that of the vector with the smallest vec_id, which must divide by ``parts``; components
    that leave no room for exact sums (23,170 with the defaults) raise.  With fewer than ``entries`` vectors codebooks are smaller.  Rows that repeat a
    vec_id are encoded each, and as seeds taken in the order of their components; rows without vec_id are
    encoded, but no seeds.  A table without such a vector gives no row, one without labels a single sum."""
    books = fit(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale)
    coded = encode(vectors, books, scale=scale) if books[-1].size else kept_vectors(vectors).limit(0).selectExpr("vec_id", "label", "'' code", "0L error")
    coded = stored(coded, "codes")
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books[-1])).alias("codebooks_sha256"))
