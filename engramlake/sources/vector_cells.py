"""A stored vector index: cells around trained centroids, as partitions of a table.

Centroids are fitted once on a bounded sample, and each vector lies in the folder of the centroid
that is nearest by angle.  A search ranks the centroids, of which there are few, and reads the folders
of the nearest; how many reach the wanted recall is measured on the sample when the index is
trained.  The exact mode then reads on: each cell's widest angle bounds what any of its vectors can
score, and cells that could still hold one of the k best are read too, all others are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, vector_literal
from .versions import finished_folders

SAMPLE = 20_000  # vectors that centroids are fitted on, at most
MOST_CELLS = 4096
RECALL, NEIGHBOURS, TRIALS = 0.95, 10, 200  # what the number of probed cells is measured by
VECTORS = "id bigint, project string, embedding array<float>"


def usable() -> Column:
    """Vectors that have an angle to others."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0)


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def train_cells(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that runs empty takes the vector farthest from its own."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        own = near.argmax(axis=1)
        far = iter(np.argsort(near.max(axis=1), kind="stable"))
        for c in range(cells):
            members = sample[own == c]
            total = members.sum(axis=0) if len(members) else sample[next(far)]
            size = np.sqrt(total @ total)
            centroids[c] = total / size if size > 0 else centroids[c]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The fewest cells whose vectors hold the share ``recall`` of the sample's own nearest neighbours."""
    trials = sample[:: max(1, len(sample) // TRIALS)]
    own = (sample @ centroids.T).argmax(axis=1)
    k = min(NEIGHBOURS, len(sample))
    best = np.argpartition(-(trials @ sample.T), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(trials @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


@dataclass
class Cells:
    centroids: np.ndarray
    probes: int


class VectorIndex:
    """``root/cells`` with the centroids, ``root/vectors/batch=n/cell=c``, ``root/spread/batch=n``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def train(self, rows: DataFrame, cells: int | None = None, recall: float = RECALL) -> None:
        """Fits centroids on up to 20,000 vectors, those with the smallest hashes of their ids."""
        fit = rows.filter(usable()).select("id", "embedding")
        sample = fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
        if not sample:
            raise ValueError("no vector to train cells on")
        dims = len(sample[0][0])
        m = units(np.array([r[0] for r in sample if len(r[0]) == dims], dtype=np.float64))
        n = fit.count()
        centroids = train_cells(m, min(cells or round(np.sqrt(n)), MOST_CELLS, len(m)))
        made = [(i, c.tolist(), probes_for(m, centroids, recall)) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(made, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")

    def cells(self) -> Cells:
        """The centroids: at most 4,096, whatever the number of vectors."""
        rows = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()
        return Cells(np.array([r["centroid"] for r in rows]), rows[0]["probes"])

    def append(self, rows: DataFrame, batch: int) -> None:
        """Files ``rows(id, project, embedding)`` as a batch; vectors without an angle, or of another
        length than the centroids, have no cell and are found by no search."""
        centroids = self.cells().centroids

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                m = units(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1))
                near = m @ centroids.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(m)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(angle)], [*part.schema.names, "cell", "angle"])

        kept = rows.filter(usable() & (F.size("embedding") == centroids.shape[1])).select("id", "project", F.col("embedding").cast("array<float>").alias("embedding"))
        # a cell of many near copies is split by the rebalance
        filed = kept.mapInArrow(assign, f"{VECTORS}, cell int, angle double").hint("rebalance", "cell")
        filed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/vectors/batch={batch}")
        spread = self._vectors([batch], "angle double").groupBy("cell").agg(F.max("angle").alias("angle"))
        spread.write.mode("overwrite").parquet(f"{self.root}/spread/batch={batch}")

    def _vectors(self, batches: list[int], more: str = "") -> DataFrame:
        schema = ", ".join(x for x in (VECTORS, more, "batch bigint, cell int") if x)
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/vectors").parquet(*[f"{self.root}/vectors/batch={n}" for n in batches])

    def within(self, cells: list[int], project: str | None = None) -> DataFrame:
        """The vectors of some cells; the folders of others are not read."""
        rows = self._vectors(finished_folders(self.spark, f"{self.root}/spread", "batch=")).filter(F.col("cell").isin(cells))
        return rows if project is None else rows.filter(F.col("project") == project)

    def nearest(self, vector: list[float], k: int, project: str | None = None, *, probes: int | None = None, exact: bool = False) -> DataFrame:
        """id and semantic_score of the k vectors closest to one, ties by id; exact ones, or those that
        the probed cells hold."""
        known = self.cells()
        if not any(vector) or len(vector) != known.centroids.shape[1]:
            return self.spark.createDataFrame([], "id bigint, semantic_score double")
        q = units(np.array([vector], dtype=np.float64))[0]
        angle = np.arccos(np.clip(known.centroids @ q, -1, 1))
        first = np.argsort(angle, kind="stable")[: probes or known.probes].tolist()
        if exact:
            first = sorted(set(first) | set(self._open(vector, k, project, first, angle)))
        return closest(self.within(first, project), vector, k)

    def _open(self, vector: list[float], k: int, project: str | None, probed: list[int], angle: np.ndarray) -> list[int]:
        """The cells that may hold a vector as good as the k-th of the probed ones."""
        least = closest(self.within(probed, project), vector, k).agg(F.count("*").alias("n"), F.min("semantic_score").alias("least")).first()
        batches = finished_folders(self.spark, f"{self.root}/spread", "batch=")
        if not batches:
            return []
        spread = self.spark.read.parquet(*[f"{self.root}/spread/batch={n}" for n in batches]).groupBy("cell").agg(F.max("angle").alias("angle")).collect()  # a row a cell
        if least["n"] < k:
            return [r["cell"] for r in spread]
        return [r["cell"] for r in spread if np.cos(max(0.0, angle[r["cell"]] - r["angle"])) >= least["least"] - 1e-9]


def closest(rows: DataFrame, vector: list[float], k: int) -> DataFrame:
    scored = rows.select("id", cosine_similarity(F.col("embedding"), vector_literal(vector)).alias("semantic_score"))
    return scored.orderBy(F.desc_nulls_last("semantic_score"), "id").limit(k).filter("semantic_score is not null")
