"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into segments, and of each the mean and the deviation (the length of what is left
without the mean) are kept.  For two vectors the products of the means, plus at most the products of
the deviations, bound the inner product of a segment (Cauchy-Schwarz), and finer segments bound it
closer.  Candidates whose bound lies below the query's current k-th score are ruled out, coarse to
fine; exact integer scores are computed for the survivors alone.

Queries and candidates are dealt in blocks, and each pair of blocks is a cell of its own: a cell's
memory is bounded, and it sends k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
LEVELS = (4, 16)  # segments, coarse to fine
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
AT_ONCE = 256  # queries whose coarse bounds are held at once


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); null, empty and non-finite vectors are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad & F.col("vec_id").isNotNull()
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def segment_statistics(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, scaled so that their products add up to bounds of inner products."""
    edges = np.linspace(0, m.shape[1], min(segments, m.shape[1]) + 1).astype(int)
    mean, rest = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        part = m[:, a:b]
        mu = part.mean(axis=1)
        mean.append(mu * np.sqrt(b - a))
        rest.append(np.sqrt(((part - mu[:, None]) ** 2).sum(axis=1)))
    return np.stack(mean, 1), np.stack(rest, 1)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, itself excepted: query row, candidate row, score."""
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    levels = [(segment_statistics(qf, s), segment_statistics(cf, s)) for s in LEVELS]
    (qm, qd), (cm, cd) = levels[0]
    rows, cols, scores = [], [], []
    for i in range(len(q)):
        if i % AT_ONCE == 0:
            coarse = qm[i : i + AT_ONCE] @ cm.T + qd[i : i + AT_ONCE] @ cd.T
        bound = coarse[i % AT_ONCE]
        own = np.flatnonzero(c_ids == q_ids[i])
        bound[own] = -np.inf
        n = len(bound) - len(own)
        if n <= 0:
            continue
        # the most promising candidates give the k-th score to beat
        first = np.argpartition(-bound, min(4 * k, len(bound)) - 1)[: 4 * k]
        first = first[np.isfinite(bound[first])]
        got = c[first] @ q[i]
        least = np.sort(got)[-k] if len(got) >= k else -np.inf
        slack = 1e-6 * (1 + abs(least) if np.isfinite(least) else 1) + 1e-3
        alive = np.flatnonzero(np.isfinite(bound) & (bound >= least - slack))
        for (qm2, qd2), (cm2, cd2) in levels[1:]:
            alive = alive[cm2[alive] @ qm2[i] + cd2[alive] @ qd2[i] >= least - slack]
        exact = c[alive] @ q[i]
        best = np.lexsort((c_ids[alive], -exact))[:k]
        rows.append(np.full(len(best), i))
        cols.append(alive[best])
        scores.append(exact[best])
    if not rows:
        return (np.empty(0, dtype=np.int64),) * 3
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """For each of ``queries(vec_id, v)`` its k highest integer inner products with ``vectors(vec_id,
    v)`` of other vec_ids: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Both come from ``integer_vectors``.  Only vectors of the query's length are its candidates.
    Rows that repeat a vec_id are candidates, and queries, each of their own, but for the top k of a
    query_id every candidate row counts once."""
    sizes = vectors.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    c_blocks, q_blocks = max(1, -(-sizes[0] // CANDIDATE_BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    deal = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int")
    left = queries.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", deal("q", q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    right = vectors.select("vec_id", "v", deal("c", c_blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        q_size, c_size = q["v"].map(len), c["v"].map(len)
        for n in sorted(set(q_size) & set(c_size)):
            a, b = q[q_size == n], c[c_size == n]
            a_ids, b_ids = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
            i, j, score = search_block(a_ids, np.stack(a["v"].to_numpy()).astype(np.int64), b_ids, np.stack(b["v"].to_numpy()).astype(np.int64), k)
            out.append(pd.DataFrame({"query_id": a_ids[i], "vec_id": b_ids[j], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
