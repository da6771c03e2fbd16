"""Mixing sources to target weights with soft membership.

A classifier learned from a table of labelled documents gives each document a posterior over
domains.  Rates r >= 0 are then fitted so that the expected tokens of each domain, the sum of
r * tokens * posterior, match targets: least squares by projected gradient steps.  A step's
gradient is one vector with an entry for each domain, summed over all documents by Spark, and in the
metric of tokens the new rate of a document follows from its posterior alone; so all steps so far
are a short list, and no rates are kept between them.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, rows_of, stored, upper_chars, word_hashes

BUCKETS = 1 << 16  # of hashed words
SHAPES = 7
WARN_ABOVE = 0.02


@dataclass(frozen=True)
class DomainClassifier:
    domains: tuple[str, ...]
    column: np.ndarray  # of each bucket the column of its weight, the last one for buckets that tell nothing
    weights: np.ndarray  # (telling buckets, nothing, shapes and a constant) x domains
    prior: np.ndarray

    def posterior(self, text: str) -> tuple[np.ndarray, int]:
        """Of the domains, and the number of words."""
        buckets, shape, n = features(text)
        if not n:
            return self.prior, 0
        z = self.weights[self.column[buckets]].sum(axis=0) + shape @ self.weights[-SHAPES - 1 :]
        z = np.exp(z - z.max())
        return z / z.sum(), n


def features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of the words that occur, some measures of shape and a constant, and the number of words."""
    words = word_hashes(text)
    shape = np.ones(SHAPES + 1)
    if not len(words):
        return words.astype(np.int64), shape, 0
    lines, upper = text.split("\n"), np.count_nonzero(upper_chars()[code_points(text)])
    buckets = np.unique((words & np.uint64(BUCKETS - 1)).astype(np.int64))
    marks = sum(map(text.count, "#$%&*!|"))
    shape[:SHAPES] = (len(buckets) / len(words), upper / len(text), min(1.0, 5 * marks / len(text)), len(set(lines)) / len(lines), min(1.0, len(text) / len(words) / 20), np.log1p(len(words)) / 10, min(1.0, len(lines) / len(words)))
    return buckets, shape, len(words)


def train(x: np.ndarray, y: np.ndarray, n: int, *, steps: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    w = v = np.zeros((x.shape[1], n))
    target = np.eye(n)[y]
    rate = 1 / (np.linalg.eigvalsh(x.T @ x / len(x)).max() / 2 + l2)
    for k in range(steps):
        z = x @ v
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        new = v - rate * (x.T @ (z - target) / len(x) + l2 * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, *, sample: int = 3000, telling: int = 256) -> DomainClassifier:
    """Learn domains from ``labels(doc_id, domain)``: at most ``sample`` labelled rows, those whose hashed
    doc_id is smallest, equal ones once, by the ``telling`` buckets of words that differ most between
    the domains.

    Tasks turn texts into features; the driver gets counts of buckets and ``telling`` bits a row.
    Rows without doc_id, domain or text teach nothing.  With no labelled row at all there is one
    domain of its own, which holds everything."""
    order, row = F.xxhash64("doc_id"), F.xxhash64("text")
    picked = labels.filter("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain")).distinct()
    picked = stored(picked.orderBy(order, "doc_id", "domain").limit(sample), "labels")
    keys = docs.filter("text is not null").select("doc_id", row.alias("h")).join(F.broadcast(picked), "doc_id").distinct()  # sample rows: a proven bound
    keys = stored(keys.orderBy(order, "doc_id", "domain", "h").limit(sample), "sample")
    rows = docs.select("doc_id", "text", row.alias("h")).join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "domain"])  # sample rows again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, h, domain, text in rows_of([batch], "doc_id", "h", "domain", "text"):
                buckets, shape, _ = features(text)
                for c, v in zip(cols, (doc_id, h, domain, buckets.tolist(), shape.tolist())):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "h", "domain", "buckets", "shape"])

    made = stored(rows.select("doc_id", "h", "domain", "text").mapInArrow(run, "doc_id long, h long, domain string, buckets array<int>, shape array<double>"), "features")
    size = {r.domain: r["count"] for r in made.groupBy("domain").count().collect()}
    if not size:
        return DomainClassifier(("all",), np.zeros(BUCKETS, dtype=np.int64), np.zeros((SHAPES + 2, 1)), np.ones(1))
    domains = tuple(sorted(size))
    sizes = np.array([size[d] for d in domains])
    seen = np.zeros((len(domains), BUCKETS))
    for r in made.select("domain", F.explode("buckets").alias("bucket")).groupBy("domain", "bucket").count().toLocalIterator():
        seen[domains.index(r.domain), r.bucket] = r["count"]
    mean = seen.sum(axis=0) / sizes.sum()
    chi = (((seen - sizes[:, None] * mean) ** 2) / (sizes[:, None] * mean * (1 - mean) + 1)).sum(axis=0)
    chosen = np.argsort(-chi, kind="stable")[:telling]
    column = np.full(BUCKETS, telling, dtype=np.int64)
    column[chosen] = np.arange(telling)
    kept = made.select("domain", "doc_id", "h", F.array_intersect("buckets", F.array(*[F.lit(int(b)) for b in chosen])).alias("buckets"), "shape")
    learned = sorted(kept.collect(), key=lambda r: (r.domain, r.doc_id, r.h))
    y = np.array([domains.index(r.domain) for r in learned])
    x = np.zeros((len(y), telling + 1 + SHAPES + 1))
    for i, r in enumerate(learned):
        x[i, column[r.buckets]] = 1
        x[i, telling + 1 :] = r["shape"]
    return DomainClassifier(domains, column, train(x, y, len(domains)), sizes / len(y))


def memberships(docs: DataFrame, model: DomainClassifier) -> DataFrame:
    """doc_id, n_tokens (words) and the posterior over the model's domains; the prior for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, found = [], [], []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                p, n = model.posterior(text or "")
                ids.append(doc_id)
                sizes.append(n)
                found.append(p.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def _dot(p: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(p, y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _rate(moves: list[list[float]]) -> Column:
    """A document's rate after all moves."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in y]) for y in moves])
    return F.aggregate(steps, F.lit(1.0), lambda r, y: F.greatest(F.lit(0.0), r - _dot(F.col("posterior"), y)))


def fit_rates(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], **options) -> list[list[float]]:
    """The moves that take all rates from 1 to the fit, without what is left of the error."""
    return fitted(members, domains, targets, **options)[0]


def fitted(members: DataFrame, domains: tuple[str, ...], targets: dict[str, float], *, steps: int = 30, tolerance: float = 1e-4) -> tuple[list[list[float]], float]:
    """The moves that take all rates from 1 to the fit, and the residual: the greatest share by which a
    domain misses its target (of at least 0.01).  Domains without a target count as 0.

    A move is a gradient step, scaled by the inverse of the domains' Gram matrix over the documents
    whose rates aren't 0, and is halved where the error would grow; after it, rates below 0 become 0."""
    n = len(domains)
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not wanted.sum():
        raise ValueError(f"no target for any of {domains}")
    goal = wanted / wanted.sum()
    p = [F.col("posterior")[i] for i in range(n)]
    moves: list[list[float]] = []
    best, gradient, gram = np.inf, np.zeros(n), np.eye(n)
    for _ in range(steps):
        at = members.select("posterior", F.col("n_tokens").cast("double").alias("t"), _rate(moves).alias("r"))
        live = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = at.agg(F.sum("t"), *[F.sum(F.col("t") * F.col("r") * p[i]) for i in range(n)], *[F.sum(live * p[i] * p[j]) for i in range(n) for j in range(i, n)]).first()
        if not got[0]:
            return [], 0.0
        now = np.array(got[1 : n + 1]) / got[0] - goal
        error = float(np.abs(now / np.maximum(goal, 0.01)).max())
        if error >= best and moves:
            moves[-1] = [v / 2 for v in moves[-1]]
            if max(map(abs, moves[-1])) < tolerance:
                return moves[:-1], best
            continue
        if error < tolerance or error > 0.999 * best and np.isfinite(best):
            return moves, error
        best, gradient = error, now
        gram[np.triu_indices(n)] = np.array(got[n + 1 :]) / got[0]
        gram = np.triu(gram) + np.triu(gram, 1).T
        moves.append(np.linalg.solve(gram + 1e-6 * np.eye(n), gradient).tolist())
    return moves[:-1], best  # the last move was never looked at


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_tokens, rate, residual and p_<domain> for
    each domain.  residual is the same for all rows: the greatest share by which a domain's expected
    tokens miss its target, which documents without any of its words can't reach; above ``WARN_ABOVE``
    a warning says so.

    ``labels(doc_id, domain)`` teaches the domains; ``targets`` gives each one's weight among the
    tokens, whose total stays.  Null and empty texts have no tokens and the prior as posterior.
    Repeated rows are rows of their own; other columns are ignored."""
    model = fit_classifier(docs, labels, **options)
    members = stored(memberships(docs, model), "memberships")
    moves, residual = fitted(members, model.domains, targets if model.domains != ("all",) else {"all": 1.0})
    unknown = sorted(set(targets) - set(model.domains)) if model.domains != ("all",) else []
    if residual > WARN_ABOVE or unknown:
        warnings.warn(f"targets are missed by up to {residual:.1%}; domains that no label teaches: {unknown}", stacklevel=2)
    return members.select("doc_id", "n_tokens", _rate(moves).alias("rate"), F.lit(float(residual)).alias("residual"), *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)])


def document_domains(labels: DataFrame) -> DataFrame:
    """Domains of the table ``labels(doc_id, quality, toxic)``."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


TARGETS = {"high": 0.85, "low": 0.14, "toxic": 0.01}  # of the tokens


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more with the
    probability of the rest, decided by a hash of its doc_id.  Rows without a doc_id stay once."""
    rates = mixing_rates(docs, labels, targets).filter("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("__rate"))
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("__rate") + draw).cast("int")
    out = docs.join(rates, "doc_id").withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return out.select(*docs.columns).union(docs.filter("doc_id is null"))
