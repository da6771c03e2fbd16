"""The stored indexes: what they read, what they find, and that they find what scans find."""

import random

import numpy as np
import pytest

from engramlake.operators import search
from engramlake.sources.postings import Postings
from engramlake.sources.vector_cells import VectorIndex, train_cells

FIELDS = [("title", "A"), ("narrative", "C")]
SCHEMA = "id long, project string, title string, narrative string"


def folders_read(df):
    """How many folders of partitions the scan of a plan opened, and the scan as the plan has it."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollectPublic()
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numPartitions").value(), scan.toString()


@pytest.fixture(scope="module")
def notes(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta the of running runs ran cats cat 42 été".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice([" ", ", ", "-", ". "]) for _ in range(n)).strip()
    rows = [(i, f"p{i % 3}" if i % 10 else None, text(rng.randrange(4)) if i % 7 else None, text(rng.randrange(60))) for i in range(300)]
    rows += [(300, "p0", "", ""), (301, "p0", None, None), (302, "p1", "alpha " * 3000, "beta " * 3000)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module", params=["simple", "english"])
def index(spark, notes, request, tmp_path_factory):
    made = Postings(spark, str(tmp_path_factory.mktemp("postings")), FIELDS, request.param, buckets=8)
    made.append(notes.filter("id % 2 = 0"), 0)
    made.append(notes.filter("id % 2 = 1"), 1)
    return made


QUERIES = ["alpha", "alpha beta", '"alpha beta"', "alpha -beta", "alpha or 42", "-alpha", "gamma or -the", '"cats running" or delta', "nothing", "", "the", '-"alpha beta" gamma', "alpha beta gamma"]


@pytest.mark.parametrize("query", QUERIES)
def test_postings_find_what_a_scan_finds(notes, index, query):
    for project in (None, "p1"):
        rows = notes if project is None else notes.filter(f"project = '{project}'")
        got = {r.id: round(r.text_rank, 9) for r in index.hits(query, project).collect()}
        assert got == {r.id: round(r.text_rank, 9) for r in search.text_hits(rows, FIELDS, query, index.config).collect()}


def test_postings_read_their_buckets_alone(index):
    every, _ = folders_read(index._read("postings", "token string, batch bigint, bucket int"))
    read, scan = folders_read(index.postings(["alpha"]))
    assert every > 10 and 1 <= read <= 2  # its bucket, in two batches
    assert "PartitionFilters: [isnotnull(bucket" in scan and "PushedFilters: [IsNotNull(token), EqualTo(token,alpha)" in scan
    assert folders_read(index.postings(["alpha", "beta", "gamma"]))[0] <= 6


def test_a_repeated_batch_replaces_itself(spark, notes, tmp_path):
    made = Postings(spark, str(tmp_path), FIELDS)
    assert made.hits("alpha").count() == 0 and made.rows().count() == 0
    made.append(notes.filter("id < 100"), 0)
    before = sorted(map(tuple, made.hits("alpha").collect()))
    made.append(notes.filter("id < 100"), 0)
    assert sorted(map(tuple, made.hits("alpha").collect())) == before
    # a batch whose job died before its ids were written doesn't count
    (tmp_path / "postings/batch=1").mkdir()
    notes.filter("id >= 100").select("id", "project").write.parquet(f"{tmp_path}/rows/batch=2")
    (tmp_path / "rows/batch=2/_SUCCESS").unlink()
    assert sorted(map(tuple, made.hits("alpha").collect())) == before


def vectors(spark, m, project=lambda i: f"p{i % 3}"):
    return spark.createDataFrame([(i, project(i), [float(x) for x in v]) for i, v in enumerate(m)], "id long, project string, embedding array<float>")


def scores(df):
    return [(r.id, round(r.semantic_score, 9)) for r in df.collect()]


def test_cells_reach_the_exact_neighbours(spark, sf_dir, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id id", "cast(label as string) project", "embedding")
    index = VectorIndex(spark, str(tmp_path))
    index.train(rows)
    index.append(rows.filter("id % 2 = 0"), 0)
    index.append(rows.filter("id % 2 = 1"), 1)
    reached = []
    for r in rows.orderBy("id").limit(60).collect()[::6]:
        v = list(r.embedding)
        exact = scores(search.nearest(rows, v, 10))
        assert scores(index.nearest(v, 10, exact=True)) == exact
        reached.append(len({i for i, _ in exact} & {i for i, _ in scores(index.nearest(v, 10))}) / 10)
    assert sum(reached) / len(reached) >= 0.9
    own = rows.filter("project = '3'")
    assert scores(index.nearest(v, 5, "3", exact=True)) == scores(search.nearest(own, v, 5))


def test_cells_read_few_folders_where_vectors_cluster(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 4
    m = np.concatenate([c + rng.normal(size=(40, 16)) * 0.2 for c in centres])
    rows = vectors(spark, m)
    index = VectorIndex(spark, str(tmp_path))
    index.train(rows, cells=20)
    index.append(rows, 0)
    read, scan = folders_read(index.within([3, 5]))
    assert read == 2 and "PartitionFilters: [cell" in scan
    q = m[77].tolist()
    known = index.cells()
    assert known.probes <= 3
    angle = np.arccos(np.clip(known.centroids @ (m[77] / np.linalg.norm(m[77])), -1, 1))
    open_cells = set(index._open(q, 10, None, [int(angle.argmin())], angle))
    assert len(open_cells | {int(angle.argmin())}) <= 4  # the exact mode proves that the others hold nothing better
    assert scores(index.nearest(q, 10, exact=True)) == scores(search.nearest(rows, q, 10))
    # more neighbours than the probed cells hold: the exact mode reads on
    assert scores(index.nearest(q, 120, exact=True)) == scores(search.nearest(rows, q, 120))


def test_cells_of_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "p", None), (3, "p", [0.0, 0.0]), (4, "p", [float("nan"), 1.0]), (5, None, [0.0, 2.0]), (6, "p", [1.0]), (7, "p", [1.0, 0.0])], "id long, project string, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path))
    index.train(rows.filter("id <> 6"))
    index.append(rows, 0)
    assert scores(index.nearest([2.0, 0.0], 5, exact=True)) == [(1, 1.0), (7, 1.0), (5, 0.0)]
    assert scores(index.nearest([0.0, 0.0], 5)) == [] == scores(index.nearest([1.0], 5))
    with pytest.raises(ValueError):
        index.train(rows.filter("id = 2"))


def test_training_leaves_no_cell_empty():
    m = np.repeat(np.eye(4), 30, axis=0)
    own = (m @ train_cells(m, 4).T).argmax(axis=1)
    assert len(set(own)) == 4
