import dataclasses

import pytest
from pyspark.sql import functions as F

from engramlake.api import Memory, limit_or_default
from engramlake.functions.models import HashEmbedder


def test_limits():
    assert [limit_or_default(x, "search") for x in (None, "x", 0, -3, "7", 4)] == [10, 10, 10, 10, 7, 4]


def test_questions(spark, sf_dir):
    m = Memory.from_tables(spark, sf_dir, HashEmbedder(64), "simple")
    found = m.search("that with", limit=5).collect()
    assert len(found) == 5 and [r.combined_score for r in found] == sorted((r.combined_score for r in found), reverse=True)
    assert m.timeline("src1", "2024-01-01", "2024-01-01").count() > 0 and m.timeline("src1", "2024-01-01", "junk").count() == 0
    assert m.context("src1").startswith("<memory-context>\n# Recent Activity") and m.context("nowhere") == ""
    assert m.projects().count() == 20 and m.stats().first().observations == m.observations.count()
    pages, cursors = m.pull("m1", {"observations": 150})
    assert {r.table_name: r.cursor for r in cursors.collect()}["observations"] == max(r.id for r in pages["observations"].collect())
    assert m.sync_info()[0].count() == 4 and m.observation(3).count() == 1
    with pytest.raises(ValueError):
        m.search("  ")


def test_indexed_search_finds_what_a_scan_finds(spark, sf_dir, tmp_path):
    m = Memory.from_tables(spark, sf_dir, HashEmbedder(64))
    found = lambda m: [(r.type, r.id, round(r.combined_score, 9)) for r in m.search("that things", limit=5).collect()]
    plain = found(m)
    assert plain and found(m.indexed(str(tmp_path))) == plain
    none = dataclasses.replace(m, summaries=m.summaries.withColumn("embedding", F.lit(None).cast("array<float>")))
    assert none.indexed(str(tmp_path / "none")).search("that").count() > 0
