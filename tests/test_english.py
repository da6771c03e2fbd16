"""English search against SQL that stems every word itself."""

import re

import duckdb
import pandas as pd
import pytest

from engramlake.functions.stemming import AFTER_1A, SPECIAL, STEP2, STEP3, STEP4, STOP_WORDS, stem
from engramlake.plans.oracles import STEMS
from engramlake.plans.queries import ORACLES, QUERIES
from engramlake.sources.postings import Postings


def test_sql_stems_as_the_stemmer_does():
    words = duckdb.sql("SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    ends = ["", "s", "es", "ies", "sses", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "ly", "logi", "ative", "sion", "tion", "e", "ll", *STEP4, *(end for end, _ in STEP2 + STEP3)]
    bases = ["thing", "gener", "commun", "yay", "y", "ab", "hop", "rat", "plan", "controll", *SPECIAL, *AFTER_1A]
    every = sorted({w for (w,) in words if w} | {b + e for b in bases for e in ends} | {b + e + f for b in bases for e in ends for f in ("s", "ed", "ly")})
    tok = pd.DataFrame({"token": every})  # noqa: F841
    got = dict(duckdb.sql(f"WITH {STEMS} SELECT token, stem FROM stems").fetchall())
    assert got == {w: stem(w) for w in every if w not in STOP_WORDS}


@pytest.mark.parametrize("name", ["fts_english", "fts_english_and", "fts_english_scan"])
def test_words_of_any_form_count(spark, tmp_path, name):
    # titles end after 80 characters, within a word if need be
    texts = ["x" * 74 + " thinged thons", "thingness of thonlyingly", "thingful thonness", "thinglies -- thor", "thing thorness", "thong thingy"]
    docs = [(i, t, "en", "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'; CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR); CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, ts TIMESTAMP, props VARCHAR)")
    got = sorted((r["id"], r["text_rank"]) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT id, text_rank FROM ({ORACLES[name]})").fetchall())
    assert {i for i, _ in got} == {0, 1, 2}


def test_only_postings_cross_the_network_and_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", "the thing, things", None), (2, None, "", "thing " * 3 + "that")], "id long, project string, title string, text string")
    made = Postings(spark, str(tmp_path), [("title", "A"), ("text", "D")], "english").made_of(rows)
    got = {(r["token"], r["id"], r["project"], tuple(r["hits"])) for r in made.collect()}
    assert got == {("thing", 1, "p", (2 * 4, 3 * 4)), ("thing", 2, None, (1 * 4 + 3, 2 * 4 + 3, 3 * 4 + 3))}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"\bExchange\b", plan)) == 1
