"""A stored inverted index: what full-text search reads in place of the texts.

A posting is a token of one row with its places and their weights, each a number (four times the place
and the weight's letter).  Postings lie in folders by the
token's bucket, sorted by token in their files, so a search opens the buckets of its own tokens and skips
other tokens by the files' statistics.  Rows are indexed as they are appended: a batch has a folder of
its own, which counts once it is finished and which a repeated batch replaces.  Rows of a table only
ever grow here; what has been indexed under one id stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fts
from ..functions.stemming import STOP_WORDS, stem
from .versions import finished_folders

BUCKETS = 64
POSTINGS = "token string, id bigint, project string, hits array<int>"
ROWS = "id bigint, project string"
LETTERS = "ABCD"
MOST_WORDS = 1 << 20  # of the rows that are brought together at once, unless a single row has more


class Postings:
    """``root/postings/batch=n/bucket=b`` and ``root/rows/batch=n``, the ids that were indexed."""

    def __init__(self, spark: SparkSession, root: str, fields: list[tuple[str, str]], config: str = "simple", buckets: int = BUCKETS):
        self.spark, self.root, self.fields, self.config, self.buckets = spark, root.rstrip("/"), fields, config, buckets

    def append(self, rows: DataFrame, batch: int) -> None:
        """Indexes ``rows(id, project, *fields)`` as a batch."""
        made = self.made_of(rows)
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/batch={batch}")
        # the ids last: a batch counts once they are there
        rows.select(*names(ROWS)).write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")

    def made_of(self, rows: DataFrame) -> DataFrame:
        """The postings of rows, sorted by bucket and token.

        A row's words become postings where the row is read, so that nothing but postings crosses the
        network, and only once; how they are dealt to files is left to a rebalance, which splits a bucket
        that frequent words make large."""
        words = rows.select("id", "project", *[fts.words(F.col(c)).alias(f"words_{i}") for i, (c, _) in enumerate(self.fields)])
        made = words.mapInArrow(gathered([LETTERS.index(w) for _, w in self.fields], self.config), POSTINGS)
        return made.withColumn("bucket", bucket_of(F.col("token"), self.buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "id")

    def _read(self, kind: str, schema: str) -> DataFrame:
        batches = finished_folders(self.spark, f"{self.root}/rows", "batch=")
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/batch={n}" for n in batches])

    def rows(self) -> DataFrame:
        return self._read("rows", ROWS)

    def postings(self, tokens: list[str]) -> DataFrame:
        """The postings of some tokens: their buckets alone are listed and read."""
        # hashes of literals are folded before partitions are pruned
        within = reduce(lambda a, b: a | b, [F.col("bucket") == bucket_of(F.lit(t), self.buckets) for t in tokens])
        return self._read("postings", f"{POSTINGS}, batch bigint, bucket int").filter(within & F.col("token").isin(tokens))

    def vocabulary(self) -> DataFrame:
        """token, the rows that hold it, and its occurrences."""
        return self._read("postings", f"{POSTINGS}, batch bigint, bucket int").groupBy("token").agg(F.count("*").alias("rows"), F.sum(F.size("hits")).alias("occurrences"))

    def vectors(self, tokens: list[str], only: Column | None = None) -> DataFrame:
        """id and vector, the tokens' occurrences in order, of the rows that hold any of the tokens."""
        found = self.postings(tokens)
        found = found if only is None else found.filter(only)
        weights = F.array(*[F.lit(fts.WEIGHTS[w]) for w in LETTERS])
        hits = F.transform("hits", lambda h: F.struct(F.shiftright(h, 2).alias("pos"), F.col("token").alias("token"), F.element_at(weights, h.bitwiseAND(3) + 1).alias("weight")))
        if len(tokens) == 1:  # one posting a row: nothing to bring together
            merged = found.select("id", hits.alias("hits"))
        else:
            merged = found.select("id", hits.alias("hits")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
        return merged.select("id", F.transform("hits", lambda h: F.struct(h["token"].alias("token"), h["pos"].alias("pos"), h["weight"].alias("weight"))).alias("vector"))

    def found(self, query: str, project: str | None = None) -> DataFrame:
        """id and vector of the rows that match a web search string.

        Only where an alternative does nothing but exclude, rows that hold none of the tokens can match
        and all ids are read."""
        parsed = fts.parse_query(query, self.config)
        tokens = sorted({w for g in parsed for t in g for w in t.tokens})
        if not tokens:
            return self.spark.createDataFrame([], "id bigint, vector array<struct<token: string, pos: int, weight: double>>")
        only = None if project is None else F.col("project") == project
        made = self.vectors(tokens, only)
        if any(all(t.negated for t in g) for g in parsed):
            every = self.rows() if only is None else self.rows().filter(only)
            made = every.select("id").join(made, "id", "left").withColumn("vector", F.coalesce("vector", F.array().cast(made.schema["vector"].dataType)))
        return made.filter(fts.matches(F.col("vector"), parsed))

    def hits(self, query: str, project: str | None = None) -> DataFrame:
        """id and text_rank of the rows that match a web search string."""
        return self.found(query, project).select("id", fts.rank(F.col("vector"), fts.parse_query(query, self.config)).alias("text_rank"))


def gathered(letters: list[int], config: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, project, the words of each field) to postings; each distinct word is stemmed once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}

        def meaning(w: str) -> str | None:
            if w not in known:
                known[w] = None if w in STOP_WORDS else stem(w)
            return known[w]

        for batch in batches:
            total = sum(len(c.flatten()) for c in batch.columns[2:])
            step = max(1, batch.num_rows * MOST_WORDS // max(total, 1))
            for at in range(0, batch.num_rows, step):
                yield of_rows(batch.slice(at, step), letters, meaning if config == "english" else None)

    return gather


def of_rows(rows: pa.RecordBatch, letters: list[int], meaning: Callable[[str], str | None] | None) -> pa.RecordBatch:
    """The postings of some rows, each token and row once with all its hits, by token: a run that the sort
    behind the network only has to merge."""
    row, code, before = [], [], np.zeros(rows.num_rows, dtype=np.int64)
    for words, letter in zip(rows.columns[2:], letters):
        n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - before, n) + 1  # goes on from field to field
        row.append(np.repeat(np.arange(rows.num_rows), n))
        code.append(place * 4 + letter)
        before = before + n
    row, code = np.concatenate(row), np.concatenate(code)
    words = pa.concat_arrays([c.flatten() for c in rows.columns[2:]]).dictionary_encode()
    tokens, token = words.dictionary, words.indices.to_numpy()
    if meaning is not None:  # several words may have one stem, stop words have none
        stems = pa.array([meaning(w) for w in tokens.to_pylist()], pa.string()).dictionary_encode()
        tokens, token = stems.dictionary, stems.indices.fill_null(-1).to_numpy()[token]
        row, code, token = row[token >= 0], code[token >= 0], token[token >= 0]
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[pc.array_sort_indices(tokens).to_numpy()] = np.arange(len(tokens))
    key = rank[token] * rows.num_rows + row
    order = np.argsort(key, kind="stable")  # hits stay in the order of their places
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(code[order], pa.int32()))
    own = pa.array(row[order][first])
    return pa.RecordBatch.from_arrays([tokens.take(pa.array(token[order][first])), rows.column(0).take(own), rows.column(1).take(own), hits], names(POSTINGS))


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def names(schema: str) -> list[str]:
    """The top-level columns of a schema, which are written before its nested ones here."""
    return [part.split()[0] for part in schema.split("array<")[0].split(", ")]
