"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts each text where the hash has its top bits clear, so
cuts move with the text: after an insertion they fall into step again within a few dozen bytes.
Where it has none for long, as in a word that is repeated over and over, the least hash around cuts.
Chunks with the same digest in different documents are stored once, with the smallest doc_id; a
passage is a run of neighbouring chunks that each occur in another document too.  A run that is too
short as it stands might not be with the parts of chunks at its ends.  If another document has some
of its chunks in a row, wherever, both hash each stretch of as many words as a passage has around them,
and stretches that documents share are passages: no document stands for the others.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, rows_of, stored

WINDOW_STEPS = 4  # doublings: 16 bytes
SHORTEST, SPREAD, LONGEST = 12, 24, 256  # bytes: the least, how many more on average, the most
STRETCH = 64  # bytes without a cut, beyond which there are further ones
LEAST_WORDS = 50  # of a passage
LEAST_CHARS = 500  # or so many, for scripts without spaces
NEAR = 3  # chunks on either side of a run in which a passage may begin or end: cuts fall into step within them
IN_A_ROW = 3  # chunks of a short run that another document must have in a row,
LONG, VERY_LONG = 48, 96  # or one of so many characters, in a run of fewer chunks, or in any
SPARSE = 20  # characters a word, beyond which characters count
FIELD = 1 << 10  # room for each count in the shape of a chunk
WORD = re.compile(r"\S+")


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    return (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def cuts(data: np.ndarray) -> list[int]:
    """The ends of the chunks of a text's bytes; none lies within a character."""
    n = len(data)
    if not n:
        return []
    h, size = gear()[data], 1
    for _ in range(WINDOW_STEPS):
        h[size:] += h[:-size].copy() << np.uint16(size)  # h[i] now covers 2 * size bytes, older ones shifted further
        size *= 2
    h[:-1][(data[1:] & 0xC0) == 0x80] = 65535  # no cut within a character
    ok = h < np.uint16(65536 // SPREAD)
    ends = np.flatnonzero(ok)
    # a stretch without cuts, as of one word again and again, is cut where the hash is least around
    begins, stops = np.append(0, ends), np.append(ends, n)
    if (stops - begins > STRETCH).any():
        inner = np.repeat(stops - begins > STRETCH, np.append(stops[0], np.diff(stops)))[:n]
        ok |= inner & (h == _least_around(h)) & (h < 65535)
    out, last = [], 0
    for at in (np.flatnonzero(ok) + 1).tolist():
        while at - last > LONGEST:
            last = _whole(data, last + LONGEST)
            out.append(last)
        if at - last >= SHORTEST:
            out.append(at)
            last = at
    while n - last > LONGEST:
        last = _whole(data, last + LONGEST)
        out.append(last)
    if last < n:
        out.append(n)
    return out


def _least_around(h: np.ndarray, reach: int = 16) -> np.ndarray:
    """The least value within reach on either side, where that lies within h."""
    out = h.copy()
    for k in range(1, reach + 1):
        np.minimum(out[k:], h[:-k], out=out[k:])
        np.minimum(out[:-k], h[k:], out=out[:-k])
    return out


def _whole(data: np.ndarray, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunk_rows(docs: DataFrame) -> DataFrame:
    """A row for each chunk: digest, doc_id, row (a hash of the text), start in code points, shape.

    shape holds four counts below 1024, the lowest first: the chunk's code points, the words that
    begin in it, and those that begin in the NEAR chunks before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, digests, starts, shapes, n = [], [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(np.concatenate(ids or [np.empty(0, np.int64)])), pa.array(np.concatenate(rows or [np.empty(0, np.int64)])), pa.array(np.concatenate(starts or [np.empty(0, np.int32)])), pa.array(np.concatenate(shapes or [np.empty(0, np.int64)]))], names=["digest", "doc_id", "row", "start", "shape"])

        for doc_id, row, text in rows_of(batches, "doc_id", "row", "text"):
            if not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, dtype=np.uint8)
            ends = cuts(data)
            bounds = np.array([0, *ends])
            place = bounds
            if len(raw) != len(text):
                place = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[bounds]
            a = 0
            for b in ends:
                digests.append(xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63))
                a = b
            seen = np.concatenate(([0], np.cumsum(_word_begins(data))))[bounds]  # words that begin before each bound
            k = np.arange(len(ends))
            before = seen[k] - seen[np.maximum(k - NEAR, 0)]
            after = seen[np.minimum(k + 1 + NEAR, len(ends))] - seen[k + 1]
            ids.append(np.full(len(ends), doc_id, dtype=np.int64))
            rows.append(np.full(len(ends), row, dtype=np.int64))
            starts.append(place[:-1].astype(np.int32))
            shapes.append(np.diff(place) + FIELD * (np.diff(seen) + FIELD * (before + FIELD * after)))
            n += len(ends)
            if n > 20_000:
                yield batch()
                ids, rows, digests, starts, shapes, n = [], [], [], [], [], 0
        yield batch()

    return docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "digest long, doc_id long, row long, start int, shape long")


def _word_begins(data: np.ndarray) -> np.ndarray:
    """Where a byte that is no white space follows one that is, or none."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return ~space & np.append(True, space[:-1])


def repeated_passages(docs: DataFrame, *, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """A row for each passage of ``docs(doc_id, text)`` that other documents hold too, of at least
    ``least_words`` words or, where words are rarer than one in ten characters, ``least_chars``
    characters: doc_id, row, start, end, first_doc, repeats.

    start and end are code points, end exclusive.  A passage with enough in whole chunks is reported
    as these, others as the words (or characters) that agree.  first_doc is the smallest doc_id seen
    with it; where it is the document itself, the passage stays, else it is a copy (repeats).  Null and
    empty texts and null doc_ids have no passages, and rows that repeat a doc_id are one document: what
    only they share isn't repeated.  row is the hash (xxhash64) of the text that the places refer
    to; equal rows are reported once.  Other columns are ignored."""
    chunks = chunk_rows(docs)
    shared = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    # how often a chunk occurs isn't bounded: its rows are a skewed join key, which Spark can split
    # where the other side isn't aggregated in the same stage
    shared = stored(shared.select("digest", "first_doc"), "shared-chunks")
    hits = chunks.join(shared.hint("merge"), "digest")
    ordered = hits.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "start")
    runs = stored(ordered.mapInArrow(_runs(least_words, least_chars), f"{PASSAGE}, gram long, short boolean"), "chunk-runs")
    sure = runs.filter("gram is null").select(*PASSAGE_NAMES)
    return sure.unionByName(_stretches(docs, runs.filter("gram is not null"), least_words, least_chars))


PASSAGE = "doc_id long, row long, start long, end long, first_doc long, repeats boolean"
PASSAGE_NAMES = ("doc_id", "row", "start", "end", "first_doc", "repeats")


def _runs(least_words: int, least_chars: int):
    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k in (5, 7) else pa.int64()) for k, c in enumerate(cols)], names=[*PASSAGE_NAMES, "gram", "short"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by document and place, the runs without gaps; one may reach over batches.

        Of each run also its chunks in a row (gram), by which a run that is short finds its like."""
        doc = None  # with its row
        parts: list[list] = []  # of a run, which differ in whether they are copies: start, end, first_doc, repeats
        row: list[tuple[int, int, int]] = []  # of a run: digest, start and end of its last chunks
        grams: list[tuple] = []  # of a run that is still short, each with whether it asks in any run, or in one of few chunks
        words = before = after = chunks = 0

        def gram(size: int) -> tuple:
            last = row[-size:]
            # hashes of tuples of integers are the same in every process
            return (*doc, last[0][1], last[-1][2], None, None, hash(tuple(d for d, _, _ in last)))

        def done() -> list[tuple]:
            if not parts:
                return []
            size = parts[-1][1] - parts[0][0]
            if words >= least_words or size >= least_chars:
                return [(*doc, *p, None, None) for p in parts]
            # words that begin before the run and reach into it count on neither side
            near = before + words + after
            might = near + 1 >= least_words or near * SPARSE < size + 2 * NEAR * SPREAD
            return [(*g, might and (always or chunks < IN_A_ROW)) for g, always in grams]

        names = ("doc_id", "row", "start", "shape", "first_doc", "digest")
        for batch in batches:
            out: list[tuple] = []
            for i, r, s, shape, f, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                d, n = (i, r), shape % FIELD
                if d == doc and parts and s < parts[-1][1]:
                    continue  # the same chunk of an equal row
                if d != doc or s > parts[-1][1]:
                    out += done()
                    doc, parts, row, grams, words, chunks, before = d, [], [], [], 0, 0, shape // FIELD**2 % FIELD
                if parts and parts[-1][3] == (f < i):
                    parts[-1][1], parts[-1][2] = s + n, min(parts[-1][2], f)
                else:
                    parts.append([s, s + n, f, f < i])
                own = shape // FIELD % FIELD
                words, after, chunks = words + own, shape // FIELD**3, chunks + 1
                row = [*row[-IN_A_ROW + 1 :], (digest, s, s + n)]
                made = [(gram(IN_A_ROW), True)] if chunks >= IN_A_ROW else []
                if n >= LONG or (shape // FIELD**2 % FIELD + own + after) * SPARSE < n + 2 * NEAR * SPREAD:
                    made.append((gram(1), n >= VERY_LONG))
                grams += made
                if words >= least_words or s + n - parts[0][0] >= least_chars:
                    out += [(*g, False) for g, _ in grams]  # what is sure already only answers the short runs of others
                    grams = []
            yield table_of(out)
        yield table_of(done())

    return run


def _stretches(docs: DataFrame, grams: DataFrame, least_words: int, least_chars: int) -> DataFrame:
    """Passages around chunks that a short run and another document have in a row.

    Stretches of least_words words that hold the middle of such a place are hashed, in every
    document that has it, and those that two documents share are passages; the lists are of one text."""
    asked = grams.groupBy("gram").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l"), F.max("short").alias("s")).filter("f < l and s")
    asked = stored(asked.select("gram"), "asked-grams")
    spots = grams.join(asked.hint("merge"), "gram").groupBy("doc_id", "row").agg(F.collect_set(F.floor((F.col("start") + F.col("end")) / 2).cast("int")).alias("spots"))
    spots = stored(spots, "spots").withColumnsRenamed({"doc_id": "_doc", "row": "_row"})
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = texts.join(spots, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xxh = xxhash.xxh3_64_intdigest
        for doc_id, row, text, middles in rows_of(batches, "doc_id", "row", "text", "spots"):
            starts, ends = stretches(text, sorted(middles), least_words, least_chars)
            if text.isascii():
                raw = text.encode()
                digests = [xxh(raw[a:b]) - (1 << 63) for a, b in zip(starts, ends)]
            else:
                digests = [xxh(text[a:b].encode("utf-8", "surrogatepass")) - (1 << 63) for a, b in zip(starts, ends)]
            for at in range(0, len(digests), 50_000):
                part = slice(at, at + 50_000)
                n = len(digests[part])
                yield pa.RecordBatch.from_arrays([pa.array(digests[part], pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(starts[part], pa.int64()), pa.array(ends[part], pa.int64())], names=["stretch", "doc_id", "row", "start", "end"])

    hashed = stored(found.select("doc_id", "row", "text", "spots").mapInArrow(hashes, "stretch long, doc_id long, row long, start long, end long"), "stretches")
    shared = hashed.groupBy("stretch").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("l")).filter("first_doc < l").select("stretch", "first_doc")
    shared = stored(shared, "shared-stretches")
    same = hashed.join(shared.hint("merge"), "stretch").repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "start", "end")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that overlap, and are copies or not alike, as one passage."""
        held: dict[bool, list] = {}

        def table_of(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 5 else pa.int64()) for k, c in enumerate(cols)], names=list(PASSAGE_NAMES))

        for batch in batches:
            out = []
            for i, r, a, b, f in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "row", "start", "end", "first_doc"))):
                last = held.get(f < i)
                if last and last[:2] == [i, r] and a <= last[3]:
                    last[3], last[4] = max(last[3], b), min(last[4], f)
                    continue
                if last:
                    out.append(last)
                held[f < i] = [i, r, a, b, f, f < i]
            yield table_of(out)
        yield table_of(list(held.values()))

    return same.select("doc_id", "row", "start", "end", "first_doc").mapInArrow(merged, PASSAGE)


def stretches(text: str, middles: list[int], least_words: int, least_chars: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of least_words whole words that hold one of the places, and of
    those of least_chars characters where words are rare."""
    spans = [m.span() for m in WORD.finditer(text)]
    begins = [a for a, _ in spans]
    words, chars = set(), set()
    for at in middles:
        w = bisect_right(begins, at) - 1
        words.update(range(max(0, w - least_words + 1), min(w, len(spans) - least_words) + 1))
        low, high = max(0, at - least_chars), min(len(text), at + least_chars)
        if (bisect_right(begins, high) - bisect_right(begins, low)) * SPARSE < high - low:
            chars.update(range(max(0, at - least_chars + 1), min(at, len(text) - least_chars) + 1))
    words, chars = sorted(words), sorted(chars)
    return [begins[k] for k in words] + chars, [spans[k + least_words - 1][1] for k in words] + [c + least_chars for c in chars]


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the copies of passages cut out of text; the first document keeps its own."""
    in_order = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    spans = repeated_passages(docs, **options).filter("repeats").withColumn("end", F.max("end").over(in_order))  # they may overlap
    spans = spans.groupBy("doc_id", F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias("__spans"))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length("text")))
    begins = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["end"]))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))), "")
    out = docs.withColumn("__row", F.xxhash64("text")).join(spans, ["doc_id", "__row"], "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept))
    return out.select(*docs.columns)
