"""Benchmark decontamination by the q-gram lemma.

A passage within e edits of an item of m characters shares at least m - q + 1 - q * e of its q-grams
with it, all on at most e + 1 neighbouring diagonals (place in the text minus place in the item).
Shared q-grams are counted in bands of 2 * (e + 1) diagonals that overlap by half, so that one band
holds them all; bands that reach the bound are verified by alignment within the band.

The documents are never shuffled: each task holds the index of one block of items, whose size is
bounded, and a larger benchmark takes one pass for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, rows_of, word_chars

Q = 10
EDIT_RATE = 0.08
BLOCK_CHARS = 1_000_000
LONGEST_ITEM = 32_768
PAIRS = 2_000_000  # pairs of places of shared q-grams that are listed at once
SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower case, if that is a single letter or digit, else itself; 0 for what is neither."""
    low = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), dtype=np.uint32, count=0x110000)
    return np.where(word_chars(), low, np.uint32(0))


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case with one space between words, and which places of the text they come from."""
    low = letter_table()[code_points(text)]
    keep = low != 0
    keep[1:] |= keep[:-1].copy()
    seq = low[keep]
    seq[seq == 0] = 32
    if len(seq) and seq[-1] == 32:
        seq = seq[:-1]
    return seq, keep


def gram_hashes(seq: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q letters, put together from runs of powers of two."""
    if len(seq) < q:
        return np.empty(0, dtype=np.uint64)
    run, size = (seq.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    out, done, rest = None, 0, q
    while True:
        if rest & 1:
            part = run[done : done + len(seq) - q + 1]
            out = part.copy() if out is None else out * np.uint64(pow(0x100000001B3, size, 1 << 64)) + part
            done += size
        rest >>= 1
        if not rest:
            return out
        run = run[:-size] * np.uint64(pow(0x100000001B3, size, 1 << 64)) + run[size:]
        size *= 2


class Index:
    """The q-grams of a block of items: a bit table, then sorted hashes, then the places of each."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids, self.seqs, self.edits, self.least, self.short = q, [], [], [], [], []
        grams, item, place = [], [], []
        for item_id, text in items:
            seq, _ = normalised(text or "")
            m = len(seq)
            if m and m < q:
                self.short.append((item_id, seq))
            if m < q:
                continue
            e = min(int(rate * m), (m - q) // q)
            self.edits.append(e)
            self.least.append(m - q + 1 - q * e)
            own = gram_hashes(seq, q)
            grams.append(own)
            item.append(np.full(len(own), len(self.ids), dtype=np.int64))
            place.append(np.arange(len(own)))
            self.ids.append(item_id)
            self.seqs.append(seq)
        self.edits, self.least = np.array(self.edits, dtype=np.int64), np.array(self.least, dtype=np.int64)
        every = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.first = first
        self.item = (np.concatenate(item) if item else np.empty(0, dtype=np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, dtype=np.int64))[order]
        self.bits = min(26, max(10, int(np.ceil(np.log2(max(1, len(self.grams)) * 100)))))

    @property
    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = np.zeros(1 << self.bits, dtype=bool)
            self._table[self.slot(self.grams)] = True
        return self._table

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def bands(self, seq: np.ndarray) -> np.ndarray:
        """(item, band) rows whose shared q-grams reach the bound; band k begins at diagonal k * (e + 1)."""
        hashes = gram_hashes(seq, self.q)
        at = np.flatnonzero(self.table[self.slot(hashes)]) if len(self.grams) else np.empty(0, dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        real = self.grams[spot] == hashes[at] if len(at) else np.zeros(0, dtype=bool)
        at, spot = at[real], spot[real]
        if not len(at):
            return np.empty((0, 2), dtype=np.int64)
        n = self.count[spot]
        if n.sum() > PAIRS:
            return self.crowded_bands(len(hashes), at, spot)
        entry = np.repeat(self.first[spot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item = self.item[entry]
        band = (np.repeat(at, n) - self.place[entry]) // (self.edits[item] + 1)
        both = np.concatenate((np.stack((item, band), 1), np.stack((item, band - 1), 1)))
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        edges = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]).any(axis=1), [True])))
        found = both[edges[:-1]]
        return found[np.diff(edges) >= self.least[found[:, 0]]]

    def crowded_bands(self, length: int, at: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """The same where a text and an item repeat the same q-grams over and over: pairs of places are
        counted by q-gram and item and never all listed."""
        order = np.argsort(spot, kind="stable")
        at, spot = at[order], spot[order]
        edges = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1], [True])))
        counts: dict[int, np.ndarray] = {}
        for a, b in zip(edges[:-1], edges[1:]):
            first = self.first[spot[a]]
            items, places = self.item[first : first + self.count[spot[a]]], self.place[first : first + self.count[spot[a]]]
            cuts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1], [True])))
            for u, v in zip(cuts[:-1], cuts[1:]):
                item, own = int(items[u]), places[u:v]
                m, wide = len(self.seqs[item]), int(self.edits[item]) + 1
                low = -(m // wide) - 2
                if item not in counts:
                    counts[item] = np.zeros(length // wide - low + 2, dtype=np.int64)
                if (b - a) * (v - u) > 8 * (length + m):
                    by_diagonal = shared_by_diagonal(at[a:b], own, length, m)
                    band = np.arange(1 - m, length) // wide
                    counts[item] += np.bincount(band - low, by_diagonal, len(counts[item])).astype(np.int64)
                else:
                    rows = max(1, PAIRS // (v - u))
                    for k in range(a, b, rows):
                        band = (at[k : min(b, k + rows), None] - own).ravel() // wide
                        counts[item] += np.bincount(band - low, minlength=len(counts[item]))
        found = []
        for item in sorted(counts):
            both = counts[item].copy()  # a band holds its own diagonals and the next one's
            both[:-1] += counts[item][1:]
            band = np.flatnonzero((both >= self.least[item]) & (both > 0)) - (len(self.seqs[item]) // (int(self.edits[item]) + 1)) - 2
            found.append(np.stack((np.full(len(band), item), band), 1))
        return np.concatenate(found)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, start, end (code points of the text) and edits of each passage, the closest of those that overlap."""
        seq, kept = normalised(text)
        bands = self.bands(seq).tolist()
        if not bands and not self.short:
            return []
        at, out = np.flatnonzero(kept), []
        for item, band in bands:
            e, item_seq = int(self.edits[item]), self.seqs[item]
            if hit := banded_alignment(seq, item_seq, band * (e + 1) - e, 2 * (e + 1) + 2 * e, e):
                out.append((item, *hit))
        best: list[tuple[int, int, int, int]] = []
        for item, a, b, d in sorted(set(out), key=lambda x: (x[0], x[3], x[1], x[2])):
            if not any(i == item and a < y and x < b for i, x, y, _ in best):
                best.append((item, a, b, d))
        found = [(self.ids[i], int(at[a]), int(at[b - 1]) + 1, d) for i, a, b, d in best]
        data = seq.tobytes() if self.short else b""
        for item_id, item_seq in self.short:  # shorter than a q-gram: whole words, without edits
            needle, i = item_seq.tobytes(), -1
            while (i := data.find(needle, i + 1)) >= 0:
                a, b = i // 4, (i + len(needle)) // 4
                if i % 4 == 0 and (a == 0 or seq[a - 1] == 32) and (b == len(seq) or seq[b] == 32):
                    found.append((item_id, int(at[a]), int(at[b - 1]) + 1, 0))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def shared_by_diagonal(text: np.ndarray, item: np.ndarray, length: int, m: int) -> np.ndarray:
    """How many pairs of a place in a text and one in an item lie on each diagonal from 1 - m on: a convolution."""
    size = 1 << int(np.ceil(np.log2(length + m)))
    a, b = np.zeros(size), np.zeros(size)
    a[text], b[m - 1 - item] = 1, 1
    return np.rint(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), size)[: length + m - 1])


def banded_alignment(seq: np.ndarray, item: np.ndarray, diagonal: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """Where in seq the item lies with the fewest edits, on diagonals from ``diagonal`` on, and how many; None if over ``edits``."""
    m = len(item)
    for d in range(max(0, diagonal), min(diagonal + width, len(seq) - m) + 1):
        if seq[d] == item[0] and seq[d + m - 1] == item[-1] and np.array_equal(seq[d : d + m], item):
            return d, d + m, 0
    if edits == 0:
        return None
    end = _ends(seq, item, diagonal, width)
    best = int(end.argmin())
    if end[best] > edits:
        return None
    stop = min(diagonal + m + best, len(seq))  # letters beyond the text's end are edits, not part of the passage
    back = _ends(seq[:stop][::-1], item[::-1], -edits, 2 * edits, free_start=False)
    start = stop - (m - edits + int(back.argmin()))
    return max(0, start), stop, int(end[best])


def _ends(seq: np.ndarray, item: np.ndarray, diagonal: int, width: int, free_start: bool = True) -> np.ndarray:
    """Edits of the item against passages of seq that end on each diagonal of the band."""
    m, cells = len(item), np.arange(width + 1)
    padded = np.full(m + width + 1, np.uint32(0xFFFFFFFF))
    low, high = max(0, diagonal), min(len(seq), diagonal + m + width + 1)
    if high > low:
        padded[low - diagonal : high - diagonal] = seq[low:high]
    row = np.zeros(width + 1, dtype=np.int64) if free_start else np.where(cells + diagonal >= 0, cells + diagonal, m + width)
    for i in range(m):
        down = np.append(row[1:], m + width) + 1
        row = np.minimum(row + (padded[i : i + width + 1] != item[i]), down)
        row = np.minimum.accumulate(row - cells) + cells
    return row


def indexes(benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS, longest: int = LONGEST_ITEM) -> Iterator[Index]:
    """The items in blocks of about ``block_chars`` characters, each small enough for any task; items
    of over ``longest`` characters in pieces of that many."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    whole = items.filter(F.length("text") <= longest)
    begins = F.sequence(F.lit(1), F.length("text"), F.lit(longest))
    pieces = items.filter(F.length("text") > longest).select("item_id", F.explode(F.transform(begins, lambda b: F.substring(F.col("text"), b, F.lit(longest)))).alias("text"))
    items = whole.union(pieces)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in rows], q, rate)


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each passage of ``docs(doc_id, text)`` within the edit budget of an item of
    ``benchmark(item_id, text)``: doc_id, item_id, start, end, edits.

    Compared are letters and digits in lower case with single spaces between words.  Of passages
    that overlap, the one with fewer edits, then the earlier, stands for all.  The budget is
    ``rate`` of an item's characters, fewer where the lemma couldn't hold.  An item of over ``longest``
    characters is compared in pieces of that many, each as an item of its own.  Null and empty texts and
    items match nothing; repeated rows are reported each; other columns are ignored."""
    parts = []
    for index in indexes(benchmark, **options):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, text in rows_of([batch], "doc_id", "text") if text for m in index.matches(text)]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "edits"])

        parts.append(docs.select("doc_id", "text").mapInArrow(search, SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, every column kept."""
    schema = docs.schema
    for index in indexes(benchmark, **options):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not (text and index.matches(text)) for (text,) in rows_of([batch], "text")], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
