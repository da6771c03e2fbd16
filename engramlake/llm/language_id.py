"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is turned into a complete transition table.  A
text is parsed against it into longest phrases that occur in the labelled text; few phrases mean a
small cross-entropy, phrases * log2(symbols learned) / symbols parsed, and the language with the
smallest wins.  Whole texts are parsed, and a phrase is always the longest match: many texts
advance through the tables together, symbol by symbol, and the last few go on by themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import code_points, kept_by_worker

AT_ONCE = 512  # texts that are parsed together
STEPS, FEW = 256, 8  # symbols after which finished texts leave; so few texts are parsed one by one
SPACE, OTHER, FIRST = 0, 1, 2  # symbols: any run of non-letters, letters not seen in training, the rest
UNDETERMINED = "und"
NEW_COLUMNS = ("lang_pred", "score", "bits")


@dataclass(frozen=True)
class LanguageModel:
    """What is learned: a bounded excerpt of normalised text per language, and the letters told apart."""

    texts: tuple[tuple[str, str], ...]
    letters: str


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


@lru_cache(maxsize=1)
def _letters_of_unicode() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=4)
def symbol_table(letters: str) -> np.ndarray:
    out = np.where(_letters_of_unicode(), OTHER, SPACE).astype(np.uint8)
    for i, c in enumerate(letters):
        out[ord(c)] = FIRST + i
    return out


def symbols(text: str, letters: str) -> np.ndarray:
    """The text in lower case as symbols, each run of non-letters one space, none at the ends."""
    out = symbol_table(letters)[code_points(text.lower())]
    keep = out != SPACE
    keep[1:] |= keep[:-1].copy()
    out = out[keep]
    return out[:-1] if len(out) and out[-1] == SPACE else out


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """The transitions of the smallest automaton that accepts every substring of seq."""
    goes, link, depth, last = [{}], [-1], [0], 0
    for c in seq:
        now = len(goes)
        goes.append({})
        depth.append(depth[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = now
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if depth[p] + 1 == depth[q]:
                link[now] = q
            else:
                copy = len(goes)
                goes.append(goes[q].copy())
                depth.append(depth[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = copy
                    p = link[p]
        last = now
    return goes


def parse_table(model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table for all languages, the row of each one's root, and log2 of the symbols it learned.

    An entry holds twice the offset of the next row, plus one if a phrase ends before this symbol.
    The last row of a language is where symbols lead that it never has, each a phrase of its own.
    The last symbol of a row is padding: it changes nothing."""
    width = FIRST + len(model.letters) + 1
    parts, roots, base, logs = [], [], 0, []
    for _, text in model.texts:
        learned = symbols(text, model.letters)
        goes = suffix_automaton(learned.tolist())
        own = np.arange(len(goes) + 1, dtype=np.int64)
        root = np.full(width, len(goes), dtype=np.int64)
        for c, to in goes[0].items():
            root[c] = to
        t = np.tile(((root * width + base) << 1) | 1, (len(own), 1))
        t[0] &= ~1
        state = np.repeat(own[:-1], [len(g) for g in goes])
        t[state, np.fromiter((c for g in goes for c in g), dtype=np.int64)] = (np.fromiter((x for g in goes for x in g.values()), dtype=np.int64) * width + base) << 1
        t[:, -1] = (own * width + base) << 1
        roots.append(base)
        logs.append(np.log2(max(2, len(learned))))
        base += t.size
        parts.append(t.astype(np.int32).ravel())
    return np.concatenate(parts), np.array(roots, dtype=np.int32), np.array(logs)


def cross_entropies(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol of each text under each language, and the part of a single phrase in them;
    NaN for texts without a letter."""
    table, roots, logs = kept_by_worker("language tables", model, lambda: parse_table(model))
    width = FIRST + len(model.letters) + 1
    seqs = [symbols(t or "", model.letters) for t in texts]
    sizes = np.array([len(s) for s in seqs], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")  # longest first, so that those at work are a prefix
    lengths = -sizes[order]
    row, phrases = np.repeat(roots[:, None], len(texts), axis=1), np.ones((len(roots), len(texts)), dtype=np.int64)
    start = 0
    while (alive := int(np.searchsorted(lengths, -start))) > FEW:
        grid = np.full((alive, STEPS), width - 1, dtype=np.int32)
        for j in range(alive):
            part = seqs[order[j]][start : start + STEPS]
            grid[j, : len(part)] = part
        at, ended = row[:, :alive].copy(), np.zeros((len(roots), alive), dtype=np.int32)
        for c in np.ascontiguousarray(grid.T):
            got = table[at + c]
            ended += got & 1
            at = got >> 1
        row[:, :alive] = at
        phrases[:, :alive] += ended
        start += STEPS
    goes = memoryview(table)
    for j in range(alive):
        rest = seqs[order[j]][start:].tobytes()
        for k in range(len(roots)):
            at, ended = int(row[k, j]), 0
            for c in rest:
                got = goes[at + c]
                ended += got & 1
                at = got >> 1
            phrases[k, j] += ended
    totals = np.empty_like(phrases)
    totals[:, order] = phrases
    with np.errstate(invalid="ignore", divide="ignore"):
        out = totals * logs[:, None] / sizes
        first = logs[:, None] / sizes
    out[:, sizes == 0] = np.nan
    return out.T, first.T


def fit(docs: DataFrame, *, docs_per_language: int = 96, max_symbols: int = 40_000, max_table_mb: int = 64, max_letters: int = 200) -> LanguageModel:
    """Learn from rows outside the held-out quarter with text and lang.

    The sample is bounded: of each language the ``docs_per_language`` rows whose hashed doc_id is
    smallest, equal rows once, of each the first 4 * ``max_symbols`` characters, of which
    ``max_symbols`` symbols count, fewer where many languages would make the tables exceed
    ``max_table_mb``, and equally many for each language that has them.  ``max_letters`` letters are
    told apart, the languages' commonest in turn; all others are one symbol, as are letters never
    learned."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    shares = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    key, row = F.xxhash64("doc_id"), F.xxhash64("text")
    # Spark keeps no more than the wanted rows of a language in each partition before they meet
    order = Window.partitionBy("lang").orderBy("k", "doc_id", "h")
    picked = known.select("doc_id", "lang", key.alias("k"), row.alias("h")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_per_language)
    keys = [tuple(r) for r in picked.select("doc_id", "lang", "k", "h").distinct().collect()]  # docs_per_language a language
    if not keys:
        return LanguageModel((), "")
    wanted = known.withColumn("h", row).join(F.broadcast(docs.sparkSession.createDataFrame(keys, "doc_id long, lang string, k long, h long")), ["doc_id", "lang", "h"])
    texts: dict[str, list[tuple]] = {}
    for r in wanted.select("lang", "k", "doc_id", "h", F.substring("text", 1, 4 * max_symbols).alias("text")).dropDuplicates(["lang", "doc_id", "h"]).collect():
        texts.setdefault(r.lang, []).append((r.k, r.doc_id, r.h, r.text))
    plain = {lang: " ".join(t.lower() for *_, t in sorted(rows)) for lang, rows in texts.items()}
    letters = _letters(plain, max_letters)
    width = FIRST + len(letters) + 1
    room = min(max_symbols, max_table_mb * 1_000_000 // (4 * 2 * width * len(plain)))
    cut = {lang: _excerpt(text, letters, room) for lang, text in plain.items()}
    return LanguageModel(tuple(sorted(cut.items(), key=lambda x: (-shares[x[0]], x[0]))), letters)


def _letters(plain: dict[str, str], most: int) -> str:
    """The languages' commonest letters in turn, until there are so many."""
    ranked = []
    for lang in sorted(plain):
        counts = Counter(c for c in plain[lang] if c.isalpha())
        ranked += [(n, c) for n, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))]
    return "".join(sorted(list(dict.fromkeys(c for _, c in sorted(ranked)))[:most]))


def _excerpt(text: str, letters: str, room: int) -> str:
    names = {SPACE: " ", OTHER: "\U0001f520"} | {FIRST + i: c for i, c in enumerate(letters)}
    names[OTHER] = next(c for c in map(chr, range(0x4E00, 0x9FFF)) if c not in letters)  # a letter that is told apart from none
    return "".join(names[s] for s in symbols(text, letters)[:room].tolist())


def predict(docs: DataFrame, model: LanguageModel, columns: tuple[str, str, str] = NEW_COLUMNS) -> DataFrame:
    """``docs`` with lang_pred, score and bits (or other names); columns of these names are replaced.

    lang_pred is ``und`` where the text is null or has no letter, or nothing was learned; ties go to
    the language with more labelled rows.  score is 1 - bits / bits of the runner-up (0: a tie; 1 if
    only one language is known).  bits is the cross-entropy per symbol under lang_pred, the first phrase not
    counted, so that a text of few letters isn't called improbable."""
    docs = docs.drop(*columns)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(columns, (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    names = [lang for lang, _ in model.texts]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                langs, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if names:
                    found, firsts = cross_entropies(texts, model)
                    for i in np.flatnonzero(~np.isnan(found[:, 0])):
                        order = np.argsort(found[i], kind="stable")
                        langs[i], bits[i] = names[order[0]], float(found[i, order[0]] - firsts[i, order[0]])
                        scores[i] = float(1 - found[i, order[0]] / found[i, order[1]]) if len(names) > 1 else 1.0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=schema.names)

    return docs.mapInArrow(label, schema)


def digest(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows that some learned language explains better than chance: a symbol costs less than one
    drawn evenly from the letters told apart.  Rows with an undetermined language go."""
    chance = float(np.log2(FIRST + max(1, len(model.letters))))
    lang, _, bits = names = ("__lang_pred", "__score", "__bits")
    found = predict(docs, model, names).filter((F.col(lang) != UNDETERMINED) & (F.col(bits) < chance))
    return found.select(*docs.columns)
