"""Product codes, lattice links and the manifest against brute force and their SQL twins."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.llm import ball_kmeans, decontamination, html_template, lattice_links, merkle, registry, substring_dedup
from engramlake.llm.lattice_links import Block

VECTORS = "vec_id long, embedding array<double>, label int, node long, v string, code string, entry int, cell int, block int, links int, n int, tree int"


def vectors_of(spark, rows):
    """Rows with columns whose names an operator uses itself."""
    return spark.createDataFrame([(i, v, k, 0, "x", "x", 0, 0, 0, 0, 0, 0) for i, v, k in rows], VECTORS)


def sql_rows(sf_dir, table, name, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}'")
    return sorted(con.execute(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall(), key=repr)


# 11


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.floor(np.array([r[1] for r in rows]) * scale).astype(np.int64)
    cut = np.split(v, parts, axis=1)
    books = [c[: min(entries, sum(r[0] is not None for r in rows))].copy() for c in cut]
    for last in [False] * rounds + [True]:
        d = [((c[:, None] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
        if not last:
            for p in range(parts):
                for e in set(d[p].argmin(axis=1)):
                    own = cut[p][d[p].argmin(axis=1) == e]
                    books[p][e] = own.sum(axis=0) // len(own)
    error = sum(x.min(axis=1) for x in d)
    code = ["".join(f"{x:02x}" for x in c) for c in np.stack([x.argmin(axis=1) for x in d], axis=1)]
    total = {}
    for r, e in zip(rows, error):
        total[r[2]] = total.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], c, int(e), total[r[2]], sha) for r, c, e in zip(rows, code, error)), key=repr)


def coded(df, **more):
    return sorted(map(tuple, ball_kmeans.compressed(df, **more).collect()), key=repr)


def test_codes_given(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert coded(spark.createDataFrame(rows)) == plain_codes([(r["vec_id"], r["embedding"], r["label"]) for r in rows])


def test_codes_ties_and_gaps(spark):
    rng = np.random.default_rng(3)
    # a coarse grid: many equal distances, equal entries, repeated rows and ids, null labels and ids
    rows = [(int(i // 2) if i % 17 else None, (rng.integers(-2, 3, 16) / 4096 * 8).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(400)]
    bad = [(-5, None, 1), (-4, [], 1), (-3, [None] * 16, 1), (-2, [float("nan")] * 16, 1), (-1, [float("inf")] * 16, 1), (500, [0.5] * 24, 1)]
    assert coded(vectors_of(spark, rows + bad)) == plain_codes(rows)
    assert coded(vectors_of(spark, rows[:5])) == plain_codes(rows[:5])
    assert coded(vectors_of(spark, rows), parts=4, entries=3, rounds=2) == plain_codes(rows, 4, 3, 2)
    assert coded(vectors_of(spark, bad[:5])) == [] == coded(vectors_of(spark, []))
    with pytest.raises(Exception, match="no room"):
        coded(vectors_of(spark, [(1, [1e9] * 16, 0)]))
    with pytest.raises(ValueError, match="equal parts"):
        coded(vectors_of(spark, [(1, [1.0] * 9, 0)]))


def test_balls_spare_work():
    """Well-separated balls: stable cores are never compared, and codes stay exact."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (16, 8))
    points = np.concatenate([c + rng.integers(-500, 500, (300, 8)) for c in centres])
    code, work = ball_kmeans.reassign(points, centres, np.repeat(np.arange(16), 300))
    assert (code == np.repeat(np.arange(16), 300)).all() and work == 0
    code, work = ball_kmeans.reassign(points, centres, rng.integers(0, 16, len(points)))
    assert (code == np.repeat(np.arange(16), 300)).all()


# 12


def links_of(rows, threshold=0.95):
    """vec_id, n_links and component of each row, from all pairs."""
    fine = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, _ in rows]
    label = [i for i, _, _ in rows]
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and fine[a] and fine[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]) / np.abs(rows[a][1]).max(), np.array(rows[b][1]) / np.abs(rows[b][1]).max()
                near[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    moved = True
    while moved:
        moved = False
        for a in range(len(rows)):
            for b in np.flatnonzero(near[a]):
                if label[b] < label[a]:
                    label[a], moved = label[b], True
    return sorted(((rows[a][0], int(near[a].sum()), label[a], rows[a][0] is not None and label[a] == rows[a][0]) for a in range(len(rows))), key=repr)


def linked(df, **more):
    return sorted(map(tuple, lattice_links.near_duplicates(df, **more).collect()), key=repr)


def close_to(rng, v, cosine):
    w = rng.normal(size=len(v))
    w -= w @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_links_planted(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 64))
    vectors = [*rng.normal(size=(60, 64)), *base, *(close_to(rng, base[k % 6], c) for k, c in enumerate([0.999, 0.99, 0.98, 0.97, 0.96, 0.94, 0.93, 0.9] * 3))]
    vectors += [base[0]] * 5 + [3 * base[1], 1e-30 * base[1], 1e200 * base[1], -base[2]]
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 64, 0), (903, [None] * 64, 0), (904, [float("nan")] * 64, 0), (None, rows[0][1], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [5.0], 0), (7, rows[3][1], 0)]
    assert linked(vectors_of(spark, rows)) == links_of(rows)


def test_links_chain_and_empty(spark):
    rng = np.random.default_rng(4)
    chain = [rng.normal(size=64)]
    for _ in range(40):
        chain.append(close_to(rng, chain[-1], 0.97))
    rows = [(1000 - i, v.tolist(), 0) for i, v in enumerate(chain)]
    assert linked(vectors_of(spark, rows)) == links_of(rows)
    assert linked(vectors_of(spark, [])) == []
    assert linked(vectors_of(spark, [(1, None, 0)])) == [(1, 0, 1, True)]


def test_links_of_a_crowded_cell(spark, monkeypatch):
    """One group in many blocks: each pair is counted once, whatever cell and block it stands in."""
    monkeypatch.setattr(lattice_links, "BLOCK", 16)
    rng = np.random.default_rng(6)
    core = rng.normal(size=32)
    rows = [(i, close_to(rng, core, 0.985).tolist(), 0) for i in range(200)]
    assert linked(vectors_of(spark, rows)) == links_of(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1500, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*a, *(close_to(rng, v, 0.9501) for v in a)])]
    got = lattice_links.near_duplicates(vectors_of(spark, rows))
    assert got.filter("n_links > 0").count() >= 0.99 * 3000


def test_lattice():
    """Decoded points are E8's nearest: none of the 240 neighbours is closer, and all are in the lattice."""
    x = np.random.default_rng(0).normal(size=(500, 8)) * 3
    y = lattice_links.nearest_e8(x)
    twice = y * 2
    assert (twice == np.rint(twice)).all() and ((twice.astype(int) & 1).ptp(axis=1) == 0 if hasattr(twice, "ptp") else True)
    assert (np.rint(y.sum(axis=1)).astype(int) % 2 == 0).all()
    r = lattice_links.roots()
    assert len(r) == 240 and np.allclose((r**2).sum(axis=1), 2)
    assert (((x - y) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - y[:, None] - r) ** 2).sum(axis=2) + 1e-9).all()


def test_pairs_count_in_one_cell():
    """A block compared with another gives what both together give."""
    rng = np.random.default_rng(8)
    core = rng.normal(size=16)
    v = lattice_links.unit(np.array([close_to(rng, core, 0.99) for _ in range(30)]))
    whole = Block(np.arange(30), v, np.full((30, 3), 5), np.arange(1, 31))
    links, label, linked = lattice_links.compare(whole, None, 5, 0, 3, 0.95)
    half = lambda s: Block(whole.node[s], whole.unit[s], whole.codes[s], whole.copies[s])
    a, b = half(slice(0, 12)), half(slice(12, 30))
    parts = np.concatenate([lattice_links.compare(x, None, 5, 0, 3, 0.95)[0] for x in (a, b)]) + lattice_links.compare(a, b, 5, 0, 3, 0.95)[0]
    assert (links == parts).all() and (links == sum(range(1, 31)) - whole.copies).all() and (label == 0).all() and len(linked) == 30


# 13


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_manifest(rows, fanout=16):
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(framed, (*r[:4], text))))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // fanout * fanout :][:fanout]
                paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
                at[i] = p // fanout
            nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, leaf(r, r[4])))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        by[k].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subs = [tree([x[1] for x in by[k]]) for k in keys]
    out = []
    if keys:
        root, tops = tree([s[0] for s in subs])
    for k, (subroot, paths), top in zip(keys, subs, tops if keys else []):
        for (r, own), path in zip(by[k], paths):
            path, text, node = path + top, r[4], own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], own, subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, tree int, n int, path string, block int, size int, level0 string"


def proven(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 0, 0, 0, "x", 0, 0, "x") for r in rows], DOCS)
    return sorted(map(tuple, merkle.manifest(df, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_given(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = registry.op13_merkle_manifest(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows) and {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [15, 16, 17], [255, 256, 257, 1], [700, 2, 33]])
def test_manifest_shapes(spark, sizes):
    rows = [(i, f"s{k}", "en", 1, f"Text {i}") for k, n in enumerate(sizes) for i in range(1000 * k, 1000 * k + n)]
    assert proven(spark, rows) == plain_manifest(rows)


def test_manifest_many_trees_and_levels(spark):
    rows = [(i, f"s{i}" if i < 70 else "big", None, i, "A b") for i in range(200)]
    for fanout in (2, 3):
        assert proven(spark, rows, fanout=fanout) == plain_manifest(rows, fanout)


def test_manifest_edges(spark):
    rows = [(5, None, None, None, None), (None, None, "en", 2, "No Id"), (None, "é", "en", 2, "No Id"), (5, "Z", "en", 3, ""), (5, "Z", "en", 3, ""), (5, "Z", "en", 3, "ÀB 😀 C"), (6, "", "en", 0, "A" * 300_000), (7, "a", "fr", -4, "x:y-"), (10, "a", "fr", 1, "ABC"), (2**60, "a", "fr", 1, "ABC")]
    assert proven(spark, rows) == plain_manifest(rows)
    assert proven(spark, []) == []


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op12_lattice_links", "op13_merkle_manifest"])
def test_same_as_sql(spark, sf_dir, name):
    table = "documents" if "op13" in name else "embeddings"
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, df.collect()), key=repr) == sql_rows(f"{sf_dir}/{table}.parquet", table, name, ", ".join(df.columns))


def test_sql_of_links_and_codes_on_hard_rows(spark, tmp_path):
    """The SQL twins agree where there are links, nulls, ties and gaps, too."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5, 16))
    rows = [(i, close_to(rng, base[i % 5], 0.98).tolist(), None if i % 7 == 0 else i % 3) for i in range(60)] + [(70, None, 1), (71, [float("nan")] * 16, 1)]
    df = vectors_of(spark, rows).select("vec_id", "embedding", "label")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("op11_ball_kmeans", "op12_lattice_links"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect()), key=repr) == sql_rows(f"{tmp_path}/embeddings.parquet/*.parquet", "embeddings", name, ", ".join(got.columns))
    assert registry.op12_lattice_links(spark, str(tmp_path)).agg(F.sum("n_links")).first()[0] > 0


# 6: repetitive texts and items


@pytest.mark.parametrize("seed", range(6))
def test_crowded_bands_are_the_listed_ones(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    piece = ["a", "0 ", "ab", "abc 1 ", "tick tock ", "x" * 7 + "y"][seed]
    items = [(1, piece * 60), (2, "other words " + piece * 20 + "and an end"), (3, "entirely different text of an item that is long enough"), (4, piece * 200)]
    texts = [piece * 300, "start " + piece * 90 + " middle entirely different text of an item that is long enough " + piece * 40, "".join(rng.choice([piece, "other ", "z"], 200))]
    index = decontamination.Index(items, decontamination.Q, decontamination.EDIT_RATE)
    for text in texts:
        seq, _ = decontamination.normalised(text)
        monkeypatch.setattr(decontamination, "PAIRS", 10**9)
        listed, matches = index.bands(seq), index.matches(text)
        monkeypatch.setattr(decontamination, "PAIRS", 50)
        assert (index.bands(seq) == listed).all() and index.matches(text) == matches and (len(listed) or text is texts[2])


def test_long_runs_of_one_letter_need_little_memory():
    import tracemalloc

    index = decontamination.Index([(1, "a" * 5000), (2, "0 " * 2000)], decontamination.Q, decontamination.EDIT_RATE)
    tracemalloc.start()
    found = index.matches("a" * 200_000)
    other = index.matches("0 " * 60_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and len(found) >= 35 and {f[0] for f in found} == {1} and {f[3] for f in found} == {0}
    assert {f[0] for f in other} == {2} and len(other) >= 25


# 5: text that pages share within their articles


def test_shared_subheadings_stay(spark):
    """Repetition alone is no verdict within an article; links, other elements and the edges are."""

    def article(i):
        parts = "<h2>Introduction</h2>" + f"<p>How story {i} begins, at some length</p><p><b>In short</b></p><p>Story {i} goes on</p>" + "<h2>Conclusion</h2>" + f"<p>How story {i} ends</p>"
        extra = "<p><a href=x>Read our best stories of the year</a></p><div class=box><p>Become a member today</p></div>"
        return f"<h1>Title {i}</h1><p>By the editors</p>{parts.replace('<h2>Conclusion', extra + '<h2>Conclusion')}<p>Follow our channel</p><h3>More from us</h3>"

    rows = [(i, f"http://h{i % 2}.example/x", f"<body><p>Site</p>{'<article>' if i % 2 else '<div class=story>'}{article(i)}{'</article>' if i % 2 else '</div>'}</body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nBy the editors\nIntroduction\nHow story {i} begins, at some length\nIn short\nStory {i} goes on\nConclusion\nHow story {i} ends"


def test_three_pages_of_a_host_keep_their_headings(spark):
    rows = [(i, "http://h.example/x", f"<body><nav>Menu</nav><article><h2>Introduction</h2><p>Text {i} one</p><h2>Conclusion</h2><p>Text {i} two</p></article></body>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_template.main_text(df).collect()} == {f"Introduction\nText {i} one\nConclusion\nText {i} two" for i in range(3)}


# 8: passages of fifty words among documents that hold parts of them


def words_of(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)]


def fifty_word_documents(texts, n=50):
    """doc_ids that share n whole words in a row, with what stands between them, with another."""
    seen = {}
    for i, t in texts:
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        for a, b in zip(spans, spans[n - 1 :]):
            seen.setdefault(t[a[0] : b[1]], set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


@pytest.mark.parametrize("parts", [4, 2])
def test_passages_whose_parts_other_documents_hold(spark, parts):
    """Fragments that hide a passage's other holder behind their own documents."""
    rng = np.random.default_rng(parts)
    rows, n = [], 0
    for k in range(60):
        passage = words_of(rng, 52)
        for _ in range(2):
            rows.append((1000 + n, " ".join(words_of(rng, 40) + passage + words_of(rng, 40))))
            n += 1
        step = 52 // parts
        for j in range(0, 52, step):
            # parts of the passage, some of them long, at ids before and after
            for base in (0, 100_000):
                more = passage[max(0, j - 10) : j + step + 10] if parts == 2 else passage[j : j + step]
                rows.append((base + 40 * k + j, " ".join(words_of(rng, 20) + more + words_of(rng, 20))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
    want = fifty_word_documents(rows)
    assert want >= set(range(1000, 1000 + n)) and got >= want
    assert len(got - want) <= 0.02 * len(rows)  # a word or two short of it


def test_passages_of_the_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).collect()
    want = fifty_word_documents(rows)
    assert {r.doc_id for r in found} >= want and len({r.doc_id for r in found} - want) <= 0.1 * len(want)
    texts = dict(rows)
    whole = []  # a passage that is a copy in part comes in pieces
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        if whole and whole[-1][0] == r.doc_id and r.start <= whole[-1][2]:
            whole[-1][2] = max(whole[-1][2], r.end)
        else:
            whole.append([r.doc_id, r.start, r.end])
    for i, a, b in whole:
        assert len(texts[i][a:b].split()) >= 48 or b - a >= 500


def test_passages_without_spaces(spark):
    rng = np.random.default_rng(2)
    signs = lambda n: "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, n))
    shared, short = signs(560), signs(300)
    rows = [(1, signs(200) + shared + signs(100)), (2, signs(50) + shared + signs(90)), (3, signs(100) + shared[:250] + signs(90)), (4, signs(30) + short), (5, short + signs(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.end - r.start >= 500 for r in got)
