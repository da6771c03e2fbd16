"""SQL twins (DuckDB) of the queries whose operators SQL can express."""

from __future__ import annotations

from . import ball_kmeans as km

FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def product_codes(parts: int = km.PARTS, entries: int = km.ENTRIES, rounds: int = km.ROUNDS, scale: int = km.SCALE) -> str:
    """Every round compares each part with every entry."""
    ctes = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {FINITE})""",
        f"""cut AS MATERIALIZED (SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p))""",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {entries} AND vec_id IS NOT NULL)",
    ]
    near = """SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e,
        CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut JOIN book{k} USING (p)) GROUP BY r, p"""
    for k in range(rounds):
        ctes += [
            f"near{k} AS MATERIALIZED ({near.format(k=k)})",
            f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (
            SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k} JOIN cut USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) n USING (p, e))""",
        ]
    return (
        "WITH "
        + ",\n".join(ctes)
        + f""", final AS ({near.format(k=rounds)}), coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY r),
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM kept JOIN coded USING (r), books"""
    )


CLOSE_VECTORS = f"""
WITH RECURSIVE v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding IS NOT NULL AND vec_id IS NOT NULL AND {FINITE}
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS MATERIALIZED (
    SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM v a JOIN v b ON a.ok AND b.ok AND a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT a, b, other FROM link UNION SELECT reach.a, link.b, link.other FROM reach JOIN link ON reach.b = link.a
), least AS (SELECT a, min(other) AS m FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, coalesce(vec_id = least(vec_id, m), false) AS kept
FROM v LEFT JOIN n ON n.a = r LEFT JOIN least ON least.a = r
"""

# crc32 of the decimal doc_id, bit by bit, for want of a function
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _framed(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, base: str) -> str:
    """Levels of all trees of ``base(g, pos, h, n)``, and what flanks each node that has a parent."""
    return f"""{name} AS (
    SELECT g, CAST(0 AS BIGINT) AS lvl, pos, h, n FROM {base}
    UNION ALL
    SELECT g, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16, n
), {name}_side AS MATERIALIZED (
    SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY g, lvl, pos // 16 ORDER BY pos)
), {name}_path AS (
    SELECT b.g, b.pos, coalesce(list({{'l': s.l, 'h': '', 'r': s.r}} ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL), []) AS path
    FROM {base} b LEFT JOIN {name}_side s ON s.g = b.g AND s.pos = b.pos // CAST(pow(16, s.lvl) AS BIGINT) GROUP BY b.g, b.pos
)"""


MANIFEST = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf("text")} AS leaf,
        CASE WHEN {CRC32} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
    FROM documents
), base AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM docs
), {_tree("low", "base")}, subs AS MATERIALIZED (
    SELECT CAST(0 AS BIGINT) AS g, g AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
), {_tree("top", "subs")}, whole AS (
    SELECT b.doc_id, b.leaf, b.changed, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(p.path, t.path) AS path
    FROM base b JOIN low_path p ON p.g = b.g AND p.pos = b.pos JOIN subs s ON s.pos = b.g JOIN top_path t ON t.pos = b.g
), done AS (
    SELECT *, list_reduce(list_concat([{{'l': '', 'h': coalesce(changed, leaf), 'r': ''}}], path),
        lambda a, b: {{'l': '', 'h': sha256(b.l || a.h || b.r), 'r': ''}}).h AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
