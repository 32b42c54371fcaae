"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: The smallest id that links lead to, from lk (a, b), both directions of each link; every id of `all_` is its own at least.
_REACH = "re(id, c) AS (SELECT id, id FROM all_ UNION SELECT lk.b, re.c FROM re JOIN lk ON lk.a = re.id), cm AS (SELECT id, min(c) AS component_id FROM re GROUP BY 1)"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _squared(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"


def _rounds(points: str, keys: str, rounds: int) -> str:
    """a0, b1, a1, ...: nearest entries (keys, e, d) of `points` (vec_id, keys, x) among b0 (keys, e, x), and the entries after each round."""
    on = f"USING ({keys})" if keys else "ON true"
    own = f"{keys}, " if keys else ""
    out = []
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, {own}min(struct_pack(d := {_squared('q.x', 'b.x')}, e := e)) AS n FROM {points} q JOIN b{k} b {on} GROUP BY ALL)")
        if k < rounds:
            same = f"USING (vec_id, {keys})" if keys else "USING (vec_id)"
            mean = f"SELECT {own}n.e AS e, pos, CAST(floor(CAST(sum(x[pos]) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM a{k} JOIN {points} q {same}, range(1, (SELECT max(len(x)) + 1 FROM {points})) r(pos) GROUP BY ALL"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT {own}e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT {own}e, list(c ORDER BY pos) AS x FROM ({mean}) GROUP BY ALL) m USING ({own}e))")
    return ", ".join(out)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP3 = (
    f"WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), s AS MATERIALIZED (SELECT id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w), all_ AS (SELECT id, len(s) AS n FROM s), "
    "e AS MATERIALIZED (SELECT id, unnest(s) AS x FROM s), pr AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.id <> q.id GROUP BY ALL), "
    f"lk AS MATERIALIZED (SELECT a, b FROM pr JOIN all_ p ON p.id = a JOIN all_ q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)), {_REACH} "
    "SELECT id AS doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM all_ JOIN cm USING (id)"
)
OP7 = (
    f"WITH RECURSIVE all_ AS (SELECT vec_id AS id FROM embeddings), u AS MATERIALIZED (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    f"lk AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE CASE WHEN len(p.x) = len(q.x) THEN list_cosine_similarity(p.x, q.x) >= 0.93 END), {_REACH}, ln AS (SELECT a AS id, count(*) AS n FROM lk GROUP BY 1) "
    "SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM cm LEFT JOIN ln USING (id)"
)
OP9 = (
    f"WITH v AS MATERIALIZED (SELECT vec_id, {_whole(256)} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) > 0), s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.x) = len(d.x)) "
    "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"
)
OP11 = (
    f"WITH v AS MATERIALIZED (SELECT vec_id, label, {_whole(4096)} AS x FROM embeddings WHERE {_FINITE}), pt AS MATERIALIZED (SELECT vec_id, CAST(p AS INT) AS p, list_slice(x, p * len(x) // 8 + 1, (p + 1) * len(x) // 8) AS x FROM v, range(8) r(p)), "
    f"b0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INT) AS e, x FROM pt QUALIFY e < 16), {_rounds('pt', 'p', 6)}, "
    "dg AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6), cd AS (SELECT vec_id, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, CAST(sum(n.d) AS BIGINT) AS error FROM a6 GROUP BY 1) "
    "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM cd JOIN v USING (vec_id), dg"
)
OP12 = (
    f"WITH v AS MATERIALIZED (SELECT vec_id, {_whole(256)} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = 64), b0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS e, x FROM v QUALIFY e < 40), {_rounds('v', '', 5)}, "
    "nm AS (SELECT e, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM b5) "
    "SELECT vec_id, n.e AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.e) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a5 JOIN nm ON nm.e = a5.n.e"
)
OP13 = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p), t AS (SELECT *, n >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM g) "
    "SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM t"
)
