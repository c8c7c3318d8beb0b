"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
    WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM norm
"""


def clustering(dimensions: int = 64, centroids: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and whole-number means, a chain of table expressions.

    v has a row for each kept vector, s0 ... the centroids of each round, a0 ...
    the nearest centroid of each vector.
    """
    parts = [
        f"""kept AS (
            SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = {dimensions})""",
        f"""s0 AS (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
            FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT {centroids}))""",
    ]
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS (
            SELECT n, c, list_sum(list_transform(list_zip(kept.v, s{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
            FROM kept, s{k})""")
        parts.append(f"a{k} AS (SELECT n, min(distance) AS distance, arg_min(c, (distance, c)) AS c FROM d{k} GROUP BY n)")
        if k < rounds:
            parts.append(f"""m{k} AS (
                SELECT c, i, sum(x) AS s, count(*) AS m
                FROM (SELECT a{k}.c, unnest(kept.v) AS x, generate_subscripts(kept.v, 1) AS i FROM a{k} JOIN kept USING (n))
                GROUP BY c, i)""")
            # // rounds towards zero, so the remainder is taken off first.
            parts.append(f"""s{k + 1} AS (
                SELECT s{k}.c, coalesce(w.v, s{k}.v) AS v
                FROM s{k} LEFT JOIN (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM m{k} GROUP BY c) w USING (c))""")
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, a.c::INTEGER AS cluster, distance,
               (sum(distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(s.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept USING (n) JOIN s{rounds} s ON s.c = a.c
    """


ORACLE_SQL = {"op1_exact_dedup": OP1, "op13_centroid_clustering": clustering()}
