"""What the contracts of operators 1, 6, 10 and 13 ask for, in DuckDB's SQL: plain joins without an index."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def decontamination(window: int = 13) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    pattern AS (
        SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (SELECT item, w, least(len(w), {window}) AS size, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM item WHERE len(w) > 0)),
    place AS (
        SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
        FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM pattern) WHERE len(w) >= size)),
    hit AS (SELECT rid, i, size, item FROM place JOIN pattern USING (size, phrase)),
    word AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY rid),
    named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(word.n, 0) > 0 AND 20 * coalesce(word.n, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN word USING (rid) LEFT JOIN named USING (rid)"""


def top_k(k: int = 20, scale: int = 64, query_step: int = 20) -> str:
    return f"""
    WITH vector AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    query AS (SELECT DISTINCT vec_id AS query_id, v AS q FROM vector WHERE vec_id % {query_step} = 0),
    ranked AS (
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank
        FROM (SELECT query_id, q, vec_id, CAST(list_inner_product(q, v) AS BIGINT) AS score FROM query JOIN vector ON vec_id <> query_id))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def substrings(window: int = 35) -> str:
    return rf"""
    WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    place AS (
        SELECT rid, i, array_to_string(w[i:i + {window - 1}], ' ') AS phrase
        FROM (SELECT rid, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM doc WHERE len(w) >= {window})),
    repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY phrase) AS n FROM place) WHERE n > 1),
    gone AS (SELECT DISTINCT rid, pos FROM (SELECT rid, unnest(range(i, i + {window})) AS pos FROM repeated)),
    word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc),
    kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN gone USING (rid, pos) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM doc LEFT JOIN kept USING (rid)"""


def centroids(clusters: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round as two steps of its own: the nearest centroid of each vector, then the floor of each mean."""
    steps = [f"""
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    hashed AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v FROM kept),
    c0 AS MATERIALIZED (SELECT k, v FROM hashed WHERE k < {clusters})"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (
        SELECT rid, vec_id, v, k, d FROM (
            SELECT rid, vec_id, kept.v, k, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (kept.v[i] - c{r}.v[i]) * (kept.v[i] - c{r}.v[i]))) AS d FROM kept, c{r})
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""
    m{r} AS (
        SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
        FROM (SELECT k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS y, unnest(range({dimensions})) AS i FROM a{r}) GROUP BY k, i) GROUP BY k),
    c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (k))""")
    return "WITH" + ",".join(steps) + f"""
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (k)"""
