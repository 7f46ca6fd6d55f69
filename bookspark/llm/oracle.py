"""DuckDB SQL with the same rows, for the queries that SQL can express."""

ORACLE: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
          FROM embeddings
          WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op2_warc_conversion": """
        WITH p AS (
          SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                 sha1(coalesce(html, '')) AS payload_digest
          FROM pages
        ), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM g
    """,
    "op4_line_dedup": """
        WITH l AS (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
          FROM documents
        ), w AS (
          SELECT doc_id, line_no, list_sort(list_distinct(list_filter(
                   regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> ''))) AS words
          FROM l
        ), d AS (
          SELECT words, len(words) AS n, min(doc_id * 1000000 + line_no) AS first FROM w WHERE len(words) > 0 GROUP BY words
        ), m AS (
          SELECT DISTINCT y.first
          FROM d x JOIN d y ON x.first < y.first AND x.n >= 0.8 * y.n - 1e-9 AND y.n >= 0.8 * x.n - 1e-9
          WHERE len(list_intersect(x.words, y.words)) >= ceil((x.n + y.n) * (0.8 / 1.8) - 1e-9)
        ), gone AS (
          SELECT w.doc_id, list(CAST(w.line_no AS INTEGER) ORDER BY w.line_no) AS removed
          FROM w JOIN d USING (words) LEFT JOIN m ON m.first = d.first
          WHERE m.first IS NOT NULL OR w.doc_id * 1000000 + w.line_no <> d.first
          GROUP BY w.doc_id
        )
        SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines,
               CAST(coalesce(len(removed), 0) AS INTEGER) AS n_removed, coalesce(removed, []::INTEGER[]) AS removed_lines
        FROM documents LEFT JOIN gone USING (doc_id)
    """,
    "op12_filter_audit": """
        WITH d AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words,
                 min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
          FROM documents
        ), l AS (
          SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id
        ), f AS (
          SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
                   len(words) < 200,
                   100 * len(list_distinct(words)) < 50 * len(words),
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                   regexp_matches(text, '[#$%&*|]'),
                   coalesce(doc_id > first, false)] AS fails
          FROM d LEFT JOIN l USING (doc_id)
        ), c AS (
          SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS o
          FROM letters a, letters b, letters c, letters d, letters e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), s AS (
          SELECT o AS filter_order, step, strpos('ABCDE', substr(o, step, 1)) AS mine,
                 list_transform(range(1, step), lambda k: strpos('ABCDE', substr(o, k, 1))) AS before
          FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
        ), m AS (
          SELECT part, filter_order, step, mine, n, good, toxic, fails[mine] AS bad,
                 len(list_filter(before, lambda k: fails[k])) > 0 AS gone,
                 len(list_filter(fails, lambda v: v)) = 1 AS alone
          FROM c, s
        ), t AS (
          SELECT part, filter_order, step, mine,
                 CAST(sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS BIGINT) AS kept,
                 CAST(sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS BIGINT) AS removed,
                 CAST(sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS BIGINT) AS redundant,
                 CAST(sum(CASE WHEN bad AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
                 CAST(sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS BIGINT) AS good_lost,
                 CAST(sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
          FROM m GROUP BY part, filter_order, step, mine
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, mine) AS BIGINT) AS shapley
        FROM t
    """,
}
