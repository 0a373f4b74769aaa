"""DuckDB SQL for the queries that SQL can express."""

#: What a conversation that consists of control strings adds to the table.
_CHATS = """(SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"""

ORACLE_SQL = {
    "op4_chat": f"""
        WITH c AS (SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '([<\\[])(/?(?:SYS|INST|TOOL|ROLE)\\]|:\\]|/?s>)', '\\1\\\\\\2', 'g') AS escaped,
            lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || '>' || role AS step FROM {_CHATS}),
        m AS (SELECT *, step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant') AS fine FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(escaped) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'tool' THEN 13 ELSE 16 + length(replace(role, '\\', '\\\\')) + len(regexp_extract_all(role, '[<\\[](?:/?(?:SYS|INST|TOOL|ROLE)\\]|:\\]|/?s>)')) END) AS BIGINT) AS formatted_chars,
            CASE WHEN bool_and(fine) THEN arg_max(role, place) ELSE 'error' END AS state, bool_and(fine) AND arg_max(role, place) = 'assistant' AS valid
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM m) GROUP BY conv_id
    """,
    "op5_embed_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
        SELECT c.vec_id, CAST((SELECT count(*) FROM l WHERE l.x = c.vec_id) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """,
    "op9_substring": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        t AS (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
        k AS (SELECT doc_id, i, sha256(array_to_string(ws[i + 1 : i + 20], ' ')) AS h FROM t),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
        g AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) AS r(j) WHERE n > 1),
        x AS (SELECT doc_id, ws[p + 1] AS word, p FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM w)),
        y AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN y ON w.doc_id = y.doc_id
    """,
}
