"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
    FROM v AS q JOIN v ON v.vec_id <> q.vec_id
    WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP2 = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""

OP6 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), d AS (
    SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP9 = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), x AS (
    SELECT *, length(replace(replace(text, '\', '\b'), '<', '\l'))
              + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
              + length('<turn ') + length('>') + length('</turn>') + 1 AS chars
    FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachment_tokens
FROM x GROUP BY conv_id
"""

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_OTHERS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 byte by byte (the polynomial is a fixed value), then both trees.
OP12 = f"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda acc, x: CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END) AS v
        FROM range(256) AS r(i))
), d AS (
    SELECT *, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]))) AS crc
    FROM documents, crc_table
), l AS (
    SELECT doc_id, source, sha256({_OTHERS} || {_FIELD.format("text")}) AS leaf,
           CASE WHEN crc % 5 = 0 THEN sha256({_OTHERS} || {_FIELD.format(_LOWER)}) END AS tampered
    FROM d
), ranked AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
           count(*) OVER (PARTITION BY source) AS n
    FROM l
), nodes AS (
    SELECT tree, 0 AS height, rank, n, leaf AS digest FROM ranked
    UNION ALL
    SELECT tree, height + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
    FROM nodes WHERE n > 1 GROUP BY tree, height, rank // 16, n
), roots AS (
    SELECT tree AS rank, digest, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
    SELECT 0 AS height, rank, n, digest FROM roots
    UNION ALL
    SELECT height + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
    FROM top WHERE n > 1 GROUP BY height, rank // 16, n
), steps AS (
    SELECT a.tree, a.height, a.rank,
           coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS below,
           coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS above
    FROM nodes AS a JOIN nodes AS b ON a.tree = b.tree AND a.height = b.height AND a.rank // 16 = b.rank // 16
    WHERE a.n > 1 GROUP BY a.tree, a.height, a.rank
), top_steps AS (
    SELECT a.height, a.rank,
           coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS below,
           coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS above
    FROM top AS a JOIN top AS b ON a.height = b.height AND a.rank // 16 = b.rank // 16
    WHERE a.n > 1 GROUP BY a.height, a.rank
), places AS (
    SELECT r.tree, r.rank, s.height, s.below, s.above
    FROM ranked AS r JOIN steps AS s ON s.tree = r.tree AND s.rank = r.rank >> CAST(4 * s.height AS BIGINT)
    UNION ALL
    SELECT r.tree, r.rank, 1000 + s.height, s.below, s.above
    FROM ranked AS r JOIN top_steps AS s ON s.rank = r.tree >> CAST(4 * s.height AS BIGINT)
), proofs AS (
    SELECT tree, rank, list(struct_pack(b := below, a := above) ORDER BY height) AS proof FROM places GROUP BY tree, rank
), whole AS (
    SELECT r.doc_id, r.leaf, coalesce(r.tampered, r.leaf) AS start, roots.digest AS subroot,
           (SELECT digest FROM top WHERE n = 1) AS root, coalesce(p.proof, []) AS proof
    FROM ranked AS r JOIN roots ON roots.rank = r.tree LEFT JOIN proofs AS p ON p.tree = r.tree AND p.rank = r.rank
), done AS (
    SELECT *, list_reduce(list_prepend(struct_pack(b := start, a := ''), proof),
                          lambda acc, s: struct_pack(b := sha256(s.b || acc.b || s.a), a := '')).b AS folded_root
    FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s.b || s.a), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM done
"""

ORACLES = {"op1_top_k": OP1, "op2_exact_dedup": OP2, "op6_warc": OP6, "op9_chat_format": OP9, "op12_merkle": OP12}
