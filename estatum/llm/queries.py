"""Queries of this folder, by name, and their SQL twins where SQL can express them."""

from __future__ import annotations

from estatum.llm import language_model, media, mixing, neardup, neighbours, packing, secrets, substrings, topk, toxicity, trie, warc, whitening


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_substrings": substrings.op2_substrings,
        "op3_neardup": neardup.op3_neardup,
        "op4_language_model": language_model.op4_language_model,
        "op5_warc": warc.op5_warc,
        "op6_secrets": secrets.op6_secrets,
        "op7_neighbours": neighbours.op7_neighbours,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_packing": packing.op9_packing,
        "op10_mixing": mixing.op10_mixing,
        "op11_topk": topk.op11_topk,
        "op12_whitening": whitening.op12_whitening,
        "op13_trie": trie.op13_trie,
    }


#: Base32 of a SHA-1 digest of 40 hex digits ``d``: 5 bits a symbol, of two neighbouring digits.
BASE32 = "array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((strpos('0123456789abcdef', substr(d, CAST(5 * k // 4 + 1 AS INT), 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(d, CAST(5 * k // 4 + 2 AS INT), 1)) - 1, 0)) >> (3 - 5 * k % 4) & 31 AS INT) + 1, 1)), '')"
#: CRC-32 of the decimal ``c``, bit by bit.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(c) + 1), lambda i: CAST(ascii(substr(c, CAST(i AS INT), 1)) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
SQL = {
    "op5_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM f""",
    "op11_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op13_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM t),
 h AS (SELECT conv_id, {CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM t)),
 r AS (SELECT h.conv_id, 0 AS own, pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 WHERE pos <= h UNION ALL SELECT conv_id, 1, pos, role, text FROM h JOIN o USING (conv_id) WHERE pos > h),
 s AS (SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, pos) FILTER (own IS NOT NULL), []) AS turns FROM h LEFT JOIN r USING (conv_id) GROUP BY 1),
 p AS (SELECT conv_id, d, to_json(list_slice(turns, 1, d)) AS path, CASE WHEN d > 0 THEN to_json(list_slice(turns, 1, d - 1)) END AS parent, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars, d = len(turns) AS ends FROM s, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
 n AS (SELECT path, d, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, d),
 k AS (SELECT parent AS path, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
 u AS (SELECT p.path, sum(n.saved) AS saved, count(*) FILTER (k.n_children IS NULL) AS n_leaves FROM n LEFT JOIN k ON n.path = k.path JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY 1)
 SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256 FROM n JOIN u ON n.path = u.path LEFT JOIN k ON n.path = k.path LEFT JOIN n m ON n.parent = m.path""",
}


def oracle_sql() -> dict[str, str]:
    """Operators whose whole result SQL can say; the others are held against brute force."""
    return SQL
