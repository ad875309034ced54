"""DuckDB SQL for the corpus queries that SQL can state."""

from __future__ import annotations

OP5 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, trim(coalesce(url, '')) AS u FROM pages),
     h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s, u, regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS whole,
                  regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS x FROM p),
     c AS (SELECT *, 1704067200 + page_id % 1000000000 AS capture_ts,
                  CASE WHEN whole THEN lower(array_to_string(list_reverse(string_split(regexp_replace(lower(x.host), '^www\.', ''), '.')), ',') || ')' || CASE WHEN x.path = '' THEN '/' ELSE x.path END || x.query)
                       ELSE lower(u) END AS url_key FROM h),
     l AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS last, row_number() OVER (ORDER BY url_key, capture_ts, page_id) - 1 AS capture_rank FROM c),
     q AS (SELECT *, [CAST('0x' || substr(s, 1 + 10 * i, 10) AS BIGINT) FOR i IN range(4)] AS g FROM l)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((v >> (35 - 5 * j)) & 31 AS INT), 1) FOR j IN range(8)] FOR v IN g]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to,
       url_key, capture_ts, capture_rank
FROM q
"""

OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS a FROM d),
     k AS (SELECT doc_id, a, row_number() OVER (PARTITION BY array_to_string(list_slice(w, a, a + 19), ' ') ORDER BY doc_id, a) AS r FROM i),
     g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS p FROM k WHERE r > 1),
     l AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
     t AS (SELECT l.doc_id, string_agg(x, ' ' ORDER BY l.p) AS kept, count(*) AS n FROM l ANTI JOIN g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
           FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     f AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS t(k)) GROUP BY ALL HAVING count(*) >= 30),
     c AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
     u AS (SELECT c.lang, c.phrase, c.a, j, h.a AS l, t.a AS r, (2000000 * CAST(c.a AS HUGEINT)) // (CAST(h.a AS HUGEINT) + t.a) AS score
           FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.v[:j], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.v[j + 1:], ' ')),
     b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM u) WHERE o = 1),
     d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.k > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * CAST(c.a AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT)),
     s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, (SELECT CAST(sum(len(w.w)) AS BIGINT) FROM w WHERE w.lang = s.lang) AS n, CAST(score AS BIGINT) AS score FROM s WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op3_substring_dedup": OP3, "op5_warc": OP5, "op8_exact_topk": OP8, "op11_phrase_collocations": OP11}
