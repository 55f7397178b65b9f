"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_SPACES, _MARKS = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(string_split_regex({text}, '{breaks}'), lambda x: x <> '')"


def sharding(limit: int) -> str:
    """A document's shard is its shortest hash prefix whose documents fit the limit or can't be told apart."""
    return f"""WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9) || substr(md5(coalesce(text, '')), 1, 6) AS BIGINT)), 60, '0') AS bits FROM documents),
e AS (SELECT d.*, CAST(r.depth AS INTEGER) AS depth, substr(bits, 1, r.depth) AS shard FROM d, range(0, 61) r(depth)),
n AS (SELECT depth, shard, sum(n_bytes) AS b, min(bits) = max(bits) AS single FROM e GROUP BY depth, shard),
f AS (SELECT e.doc_id, e.n_bytes, e.depth, e.shard, CAST(n.b AS BIGINT) AS b, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS r FROM e JOIN n USING (depth, shard) WHERE n.b <= {limit} OR n.single OR e.depth = 60)
SELECT doc_id, n_bytes, depth AS shard_depth, shard, b AS shard_bytes FROM f WHERE r = 1"""


SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACES)} AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM i), gone AS (SELECT DISTINCT doc_id, g.i + j.j AS p FROM g, range(0, 20) j(j) WHERE r > 1),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w), k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN gone USING (doc_id, p) GROUP BY p.doc_id), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = f"""WITH b AS (SELECT item_id, {_words(_LOWER, _MARKS)} AS ws FROM benchmark), bm AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0), bi AS (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM bm), bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS t FROM bi),
d AS (SELECT doc_id, {_words(_LOWER, _MARKS)} AS ws FROM documents), l AS (SELECT DISTINCT m FROM bw), di AS (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, l WHERE len(ws) >= m), dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS t FROM di),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw USING (m, t)), n AS (SELECT doc_id, count(DISTINCT h.i + j.j) AS n_hit FROM h, range(0, 10) j(j) WHERE j.j < h.m GROUP BY doc_id), s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""
