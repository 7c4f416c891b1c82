"""SQL (DuckDB's dialect) for the queries that SQL can express.

Chains of fitted models, XXH64 fingerprints, subword ids and attention are beyond it; the tests hold those against brute-force versions.
"""

from millrace.llm import mixing, secrets, urls


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(words: tuple[str, ...]) -> str:
    """Alternatives with every letter in both cases, ASCII only."""
    return "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


#: The base rules as patterns whose matches have the least length where that is possible: (pattern, group, least).
_BASE_PATTERNS = {
    "assign": ("(" + _either_case(("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
}


def _secret_scan() -> str:
    parts = []
    for order, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        pattern, group, least = _BASE_PATTERNS.get(rule.kind, (rule.pattern, rule.group, rule.least))
        p = _quoted(pattern)
        parts.append(
            f"SELECT rid, '{rule.kind}' AS kind, {order} AS o, {least} AS least, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i "
            f"FROM (SELECT rid, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS gs, string_split_regex(t, {p}) AS ps FROM d)"
        )
    n_base = len(secrets.BASE_RULES)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
s AS (SELECT rid, kind, o, least, g, CAST(sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid, o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, length(m) AS n
  FROM f WINDOW w AS (PARTITION BY rid, o ORDER BY i)),
k AS (SELECT * FROM s WHERE length(g) >= least),
r AS (SELECT rid, {counts}, coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < {n_base}), '') AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (rid)"""


def _near_vectors(cosine: float = 0.98) -> str:
    return f"""WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS x, b.rid AS y, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
n AS (SELECT x AS rid, count(*) AS n_links FROM l GROUP BY x),
c AS (SELECT r.x AS rid, min(e.vec_id) AS low FROM reach r JOIN e ON r.y = e.rid GROUP BY r.x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, CAST(least(vec_id, coalesce(low, vec_id)) AS BIGINT) AS component_id, coalesce(vec_id = least(vec_id, coalesce(low, vec_id)), FALSE) AS kept FROM e LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)"""


def _url_filter() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ranked = sorted(urls.HOST_RULES, key=lambda r: -len(r.text))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ranked) + " END"
    action = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.action}'" for r in ranked)
    globs = " OR ".join("whole LIKE " + _quoted(g.replace("*", "%").replace("?", "_")) for g in urls.BLOCK_GLOBS)  # none holds a % or _
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, {rule} AS rule, '.' || translate(array_to_string(list_transform(regexp_extract_all(host || chr(1) || path, '%[0-9A-Fa-f][0-9A-Fa-f]|[\\s\\S]'), lambda x: CASE WHEN length(x) = 3 AND regexp_full_match(chr(CAST('0x' || substr(x, 2) AS INTEGER)), '[A-Za-z0-9._~-]') THEN chr(CAST('0x' || substr(x, 2) AS INTEGER)) ELSE x END), ''), '{upper}', '{lower}') AS whole FROM b)
SELECT page_id, host, path, rule, {action} ELSE CASE WHEN {globs} THEN 'block' ELSE 'allow' END END AS verdict FROM c"""


def _source_mix() -> str:
    block, shard_docs, most_shards = mixing.BLOCK_WORDS, mixing.SHARD_DOCS, mixing.MAX_SHARDS
    weights = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)) + " END"
    return rf"""WITH d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
d AS (SELECT doc_id, source, size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':0:' || (row_number() OVER (PARTITION BY doc_id, source, size) - 1)) AS k FROM d0),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, least({most_shards}, CAST(ceil(count(*) / {shard_docs}) AS BIGINT)) AS n FROM d GROUP BY source),
s1 AS (SELECT *, {weights} AS w, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s0),
s2 AS (SELECT *, 2.0 * source_size / w AS r FROM s1),
s3 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest, sum(w) OVER (ORDER BY r, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s2),
s4 AS (SELECT *, rest * w / open_w > 2.0 * source_size OR source_size = 0 AS capped FROM s3),
s5 AS (SELECT *, max(CASE WHEN NOT capped THEN rest END) OVER () AS last_rest, sum(CASE WHEN NOT capped THEN w END) OVER () AS last_w FROM s4),
t AS (SELECT source, i, n, source_size, CAST(CASE WHEN capped THEN 2.0 * source_size ELSE CAST(last_rest AS DOUBLE) * w / last_w END AS DOUBLE) AS target FROM s5),
p AS (SELECT d.*, t.i, t.source_size, t.target, CAST('0x' || substr(k, 1, 8) AS BIGINT) % t.n AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT i, shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / {block}) AS BIGINT) AS blocks FROM p GROUP BY i, shard),
q0 AS (SELECT t.i, t.target, sum(2 * h.blocks) AS cap FROM t JOIN h USING (i) GROUP BY t.i, t.target),
q1 AS (SELECT i, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, i) AS place FROM (SELECT i, target, unnest(range(CAST(cap AS BIGINT))) AS k FROM q0 WHERE target > 0)),
q2 AS (SELECT i, count(*) AS seats FROM q1 WHERE place <= (SELECT floor(1.5 * sum(source_size) / {block} + 0.5) FROM t) GROUP BY i),
q3 AS (SELECT i, shard, row_number() OVER (PARTITION BY i ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, shard) AS place FROM (SELECT i, shard, words, unnest(range(2 * blocks)) AS k FROM h WHERE words > 0)),
q4 AS (SELECT q3.i, q3.shard, count(*) AS quota FROM q3 JOIN q2 ON q3.i = q2.i AND q3.place <= q2.seats GROUP BY q3.i, q3.shard),
o AS (SELECT p.*, coalesce(q4.quota, 0) AS quota, greatest(h.blocks, 1) AS blocks, sum(size) OVER (PARTITION BY p.i, p.shard ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begins FROM p JOIN h ON p.i = h.i AND p.shard = h.shard LEFT JOIN q4 ON p.i = q4.i AND p.shard = q4.shard)
SELECT doc_id, size, source_size, target, CAST((quota // blocks) * size + greatest(0, least(size, (quota % blocks) * {block} - begins)) AS BIGINT) AS taken FROM o"""


def _top_k() -> str:
    return """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.rid <> q.rid AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _secret_scan(),
    "op3_embedding_near_dedup": _near_vectors(),
    "op4_url_filter": _url_filter(),
    "op5_source_mix": _source_mix(),
    "op8_exact_topk": _top_k(),
}
