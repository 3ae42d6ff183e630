"""DuckDB SQL for the registered queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

op3_contamination = rf"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, greatest(0, len(w) - size + 1) + 1)) AS t(i)
), found AS (SELECT r, i, size, item FROM grams JOIN windows USING (size, gram)),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

op7_top_k = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""

op1_warc = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d"""


def _secrets() -> str:
    from .secrets import BASE, MORE

    rules = [*BASE, *MORE]
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT r, {i} AS kind, '{r.kind}' AS name, m, v,
         list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda g: length(g))), 0) AS start
  FROM (SELECT r, found, gaps, unnest(found) AS m, unnest(vals) AS v, unnest(range(1, len(found) + 1)) AS j
        FROM (SELECT r, regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {r.group}) AS vals, regexp_split_to_array(text, '{p}') AS gaps FROM d))
  WHERE length(v) >= {r.least}""")
    count = lambda i: f"coalesce(count(*) FILTER (WHERE kind = {i}), 0)"
    listed = lambda where: f"string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE {where})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {", ".join(f"{count(i)} AS n_{x.kind}" for i, x in enumerate(BASE))},
       sha256(coalesce({listed(f"kind < {len(BASE)}")}, '')) AS base_sha256, coalesce({listed("true")}, '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""


op4_secrets = _secrets()

op2_ngram_join = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), runs AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0
), sets AS (SELECT r, md5(string_agg(s, '|' ORDER BY s)) AS k, count(*) AS n FROM runs GROUP BY r),
classes AS (SELECT k, min(r) AS r, any_value(n) AS n, count(*) AS copies, min(doc_id) AS copy_id FROM sets JOIN d USING (r) GROUP BY k),
reps AS (SELECT k, n, s FROM classes JOIN runs USING (r)),
links AS (
  SELECT a.k AS a, b.k AS b FROM reps a JOIN reps b ON a.s = b.s AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
), reach(k, l) AS (
  SELECT k, k FROM classes UNION SELECT reach.k, links.b FROM reach JOIN links ON reach.l = links.a
), grouped AS (SELECT reach.k, min(copy_id) AS class_id FROM reach JOIN classes ON classes.k = reach.l GROUP BY reach.k),
others AS (SELECT a AS k, sum(copies) AS n FROM links JOIN classes ON classes.k = links.b GROUP BY a)
SELECT d.doc_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(class_id, d.doc_id) AS class_id,
       CAST(coalesce(copies - 1, 0) + coalesce(others.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN sets USING (r) LEFT JOIN classes ON classes.k = sets.k LEFT JOIN grouped ON grouped.k = sets.k LEFT JOIN others ON others.k = sets.k"""

op6_line_dedup = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, line, list_sort(list_distinct(regexp_extract_all(lower(body), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM d WHERE text IS NOT NULL)
), c AS (SELECT w, len(w) AS n, row_number() OVER () AS id, min((doc_id, line)) AS place FROM l WHERE len(w) > 0 GROUP BY w),
tokens AS (SELECT id, n, unnest(w) AS t FROM c),
often AS (SELECT t, count(*) AS df FROM tokens GROUP BY t),
ordered AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS nth FROM tokens JOIN often USING (t)),
prefix AS (SELECT id, n, t FROM ordered WHERE nth <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.id < b.id AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
links AS (
  SELECT x.id AS a, y.id AS b, x.place AS pa, y.place AS pb FROM near JOIN c x ON x.id = near.a JOIN c y ON y.id = near.b
  WHERE len(list_intersect(x.w, y.w)) * 5 >= 4 * (x.n + y.n - len(list_intersect(x.w, y.w)))
), late AS (SELECT CASE WHEN pa > pb THEN a ELSE b END AS id FROM links),
gone AS (
  SELECT l.r, l.line FROM l JOIN c ON c.w = l.w
  WHERE (l.doc_id, l.line) > c.place OR c.id IN (SELECT id FROM late)
), listed AS (SELECT r, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(lines, '') AS removed_lines
FROM d LEFT JOIN listed USING (r)"""


def _funnels() -> str:
    from .queries import FUNNELS

    size = len(FUNNELS[0].steps)
    steps = "SELECT funnel, client_id, t AS t1 FROM e JOIN f ON kind = k1"
    parts = [f"s1 AS ({steps})"]
    for k in range(2, size + 1):
        parts.append(f"""a{k} AS (SELECT s.*, t{k - 1} AS prev, k{k} AS wanted, x FROM s{k - 1} s JOIN f USING (funnel) WHERE t{k - 1} IS NOT NULL),
b{k} AS (SELECT a.*, e.t AS t{k} FROM a{k} a ASOF LEFT JOIN e ON a.client_id = e.client_id AND a.wanted = e.kind AND a.prev < e.t),
c{k} AS (SELECT b.*, e.t AS barred FROM b{k} b ASOF LEFT JOIN e ON b.client_id = e.client_id AND b.x = e.kind AND b.prev < e.t),
s{k} AS (SELECT * EXCLUDE (prev, wanted, x, barred, t{k}), CASE WHEN t{k} <= t1 + INTERVAL 5 MINUTE AND (barred IS NULL OR barred > t{k}) THEN t{k} END AS t{k} FROM c{k})""")
    took = " UNION ALL ".join(f"SELECT funnel, client_id, {k} AS step, date_diff('microsecond', t{k - 1}, t{k}) AS dt FROM s{k} WHERE t{k} IS NOT NULL" for k in range(2, size + 1))
    names = ", ".join(f"('{f.name}', {', '.join(repr(s) for s in f.steps)}, '{f.excluded}')" for f in FUNNELS)
    return f"""
WITH e AS (SELECT DISTINCT client_id, kind, arrived_at AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f(funnel, {", ".join(f"k{k}" for k in range(1, size + 1))}, x) AS (VALUES {names}),
{", ".join(parts)},
took AS (SELECT funnel, client_id, 1 AS step, 0 AS dt FROM s1 UNION ALL {took}),
placed AS (SELECT *, row_number() OVER (PARTITION BY funnel, client_id, step ORDER BY dt) AS nth, count(*) OVER (PARTITION BY funnel, client_id, step) AS n FROM took),
each AS (
  SELECT funnel, client_id, {", ".join(f"count(*) FILTER (WHERE step = {k}) AS n{k}" for k in range(1, size + 1))}, max(step) AS deepest,
         {", ".join(f"min(dt) FILTER (WHERE step = {k} AND nth = (25 * n + 99) // 100) AS t{k}" for k in range(2, size + 1))}
  FROM placed GROUP BY funnel, client_id
)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM each"""


op13_funnels = _funnels()

_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

op11_ranked_search = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_RUNS} AS words FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(words)) AS BIGINT) AS L FROM d WHERE len(words) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_RUNS}) AS words FROM benchmark),
wanted AS (SELECT i, unnest(words) AS word FROM i),
p AS (SELECT r, word, count(*) AS tf FROM (SELECT r, unnest(words) AS word FROM d) WHERE word IN (SELECT word FROM wanted) GROUP BY r, word),
w AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, totals GROUP BY word, N),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(words) * N) // L AS m FROM d, totals WHERE len(words) > 0),
scores AS (
  SELECT i, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN p USING (word) JOIN w USING (word) JOIN m USING (r) GROUP BY i, r
), ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scores JOIN m USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (i) WHERE rank <= 10"""
