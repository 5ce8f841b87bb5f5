"""DuckDB SQL for the operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM.format(ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
b AS (SELECT item_id, {ALNUM.format(ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM p),
w AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)),
h AS (SELECT w.doc_id, w.k, w.i, p.item_id FROM w JOIN p ON p.k = w.k AND p.s = w.s),
hit AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (h) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPLIT.format(ASCII_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS z FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.z),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""

#: Every anchor against every row, by the integers of their vectors.
HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

#: crc32 by its usual table of 256 entries, made here from its polynomial.
PANES = """
WITH polynomial AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
k AS (SELECT click_id, ts, coalesce(arrived_at, ts) AS arrived, coalesce(kind, 'none') AS kind, coalesce(floor(100 * CASE WHEN isfinite(value) THEN value END + 0.5), 0)::BIGINT AS cents, coalesce(click_id::VARCHAR, '') AS text FROM clicks WHERE ts IS NOT NULL),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(text) + 1), lambda i: ascii(text[i])::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc, date_diff('day', DATE '1970-01-01', arrived::DATE) AS d FROM k, polynomial),
e AS (SELECT click_id, kind, cents, ts - to_days((d - ((d % 8 + 8) % 8))::INTEGER) AS et, least(7, (d % 8 + 8) % 8 + greatest(0, crc % 30 - 23)) AS batch FROM c),
r AS (SELECT *, floor(epoch_us(et) / 3600000000)::BIGINT AS hour, epoch_us(et) AS us FROM (SELECT DISTINCT ON (click_id) * FROM e ORDER BY click_id, et, batch, cents, kind)),
b AS (SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM (SELECT i AS batch, max(us) AS m FROM range(8) x(i) LEFT JOIN r ON r.batch = i GROUP BY 1)),
j AS (SELECT r.*, coalesce(b.w >= (hour + 1) * 3600000000 + 4 * 86400000000, false) AS late FROM r JOIN b USING (batch)),
a AS (SELECT batch, kind, hour, count(*) AS n, sum(cents) AS cents FROM j WHERE NOT late GROUP BY ALL),
t AS (SELECT batch, kind, hour, sum(n) OVER w AS n, sum(cents) OVER w AS cents, min(batch) OVER (PARTITION BY kind, hour) AS first FROM a WINDOW w AS (PARTITION BY kind, hour ORDER BY batch)),
u AS (SELECT kind, hour, min(b.batch) AS emitted FROM (SELECT DISTINCT kind, hour, first FROM t) p LEFT JOIN b ON b.batch >= first AND b.w >= (hour + 7) * 3600000000 GROUP BY ALL),
o AS (SELECT t.*, emitted FROM t JOIN u USING (kind, hour)),
told AS (
SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM j WHERE late
UNION ALL SELECT coalesce(max(emitted), 7), hour, -1, max_by(n, batch), max_by(cents, batch), CASE WHEN max(emitted) IS NULL THEN 'final' ELSE 'emit' END, kind FROM o WHERE emitted IS NULL OR batch <= emitted GROUP BY kind, hour
UNION ALL SELECT batch, hour, -1, n, cents, 'replace', kind FROM o WHERE batch > emitted
UNION ALL SELECT batch, hour, -1, old_n, old_cents, 'retract', kind FROM (SELECT *, lag(n) OVER w AS old_n, lag(cents) OVER w AS old_cents FROM o WINDOW w AS (PARTITION BY kind, hour ORDER BY batch)) WHERE batch > emitted)
SELECT batch::BIGINT AS batch, hour, coalesce(click_id, -1) AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM told"""
