"""DuckDB twins of the queries that SQL can express."""
from __future__ import annotations

_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_TRIM})")} AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id < c.last_doc AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_SPANS = """
  SELECT doc_id, source, {kind} AS kind, pos, m,
         {value} AS value,
         sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS start
  FROM (SELECT doc_id, source,
               unnest(regexp_extract_all(text, {pat})) AS m,
               generate_subscripts(regexp_extract_all(text, {pat}), 1) AS pos,
               unnest(list_slice(string_split_regex(text, {pat}), 1, len(regexp_extract_all(text, {pat})))) AS p
        FROM documents)
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
"""
_ANY = "".join  # letters in either case, spelt out: the engine's own case folding knows more letters than A-Z


def _either(word: str) -> str:
    return _ANY(f"[{c}{c.upper()}]" for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_ASSIGN = f"'(?:{_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+'"
_ASSIGN_HEAD = f"'^(?:{_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?'"

OP3 = f"""
WITH spans AS (
  {_SPANS.format(kind=0, pat=_ASSIGN, value=f"regexp_replace(m, {_ASSIGN_HEAD}, '')")}
  UNION ALL {_SPANS.format(kind=1, pat="'AKIA[A-Z0-9]+'", value="m")}
  UNION ALL {_SPANS.format(kind=2, pat="'[0-9a-f]{16,}'", value="m")}
  UNION ALL {_SPANS.format(kind=3, pat="'[A-Za-z0-9+/_=-]{20,}'", value="m")}),
good AS (
  SELECT doc_id, source, kind, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS stop, value
  FROM spans
  WHERE (kind = 0 AND length(value) >= 12) OR (kind = 1 AND length(m) >= 18) OR kind = 2
     OR (kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]'))),
owners AS (SELECT value, count(DISTINCT source) AS n_owners FROM good GROUP BY value),
final AS (
  SELECT g.*, o.n_owners >= 3 AS example,
         ['assign', 'access', 'hex', 'live'][g.kind + 1] || ':' || g.start || ':' || g.stop AS said
  FROM good g JOIN owners o ON g.value = o.value
  WHERE g.kind < 3 OR (o.n_owners < 3 AND NOT EXISTS (
    SELECT 1 FROM good b WHERE b.doc_id = g.doc_id AND b.kind < 3 AND b.start < g.stop AND g.start < b.stop)))
SELECT d.doc_id, count(f.doc_id) FILTER (f.kind = 0) AS n_assign, count(f.doc_id) FILTER (f.kind = 1) AS n_access,
       count(f.doc_id) FILTER (f.kind = 2) AS n_hex, count(f.doc_id) FILTER (f.kind = 3) AS n_live,
       sha256(coalesce(string_agg(f.said, ',' ORDER BY f.start, f.kind) FILTER (f.kind < 3), '')) AS base_sha256,
       coalesce(string_agg(f.said, ',' ORDER BY f.start, f.kind), '') AS spans,
       count(f.doc_id) FILTER (f.example) AS n_example
FROM documents d LEFT JOIN final f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""

_WORDS = "list_filter(string_split_regex({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')".format(
    _LOWER.format("coalesce(text, '')"))

OP4 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) s)),
hit AS (SELECT dw.doc_id, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

_TOKENS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp ON d.doc_id = comp.doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT win.doc_id, p FROM win JOIN first ON win.s = first.s WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (
  SELECT words.doc_id, count(gone.q) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY words.q) FILTER (gone.q IS NULL), '') AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(c, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN comp ON e.vec_id = comp.vec_id
"""

OP11_ROUNDS = 6


def _op11() -> str:
    def dist(b: str) -> str:
        return f"list_sum(list_transform(list_zip(p.x, {b}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

    said = ["""
k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // 8 + 1:(part + 1) * len(v) // 8] AS x FROM k, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (
  SELECT part, e, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) o USING (vec_id) WHERE e < 16)"""]
    for i in range(OP11_ROUNDS + 1):
        said.append(f"""
a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min({dist('b')} * 16 + b.e) AS best
  FROM p JOIN b{i} b USING (part) GROUP BY p.vec_id, p.part)""")
        if i < OP11_ROUNDS:
            said.append(f"""
s{i} AS (
  SELECT part, e, list(m ORDER BY d) AS x FROM (
    SELECT part, best % 16 AS e, d, CAST(floor(sum(x[d]) / count(*)) AS BIGINT) AS m
    FROM a{i}, (SELECT unnest(range(1, 9)) AS d) GROUP BY ALL) GROUP BY part, e),
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.e, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s ON b.part = s.part AND b.e = s.e)""")
    last = OP11_ROUNDS
    return "WITH " + ",".join(said) + f""",
c AS (
  SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY part) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM a{last} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{last})
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""


OP11 = _op11()

OP12 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS dd,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM d),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id) USING (doc_id)
  GROUP BY 1, 2),
l AS (SELECT unnest(range(5)) AS i),
o AS (
  SELECT [p.i, q.i, r.i, s.i, u.i] AS o FROM l p, l q, l r, l s, l u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
st AS (
  SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i + 1]), '') AS filter_order, step, o[step] AS own,
         coalesce(list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (
  SELECT part, filter_order, step, own, (mask & (1 << own)) > 0 AS fails, (mask & before) > 0 AS gone, mask = (1 << own) AS sole, n, good, bad
  FROM m, st),
y AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (sole), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM y
"""

OP13 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (
  SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 699) AS h
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 500)) AS base FROM d WHERE length(h) >= 400)),
win AS (
  SELECT doc_id, base + p AS p, md5(substr(h, 2 * p + 1, 400)) AS s
  FROM (SELECT doc_id, base, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM piece)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM win JOIN rep ON win.s = rep.s),
isle AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit),
run AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM isle GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM run),
kept AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cut JOIN d ON cut.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

SQL = {"op7_embedding": OP7, "op10_substring": OP10, "op9_minhash": OP9, "op1_line_dedup": OP1, "op3_secret_scan": OP3, "op4_decontam": OP4,
       "op11_vector_codes": OP11, "op12_filter_audit": OP12, "op13_suffix_dedup": OP13}
