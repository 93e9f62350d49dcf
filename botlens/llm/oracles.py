"""DuckDB SQL for the operators that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"


def quality_sql(rows: str = "documents", columns: str = "doc_id") -> str:
    """The quality rules over ``rows`` (lang, source, text and the given columns)."""
    features = {"symbols": ("1000 * n_symbols // greatest(word_chars, 1)", 30, False),
                "repeats": ("1000 * n_repeat_words // greatest(n_words, 1)", 350, False),
                "dup_lines": ("1000 * n_dup_lines // greatest(n_lines, 1)", 350, False),
                "word_length": ("100 * word_chars // greatest(n_words, 1)", 150, True)}
    long = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS feature, ({e})::BIGINT AS v FROM base WHERE NOT base_failed"
        for k, (e, _, _) in features.items())
    least = "CASE feature " + " ".join(f"WHEN '{k}' THEN {m}" for k, (_, m, _) in features.items()) + " END"

    def fences(name, group):
        keys = "".join(f"{g}, " for g in group)
        return f"""
{name}_r AS (SELECT {keys}feature, bucket,
    sum(n) OVER (PARTITION BY {keys}feature ORDER BY bucket) AS upto,
    sum(n) OVER (PARTITION BY {keys}feature) AS docs
  FROM (SELECT {keys}feature, bucket, sum(n) AS n FROM sketch GROUP BY {keys}feature, bucket)),
{name} AS (SELECT {keys}feature, docs, q3 + greatest(4 * (q3 - q1), {least}) AS hi,
    q1 - greatest(4 * (q3 - q1), {least}) AS lo
  FROM (SELECT {keys}feature, max(docs) AS docs, min(bucket) FILTER (4 * upto >= docs) AS q1,
          min(bucket) FILTER (4 * upto >= 3 * docs) AS q3 FROM {name}_r GROUP BY {keys}feature)
  {'' if not group else 'WHERE docs >= 200'})"""

    tests = " AND ".join(
        f"coalesce(p_{k}.hi, l_{k}.hi, e_{k}.hi) >= {e}"
        + (f" AND coalesce(p_{k}.lo, l_{k}.lo, e_{k}.lo) <= {e}" if low else "")
        for k, (e, _, low) in features.items())
    joins = "\n".join(f"""
LEFT JOIN pair p_{k} ON p_{k}.feature = '{k}' AND p_{k}.lang IS NOT DISTINCT FROM base.lang
  AND p_{k}.source IS NOT DISTINCT FROM base.source
LEFT JOIN language l_{k} ON l_{k}.feature = '{k}' AND l_{k}.lang IS NOT DISTINCT FROM base.lang
LEFT JOIN every e_{k} ON e_{k}.feature = '{k}'""" for k in features)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rn, *, coalesce(text, '') AS body FROM {rows}),
w AS (SELECT rn, regexp_extract_all(body, '{WORD}') AS ws FROM t),
win AS (SELECT rn, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g, i
  FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rn, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1) GROUP BY rn),
li AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rn, unnest(string_split(body, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY rn),
base AS (SELECT t.*, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
  FROM t JOIN w USING (rn) LEFT JOIN rep USING (rn) LEFT JOIN li USING (rn)),
long AS ({long}),
sketch AS (SELECT lang, source, feature, (v >> s) << s AS bucket, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0)::BIGINT AS s FROM long) GROUP BY ALL),
{fences('pair', ['lang', 'source'])},
{fences('language', ['lang'])},
{fences('every', [])}
SELECT {columns}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {tests}, false) AS kept
FROM base {joins}
"""


URL_FILTERS = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
marked AS (SELECT DISTINCT host FROM p WHERE regexp_matches(host,
  '(^|\.)([^.]*-)?(adult|ads|bets|casino|pills|spam)(-[^.]*)?\..'))
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN m.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit f ON f.page_id = p.page_id AND f.place = 1 LEFT JOIN marked m ON m.host = p.host
"""


DECONTAMINATION = r"""
WITH lowered AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM items WHERE len(ws) > 0)),
dw AS (SELECT rn, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rn, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM lowered, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS (SELECT rn, dw.n, i, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
covered AS (SELECT rn, count(DISTINCT w) AS n_hit
  FROM (SELECT rn, unnest(range(i, i + n)) AS w FROM (SELECT DISTINCT rn, n, i FROM hits)) GROUP BY rn),
found AS (SELECT rn, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT rn, item_id FROM hits) GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (rn) LEFT JOIN found USING (rn)
"""


SUBSTRING_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
w AS (SELECT rn, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g
  FROM (SELECT rn, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
late AS (SELECT rn, i FROM (SELECT rn, i, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT rn, p FROM (SELECT rn, unnest(range(i, i + 20)) AS p FROM late)),
kept AS (SELECT rn, string_agg(x, ' ' ORDER BY p) AS body
  FROM (SELECT rn, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (rn, p) GROUP BY rn),
n AS (SELECT rn, count(*) AS n_removed FROM gone GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rn) LEFT JOIN kept USING (rn)
"""


LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rn, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d)),
shared AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rn) >= 10),
kept AS (SELECT rn, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM l ANTI JOIN shared USING (key) GROUP BY rn)
SELECT doc_id, len(ls)::BIGINT AS n_lines, len(ls)::BIGINT - coalesce(n, 0) AS n_dropped, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""


LEXICAL_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(ws) AS term FROM d) GROUP BY rn, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item, item_id, term, count(*) AS repeats FROM (SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item, item_id, term),
s AS (SELECT item, item_id, d.rn, d.doc_id, sum(repeats * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (rn), size GROUP BY item, item_id, d.rn, d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""


HARD_NEGATIVES = r"""
WITH e AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.rn AS an, a.vec_id AS anchor_id, a.label = b.label AS same, b.rn, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.rn <> b.rn WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (SELECT p.an, p.anchor_id, p.place, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
    s.score AS negative_score, row_number() OVER (PARTITION BY p.an, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.an = p.an AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
