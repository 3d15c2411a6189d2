"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables.

Not here: op2 (no XXH64 in SQL), op3 (levels of a tree that depend on each other), op4 (expectation-maximisation), op5 and op6
(trained models), op8 (a tokenizer), op11 (no CRC-32 in DuckDB), op12 (decoding until nothing is left). These are tested against brute force, held-out labels or an exact round trip."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM starts),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
removed AS (SELECT DISTINCT doc_id, i + j AS p FROM windows SEMI JOIN twice USING (k), range(0, 35) r(j)),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(ws[p], ' ' ORDER BY p) AS s, count(*) AS n FROM places ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM h),
windows AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS k FROM starts),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, -1) AS fresh FROM windows SEMI JOIN twice USING (k)),
numbered AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM runs
  UNION ALL SELECT h.doc_id, coalesce(max(b), 0), any_value(len(x)) // 2 FROM h LEFT JOIN runs USING (doc_id) GROUP BY h.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS s FROM gaps JOIN h USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM runs GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(s)) AS kept_sha256
FROM h JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {ALNUM} AS ws FROM documents), b AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM b WHERE len(ws) > 0),
item_starts AS (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM sized),
phrases AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM item_starts),
starts AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM phrases)),
windows AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k FROM starts),
found AS (SELECT doc_id, i, m, item_id FROM windows JOIN phrases USING (m, k)),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM found),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _level(name: str, keys: str) -> str:
    """Quartiles of the sketches merged to the keys."""
    part = f"PARTITION BY {keys}, metric" if keys else "PARTITION BY metric"
    by = f"{keys}, metric" if keys else "metric"
    return f"""
{name}_bins AS (SELECT {by}, bucket, sum(n) AS n FROM sketch GROUP BY {by}, bucket),
{name}_run AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS seen, sum(n) OVER ({part}) AS total FROM {name}_bins),
{name} AS (SELECT {by}, any_value(total) AS total, min(bucket) FILTER (WHERE seen * 4 >= total) AS b1, min(bucket) FILTER (WHERE seen * 4 >= 3 * total) AS b3 FROM {name}_run GROUP BY {by})"""


def _top(b: str) -> str:
    return f"(CASE WHEN {b} < 64 THEN {b} ELSE ({b} % 64 + 33) * (1::BIGINT << ({b} // 64 - 6)::BIGINT) - 1 END)"


OP10 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM starts),
twice AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + j AS p FROM windows SEMI JOIN twice USING (doc_id, k), range(0, 5) r(j)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN repeats USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate FROM m),
v AS (SELECT lang, source, 'word_length' AS metric, word_length AS value FROM r WHERE n_words > 0
  UNION ALL SELECT lang, source, 'symbol_rate', symbol_rate FROM r WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_line_rate', dup_line_rate FROM r WHERE n_words > 0),
sketch AS (SELECT lang, source, metric, CASE WHEN value < 64 THEN value ELSE length(bin(value)) * 64 + (value >> (length(bin(value)) - 6)) - 32 END AS bucket, count(*) AS n
  FROM v GROUP BY ALL),
{_level("own", "lang, source")},{_level("of_lang", "lang")},{_level("of_all", "")},
used AS (SELECT o.lang, o.source, o.metric,
  CASE WHEN o.total >= 50 THEN o.b1 WHEN l.total >= 50 THEN l.b1 ELSE a.b1 END AS b1,
  CASE WHEN o.total >= 50 THEN o.b3 WHEN l.total >= 50 THEN l.b3 ELSE a.b3 END AS b3,
  CASE o.metric WHEN 'word_length' THEN 500 WHEN 'symbol_rate' THEN 20 ELSE 150 END AS least_width
  FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN of_all a ON o.metric = a.metric),
q AS (SELECT lang, source, metric, least_width, {_top("b1")} AS q1, {_top("b3")} AS q3 FROM used),
f AS (SELECT lang, source, metric, q1 - 3 * greatest(q3 - q1, least_width) AS low, q3 + 3 * greatest(q3 - q1, least_width) AS high FROM q),
bad AS (SELECT DISTINCT r.doc_id FROM r JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
  WHERE NOT (CASE f.metric WHEN 'word_length' THEN word_length WHEN 'symbol_rate' THEN symbol_rate ELSE dup_line_rate END) BETWEEN low AND high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM r
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) r(m)),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n.n, 1000 * c.a * n.n // (x.f * y.f) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:c.m], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, m AS whole, f, string_split(phrase, ' ') AS ws, unnest(range(2, m)) AS s FROM f WHERE m > 2),
parts AS (SELECT lang, f, s, ws, unnest(range(1, whole - s + 2)) AS i FROM inner_),
around AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS f FROM parts GROUP BY ALL),
free AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE around.f IS NULL OR 100 * around.f < 100 * best.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1, "op7_suffix_array_dedup": OP7, "op9_benchmark_decontamination": OP9, "op10_quality_rules": OP10,
    "op13_phrase_collocations": OP13,
}
