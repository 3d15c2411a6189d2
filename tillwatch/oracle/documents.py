"""SQL cross-checks of the document queries."""

from __future__ import annotations

TYPES = ("Business Rule", "KPI Definition", "Policy", "SOP", "Vendor Contract", "Escalation Rule",
         "Historical Report", "Meeting Note", "User Guide", "Other")
SCOPES = ("Internal", "Management", "Restricted")
NAMES = (".txt", ".md", ".csv", ".json", ".pdf", ".TXT")


def pick(values, index):
    return f"([{', '.join(repr(v) for v in values)}])[CAST({index} % {len(values)} AS INTEGER) + 1]"


PATTERNS = {
    "ignore_previous_instructions": r"\bignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above)\s+instructions?\b",
    "follow_instructions_instead": r"\bfollow\s+(?:these|my|the following)\s+instructions?\s+instead\b",
    "system_or_developer_prompt_reference": r"\b(?:system|developer)\s+(?:prompt|message|instructions?)\b",
    "reveal_hidden_prompt": r"\breveal\s+(?:the\s+)?(?:hidden\s+(?:(?:system|developer)\s+)?|(?:system|developer)\s+)prompt\b",
    "role_tag_injection": r"<\s*(?:system|developer|assistant)\s*>",
}


def flags(text):
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{n}' END" for n, p in PATTERNS.items()) + ")"


def matches(text):
    return "(" + " + ".join(f"CAST(regexp_matches({text}, '(?i){p}') AS INTEGER)" for p in PATTERNS.values()) + ")"


SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NORMAL = f"regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^{SPACE}+', ''), '{SPACE}+$', '')"
FILES = (f"SELECT doc_id AS document_id, 'doc-' || doc_id || {pick(NAMES, 'doc_id')} AS filename, text, source || ' / ' || lang AS title, "
         f"{pick(TYPES, 'doc_id')} AS document_type, {pick(SCOPES, 'doc_id')} AS access_scope, DATE '2026-01-01' + CAST(doc_id % 180 AS INTEGER) AS source_date, "
         f"lower(regexp_extract(filename, '(\\.[^./]+)$', 1)) AS file_extension, octet_length(encode(text)) AS file_size_bytes, sha256(text) AS checksum_sha256, "
         f"{NORMAL} AS content_text, {flags('content_text')} AS injection, "
         f"trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS logical_document_key FROM documents")
VERSIONS = ("SELECT *, row_number() OVER (PARTITION BY logical_document_key ORDER BY document_id) AS version_number, "
            "CASE WHEN injection <> '' THEN 'Quarantined' WHEN document_id < max(document_id) FILTER (injection = '') OVER (PARTITION BY logical_document_key) "
            "THEN 'Superseded' ELSE 'Active' END AS status FROM (SELECT * FROM files WHERE content_text <> ''  "
            "QUALIFY row_number() OVER (PARTITION BY checksum_sha256 ORDER BY document_id) = 1)")
CTE = f"WITH files AS MATERIALIZED ({FILES}), versions AS MATERIALIZED ({VERSIONS})"
WORDS = "unnest(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"
SEARCH = f"""{CTE},
units AS MATERIALIZED (SELECT document_id AS unit_id, content_text AS text FROM versions WHERE status = 'Active' AND access_scope IN ('Internal', 'Management')
  AND source_date BETWEEN DATE '2026-01-01' AND DATE '2026-06-30'),
postings AS MATERIALIZED (SELECT unit_id, word, count(*) AS uses FROM (SELECT unit_id, {WORDS.format('text')} AS word FROM units) GROUP BY ALL),
queries AS MATERIALIZED (SELECT item_id || '-' || place AS query_id, query FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?]')) AS query,
  generate_subscripts(regexp_split_to_array(text, '[.!?]'), 1) - 1 AS place FROM benchmark) WHERE trim(query) <> ''),
words AS MATERIALIZED (SELECT DISTINCT query_id, {WORDS.format('query')} AS word FROM queries),
df AS (SELECT word, count(*) AS units FROM postings GROUP BY word),
hits AS (SELECT query_id, unit_id, count(*) AS found,
  sum(CAST((1 + ln(CAST(uses AS DOUBLE))) * ln(1 + CAST((SELECT count(*) FROM units) AS DOUBLE) / units) AS DECIMAL(18,6))) AS relevance
  FROM words JOIN postings USING (word) JOIN df USING (word) GROUP BY ALL),
ranked AS (SELECT query_id, unit_id, CAST(relevance AS DOUBLE) AS relevance_score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, unit_id) AS INTEGER) AS position
  FROM hits JOIN (SELECT query_id, count(*) AS needed FROM words GROUP BY query_id) USING (query_id) WHERE found = needed
  QUALIFY position <= 20)"""

LAST = "position(' ' IN reverse(replace(substr(t, {b} + 1081, 720), chr(10), ' ')))"
BREAK = f"(CASE WHEN {LAST} > 0 THEN {{b}} + 1800 - {LAST} ELSE {{b}} + 1800 END)"
# a chunk starts at s; its raw end is the last blank or newline in the last 40% of 1,800 characters, or the window's end
WALK = f"""{CTE.replace("WITH ", "WITH RECURSIVE ", 1)},
texts AS MATERIALIZED (SELECT document_id, version_number, status, title, document_type, access_scope, source_date, content_text AS t, length(content_text) AS n FROM versions),
walk AS (SELECT document_id, n, t, 0 AS s, CASE WHEN n <= 1800 THEN n ELSE {BREAK.format(b="0")} END AS e FROM texts),
steps AS (SELECT document_id, n, t, s, e FROM walk
  UNION ALL SELECT document_id, n, t, b AS s, CASE WHEN n - b <= 1800 THEN n ELSE {BREAK.format(b="b")} END AS e
  FROM (SELECT document_id, n, t, e, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS b FROM steps WHERE e < n)),
pieces AS (SELECT document_id, s, e, t, substr(t, s + 1, e - s) AS raw FROM steps),
trimmed AS (SELECT document_id, t, s + length(raw) - length(regexp_replace(raw, '^{SPACE}+', '')) AS a, s + length(regexp_replace(raw, '{SPACE}+$', '')) AS b FROM pieces
  WHERE regexp_replace(raw, '^{SPACE}+', '') <> ''),
chunked AS MATERIALIZED (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, substr(t, a + 1, b - a) AS chunk_text,
  CAST(a AS INTEGER) AS character_start, CAST(b AS INTEGER) AS character_end, substr(t, 1, a) AS before FROM trimmed),
cited AS MATERIALIZED (SELECT c.*, v.version_number, v.status, 'DOC-' || document_id || '-V' || v.version_number || ':CHUNK-' || (chunk_index + 1) AS citation_id,
  regexp_extract_all(before, '(?m)^#{{1,6}}[ \\t]+([^\\n]+?)[ \\t]*$', 1) AS heads FROM chunked c JOIN texts v USING (document_id))"""

RANKED = SEARCH[SEARCH.index("postings AS"):]
CHUNK_SEARCH = f"""{WALK}, units AS MATERIALIZED (SELECT citation_id AS unit_id, chunk_text AS text FROM cited JOIN texts USING (document_id)
  WHERE texts.status = 'Active' AND access_scope IN ('Internal', 'Management') AND document_type IN ('Business Rule', 'Policy', 'User Guide') AND title LIKE '% / en'),
{RANKED.replace("<= 20", "<= 5")} SELECT * FROM ranked"""

# ---- stemmed search: the stem rules as one CTE per step, and covers with plain joins ------------------
STOPS = ("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
         "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
         "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
         "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
         "can will just don should now").split()
ODD = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
       "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STEP_2 = {"ate": "ational ation ator", "ful": "fulness fulli", "ive": "iveness iviti", "ize": "ization izer", "ous": "ousness ousli", "ble": "biliti bli", "less": "lessli",
          "tion": "tional", "al": "alism aliti alli", "ent": "entli", "able": "abli", "ance": "anci", "ence": "enci", "og": "ogi", "": "li"}
STEP_3 = {"ate": "ational", "tion": "tional", "al": "alize", "ic": "icate iciti ical", "": "ness ful ative"}


def suffix(x: str, endings: str) -> str:
    """The longest of the endings: a match that ends at the end and starts leftmost."""
    return f"regexp_extract({x}, '({'|'.join(endings.split())})$')"


def swap(x: str, found: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {found} IN ({', '.join(repr(e) for e in ends.split())}) THEN '{to}'" for to, ends in table.items())
    return f"left({x}, length({x}) - length({found})) || CASE {cases} END"


def endings(table: dict[str, str]) -> str:
    return " ".join(table.values())


SHORT = "'^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$'"
CUT = "left(a, length(a) - length(f))"
STEMS = f"""
y0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM vocabulary),
y1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN w LIKE 'commun%' THEN 6 WHEN regexp_matches(w, '[aeiouy][^aeiouy]')
  THEN length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(w) END AS r1 FROM y0),
y2 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '[aeiouy][^aeiouy]') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]'))
  ELSE length(w) END AS r2 FROM y1),
a0 AS (SELECT *, CASE WHEN w LIKE '%sses' THEN left(w, -2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END
  WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -1) ELSE w END AS a FROM y2),
a1 AS (SELECT *, a IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS done, {suffix('a', 'eedly ingly edly eed ing ed')} AS f FROM a0),
b0 AS (SELECT *, CASE WHEN done OR f = '' THEN a WHEN f IN ('eed', 'eedly') THEN CASE WHEN length({CUT}) >= r1 THEN {CUT} || 'ee' ELSE a END
  WHEN NOT regexp_matches({CUT}, '[aeiouy]') THEN a WHEN regexp_matches({CUT}, '(at|bl|iz)$') THEN {CUT} || 'e'
  WHEN regexp_matches({CUT}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({CUT}, -1) WHEN regexp_matches({CUT}, {SHORT}) AND length({CUT}) <= r1 THEN {CUT} || 'e' ELSE {CUT} END AS b FROM a1),
c0 AS (SELECT * EXCLUDE (f), CASE WHEN NOT done AND regexp_matches(b, '.[^aeiouy][yY]$') THEN left(b, -1) || 'i' ELSE b END AS c FROM b0),
c1 AS (SELECT *, {suffix('c', endings(STEP_2))} AS f FROM c0),
d0 AS (SELECT * EXCLUDE (f), CASE WHEN f = '' OR length(c) - length(f) < r1 OR (f = 'ogi' AND c NOT LIKE '%logi') OR (f = 'li' AND NOT regexp_matches(c, '[cdeghkmnrt]li$'))
  THEN c ELSE {swap('c', 'f', STEP_2)} END AS d FROM c1),
d1 AS (SELECT *, {suffix('d', endings(STEP_3))} AS f FROM d0),
e0 AS (SELECT * EXCLUDE (f), CASE WHEN f = '' OR length(d) - length(f) < CASE WHEN f = 'ative' THEN r2 ELSE r1 END THEN d ELSE {swap('d', 'f', STEP_3)} END AS e FROM d1),
e1 AS (SELECT *, {suffix('e', 'al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion')} AS f FROM e0),
g0 AS (SELECT *, CASE WHEN f = '' OR length(e) - length(f) < r2 OR (f = 'ion' AND NOT regexp_matches(e, '[st]ion$')) THEN e ELSE left(e, length(e) - length(f)) END AS g FROM e1),
h0 AS (SELECT *, CASE WHEN g LIKE '%e' AND (length(g) > r2 OR (length(g) > r1 AND NOT regexp_matches(left(g, -1), {SHORT}))) THEN left(g, -1)
  WHEN g LIKE '%ll' AND length(g) > r2 THEN left(g, -1) ELSE g END AS h FROM g0),
stems AS MATERIALIZED (SELECT word, CASE WHEN length(word) <= 2 THEN word {" ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in ODD.items())} WHEN done THEN a ELSE replace(h, 'Y', 'y') END AS stem FROM h0)"""
# kind, alternative, term, must not, offset, word of the item (from 1)
FORMS = [(0, 0, 0, 0, 0, 1), (0, 0, 1, 0, 0, 2), (0, 0, 2, 0, 0, 3), (1, 0, 0, 0, 0, 1), (1, 0, 0, 0, 1, 2), (1, 0, 0, 0, 2, 3), (2, 0, 0, 0, 0, 1), (2, 0, 1, 0, 0, 2),
         (2, 1, 0, 0, 0, 3), (2, 1, 0, 0, 1, 4), (3, 0, 0, 0, 0, 1), (3, 0, 1, 1, 0, 2), (4, 0, 0, 0, 0, 2), (4, 0, 0, 0, 1, 3), (4, 0, 1, 1, 0, 5), (4, 0, 1, 1, 1, 6),
         (4, 1, 0, 0, 0, 4), (4, 1, 1, 0, 0, 7)]
STEMMED = f"""{CTE},
units AS MATERIALIZED (SELECT document_id AS unit_id, content_text AS text FROM versions WHERE status = 'Active' AND access_scope IN ('Internal', 'Management')
  AND source_date BETWEEN DATE '2026-01-01' AND DATE '2026-06-30'),
lists AS (SELECT unit_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM units),
tokens AS MATERIALIZED (SELECT unit_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark),
forms AS (SELECT * FROM (VALUES {', '.join(str(f) for f in FORMS)}) v(kind, alt, term, negative, off, n)),
asked AS MATERIALIZED (SELECT item_id || '-' || kind AS query_id, alt, term, negative, off, ws[n] AS word FROM items, forms
  WHERE len(ws) >= 7 AND ws[n] NOT IN ({', '.join(repr(w) for w in STOPS)})),
vocabulary AS (SELECT word FROM tokens UNION SELECT word FROM asked),{STEMS},
places AS MATERIALIZED (SELECT DISTINCT unit_id, stem, pos FROM tokens JOIN stems USING (word) WHERE word NOT IN ({', '.join(repr(w) for w in STOPS)})),
terms AS MATERIALIZED (SELECT query_id, alt, term, negative, off - min(off) OVER (PARTITION BY query_id, alt, term) AS off, stem FROM asked JOIN stems USING (word)),
needs AS (SELECT query_id, alt, term, negative, count(*) AS words, max(off) AS reach FROM terms GROUP BY ALL),
occurs AS MATERIALIZED (SELECT query_id, alt, term, negative, unit_id, pos - off AS s, any_value(needs.reach) AS reach
  FROM terms JOIN places USING (stem) JOIN needs USING (query_id, alt, term, negative) GROUP BY query_id, alt, term, negative, unit_id, pos - off HAVING count(*) = any_value(needs.words)),
must AS (SELECT query_id, alt, count(*) AS terms FROM needs WHERE negative = 0 GROUP BY ALL),
met AS MATERIALIZED (SELECT query_id, alt, unit_id FROM (SELECT query_id, alt, unit_id, count(DISTINCT term) AS n FROM occurs WHERE negative = 0 GROUP BY ALL) JOIN must USING (query_id, alt)
  WHERE n = terms AND (query_id, alt, unit_id) NOT IN (SELECT (query_id, alt, unit_id) FROM occurs WHERE negative = 1)),
good AS MATERIALIZED (SELECT o.query_id, o.alt, o.term, o.unit_id, s, s + reach AS e FROM occurs o JOIN met USING (query_id, alt, unit_id) WHERE negative = 0),
ends AS (SELECT DISTINCT query_id, unit_id, e AS q FROM good),
latest AS (SELECT query_id, unit_id, q, alt, term, max(s) AS s FROM ends JOIN good USING (query_id, unit_id) WHERE e <= q GROUP BY ALL),
begins AS (SELECT query_id, unit_id, q, alt, min(s) AS p FROM latest JOIN must USING (query_id, alt) GROUP BY query_id, unit_id, q, alt, terms HAVING count(*) = terms),
widest AS (SELECT query_id, unit_id, q, max(p) AS p FROM begins GROUP BY ALL),
covers AS MATERIALIZED (SELECT * FROM widest QUALIFY p > coalesce(max(p) OVER (PARTITION BY query_id, unit_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
entries AS MATERIALIZED (SELECT DISTINCT query_id, unit_id, pos FROM (SELECT DISTINCT query_id, stem FROM terms) JOIN places USING (stem) SEMI JOIN covers USING (query_id, unit_id)),
weights AS (SELECT query_id, unit_id, q, p, 2 + q - p - count(*) AS parts FROM covers JOIN entries USING (query_id, unit_id) WHERE pos BETWEEN p AND q GROUP BY query_id, unit_id, q, p),
scores AS (SELECT query_id, unit_id, sum((200000000 + parts) // (2 * parts)) AS score FROM weights GROUP BY ALL)
SELECT query_id, unit_id, CAST(score AS DOUBLE) / 1000000000 AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS position
FROM scores QUALIFY position <= 20"""

ORACLE: dict[str, str] = {
    "stemmed_search": STEMMED,
    "chunk_search": CHUNK_SEARCH,
    "document_validation": f"WITH files AS ({FILES}) SELECT document_id, file_extension, file_size_bytes, checksum_sha256, CAST(length(content_text) AS INTEGER) AS text_length, CASE WHEN file_extension NOT IN ('.txt', '.md', '.csv', '.json') THEN 'unsupported extension' WHEN file_size_bytes = 0 THEN 'empty file' WHEN contains(text, chr(0)) THEN 'binary content' WHEN content_text = '' THEN 'no readable text' WHEN file_extension = '.json' AND NOT json_valid(content_text) THEN 'invalid JSON' ELSE 'valid' END AS outcome, injection AS injection_matches FROM files",
    "injection_scan": f"SELECT 'turn' AS kind, conv_id AS document_id, turn, {matches('text')} AS matches, {flags('text')} AS injection_matches FROM conversations UNION ALL SELECT 'document', doc_id, NULL, {matches('text')}, {flags('text')} FROM documents",
    "logical_keys": f"WITH files AS ({FILES}) SELECT document_id, logical_document_key FROM files",
    "vocabulary_check": "SELECT 'document_type' AS field, source AS value, count(*) AS documents FROM documents GROUP BY ALL UNION ALL SELECT 'access_scope', lang, count(*) FROM documents GROUP BY ALL",
    "duplicate_documents": "SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS original_id, sha256(text) AS checksum_sha256 FROM documents QUALIFY document_id <> original_id",
    "document_versions": f"{CTE} SELECT document_id, logical_document_key, version_number, status FROM versions",
    "document_chunks": f"{WALK} SELECT document_id, chunk_index, heads[-1] AS section_title, chunk_text, character_start, character_end, character_end - character_start AS character_count, greatest(1, len(regexp_extract_all(chunk_text, '[^' || substr('{SPACE}', 2, length('{SPACE}') - 2) || ']+')), CAST(ceil((character_end - character_start) / 4) AS INTEGER)) AS token_estimate, version_number, status, citation_id FROM cited",
    "document_list": f"{WALK}, counts AS (SELECT document_id, count(*) AS chunk_count FROM chunked GROUP BY ALL) SELECT document_id, title, document_type, access_scope, version_number, status, source_date AS updated_at, coalesce(chunk_count, 0) AS chunk_count FROM versions LEFT JOIN counts USING (document_id) WHERE status = 'Active' AND access_scope IN ('Internal', 'Management') ORDER BY source_date DESC, document_id DESC LIMIT 500",
    "document_search": f"{SEARCH} SELECT * FROM ranked",
    "retrieval_log": f"{SEARCH} SELECT query_id, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS search_query, 'Word Index Search' AS retrieval_method, 'Internal, Management' AS access_scopes, '{{}}' AS filters, coalesce(n, 0) AS result_count, coalesce(c, '[]') AS returned_citations FROM queries LEFT JOIN (SELECT query_id, count(*) AS n, '[' || string_agg(unit_id, ',' ORDER BY position) || ']' AS c FROM ranked GROUP BY query_id) USING (query_id)",
}
