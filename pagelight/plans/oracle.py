"""SQL for DuckDB that states each query independently of the Spark plans."""

from __future__ import annotations

# Fixed values, stated here once more: the token patterns, and characters folded to apostrophe and hyphen.
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’\-‐-‒–—−][\p{L}\p{Nl}\p{No}]+)*"
TOKEN = WORD + r"|\p{Nd}+(?:[.,:/\-]\p{Nd}+)*"
ASCII_TOKEN = r"[A-Za-z]+(?:['’\-][A-Za-z]+)*"
APOSTROPHES, HYPHENS = "’‘‛ʼ", "‐‒–—−"
# RE2's spelling of Python's white space.
_WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_HYPHENS = "".join(sorted(HYPHENS))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '[{_WS}]+', ' ', 'g'))"


def _normal(column: str) -> str:
    """Lower case is full case folding for all that the tables hold; compatibility forms are few and listed."""
    folded = f"replace(replace(lower(replace({column}, 'İ', 'i̇')), 'ß', 'ss'), 'ς', 'σ')"
    wide = "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF10 + i) for i in range(10))
    folded = f"translate({folded}, '{wide}', 'abcdefghijklmnopqrstuvwxyz0123456789')"
    for read, meant in (("ﬁ", "fi"), ("ﬂ", "fl"), ("º", "o"), ("ª", "a"), ("²", "2"), ("³", "3"), ("½", "1⁄2"), ("ǆ", "dž"), ("ﷺ", "صلى الله عليه وسلم")):
        folded = f"replace({folded}, '{read}', '{meant}')"
    return f"translate(nfc_normalize({folded}), {_quote(APOSTROPHES + _HYPHENS)}, {_quote(chr(39) * len(APOSTROPHES) + '-' * len(_HYPHENS))})"


def _tokens(rows: str, key: str, text: str, pattern: str) -> str:
    """(key, idx, token, gap, start_char, end_char): a text is split at marks set around each token."""
    return f"""
        SELECT {key}, (pos // 2) - 1 AS idx, part AS token, gap, sum_before AS start_char, sum_before + length(part) AS end_char FROM (
            SELECT {key}, pos, part, lag(part) OVER (PARTITION BY {key} ORDER BY pos) AS gap,
                CAST(coalesce(sum(length(part)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sum_before
            FROM (SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM (
                SELECT {key}, string_split(regexp_replace({text}, {_quote('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM ({rows}) WHERE {text} IS NOT NULL)))
        WHERE pos % 2 = 0"""


def _type(token: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '^\\p{{Nd}}') THEN 'number' ELSE 'word' END"


_DOCUMENTS = "SELECT doc_id, text FROM documents"
_PAGES = "SELECT DISTINCT result_id, original_text FROM ocr_results"
_DOC_TOKENS = f"SELECT doc_id, idx, token, start_char, end_char, {_type('token')} AS token_type, {_normal('token')} AS normalized FROM ({_tokens(_DOCUMENTS, 'doc_id', 'text', TOKEN)})"
_ITEMS = f"SELECT DISTINCT item_id AS ord, {_strip('source_text')} AS source_text, translations FROM dictionary_items WHERE item_id IS NOT NULL"
_TRANSLATIONS = f"""
    SELECT key, list(tr ORDER BY ord, pos) AS translations FROM (
        SELECT key, tr, arg_min(ord, (ord, pos)) AS ord, arg_min(pos, (ord, pos)) AS pos FROM (
            SELECT key, ord, {_strip('raw')} AS tr, pos FROM (SELECT key, ord, unnest(translations) AS raw, generate_subscripts(translations, 1) AS pos FROM live))
        WHERE tr IS NOT NULL AND tr <> '' GROUP BY key, tr) GROUP BY key"""
_GOOD = f"len(list_filter(translations, lambda x: x IS NOT NULL AND {_strip('x')} <> '')) > 0"
_WORDS = f"""
    SELECT key AS normalized, source_text, translations FROM (
        WITH live AS (SELECT {_normal('source_text')} AS key, ord, source_text, translations FROM ({_ITEMS}) WHERE regexp_full_match(source_text, {_quote(WORD)}) AND {_GOOD})
        SELECT h.key, h.source_text, t.translations FROM (SELECT key, arg_min(source_text, ord) AS source_text FROM live GROUP BY key) h JOIN ({_TRANSLATIONS}) t ON h.key = t.key)"""
_PHRASES = f"""
    SELECT key AS normalized_tokens, n, source_text, translations FROM (
        WITH live AS (SELECT list_aggregate(list_transform(found, lambda x: {_normal('x')}), 'string_agg', ' ') AS key, len(found) AS n, ord, source_text, translations FROM (
            SELECT regexp_extract_all(source_text, {_quote(TOKEN)}) AS found, * FROM ({_ITEMS})) WHERE len(found) BETWEEN 2 AND 5 AND {_GOOD})
        SELECT h.key, h.n, h.source_text, t.translations FROM (SELECT key, any_value(n) AS n, arg_min(source_text, ord) AS source_text FROM live GROUP BY key) h JOIN ({_TRANSLATIONS}) t ON h.key = t.key)"""
_GRAMS = " UNION ALL ".join(
    f"SELECT doc_id, idx AS start_idx, {n} AS n, gram FROM (SELECT doc_id, idx, count(*) OVER w AS c, string_agg(normalized, ' ') OVER w AS gram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE c = {n}"
    for n in range(2, 6)
)
_CANDIDATES = f"SELECT doc_id, start_idx, g.n FROM ({_GRAMS}) g JOIN phrases p ON g.gram = p.normalized_tokens AND g.n = p.n"
_WITH = f"WITH RECURSIVE tok AS MATERIALIZED ({_DOC_TOKENS}), phrases AS MATERIALIZED ({_PHRASES}), words AS MATERIALIZED ({_WORDS}), candidates AS MATERIALIZED ({_CANDIDATES}), longest AS MATERIALIZED (SELECT doc_id, start_idx, max(n) AS n FROM candidates GROUP BY ALL)"
_MATCHES = """, matches AS (
    SELECT doc_id, start_idx, start_idx + n AS end_idx FROM (SELECT doc_id, min(start_idx) AS start_idx, arg_min(n, start_idx) AS n FROM longest GROUP BY doc_id)
    UNION ALL
    SELECT doc_id, start_idx, start_idx + n FROM (
        SELECT m.doc_id, min(l.start_idx) AS start_idx, arg_min(l.n, l.start_idx) AS n FROM matches m JOIN longest l ON l.doc_id = m.doc_id AND l.start_idx >= m.end_idx GROUP BY m.doc_id))"""
_DOC_ITEMS = (
    _MATCHES
    + """, items AS (
    SELECT m.doc_id, m.start_idx, 'phrase' AS item_type, string_agg(t.normalized, ' ' ORDER BY t.idx) AS normalized, min(t.start_char) AS start_char, max(t.end_char) AS end_char
        FROM matches m JOIN tok t ON t.doc_id = m.doc_id AND t.idx >= m.start_idx AND t.idx < m.end_idx GROUP BY m.doc_id, m.start_idx),
    covered AS (SELECT m.doc_id, t.idx FROM matches m JOIN tok t ON t.doc_id = m.doc_id AND t.idx >= m.start_idx AND t.idx < m.end_idx),
    shown AS (
        SELECT i.doc_id, i.start_idx, 'phrase' AS item_type, i.normalized, p.translations, CAST(NULL AS VARCHAR) AS token FROM items i JOIN phrases p ON p.normalized_tokens = i.normalized
        UNION ALL
        SELECT t.doc_id, t.idx, CASE WHEN t.token_type = 'number' THEN 'number' WHEN w.normalized IS NULL THEN 'unknown' ELSE 'word' END, t.normalized, CASE WHEN t.token_type = 'number' THEN NULL ELSE w.translations END, t.token
        FROM tok t ANTI JOIN covered c ON c.doc_id = t.doc_id AND c.idx = t.idx LEFT JOIN words w ON w.normalized = t.normalized)"""
)

_OCR = f"SELECT result_id, idx, token, gap, start_char, end_char FROM ({_tokens(_PAGES, 'result_id', 'original_text', ASCII_TOKEN)})"
_OPENS = f"CASE WHEN regexp_replace(gap, '[{_WS}]+$', '') = '' THEN idx = 0 ELSE right(regexp_replace(gap, '[{_WS}]+$', ''), 1) IN ('.', '!', '?') END"
_SKIP = f"""CASE WHEN length(token) < 2 THEN 'token_too_short' WHEN length(token) > 64 THEN 'token_too_long' WHEN regexp_matches(token, '[''’]') THEN 'token_contains_apostrophe'
    WHEN contains(token, '-') THEN 'token_contains_hyphen' WHEN regexp_full_match(token, '[A-Z]+') THEN 'token_is_acronym'
    WHEN NOT regexp_full_match(token, '[a-z]+|[A-Z]+|[A-Z][a-z]*') THEN 'token_has_mixed_case' WHEN regexp_full_match(token, '[A-Z][a-z]*') AND NOT ({_OPENS}) THEN 'token_may_be_proper_name' END"""
_VOCABULARY = f"SELECT term, CAST(sum(frequency) AS BIGINT) AS frequency FROM (SELECT {_strip('lower(term)')} AS term, frequency FROM frequency_terms) WHERE term <> '' AND frequency IS NOT NULL AND NOT regexp_matches(term, '\\s') GROUP BY term HAVING sum(frequency) >= 1"
# The engine measures bytes: a letter beyond ASCII, which no token has, is made one that no token has.
_PLAIN_TERM = "regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g')"


def _within(a: str, b: str, most: str) -> str:
    """Distance at most `most` where a swapped pair is not edited again: the engine's own distance may edit it."""
    swap = f"substr({a}, i + 1, 1) || substr({a}, i, 1)"
    return f"""(damerau_levenshtein({a}, {b}) <= {most} AND (damerau_levenshtein({a}, {b}) <= 1 OR levenshtein({a}, {b}) <= 2 OR len(list_filter(range(1, length({a})), lambda i:
        (starts_with({b}, left({a}, i - 1) || {swap}) AND damerau_levenshtein(substr({a}, i + 2), substr({b}, i + 2)) <= 1)
        OR (suffix({b}, {swap} || substr({a}, i + 2)) AND damerau_levenshtein(left({a}, i - 1), left({b}, length({b}) - length(substr({a}, i + 2)) - 2)) <= 1))) > 0))"""


_CORRECT = f"""WITH ocr AS MATERIALIZED (SELECT *, {_SKIP} AS skipped FROM ({_OCR})), vocabulary AS MATERIALIZED ({_VOCABULARY}),
    asked AS MATERIALIZED (SELECT DISTINCT token FROM ocr WHERE skipped IS NULL),
    absent AS MATERIALIZED (SELECT token, lower(token) AS word FROM asked WHERE lower(token) NOT IN (SELECT term FROM vocabulary)),
    near AS MATERIALIZED (SELECT token, term, CAST(damerau_levenshtein(word, {_PLAIN_TERM}) AS INTEGER) AS distance, frequency FROM absent JOIN vocabulary ON abs(length(word) - length(term)) <= 2 AND {_within('word', _PLAIN_TERM, 'CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END')}),
    top AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, term) AS place FROM near QUALIFY place <= 5),
    least AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY frequency DESC, term) AS rank, lead(frequency) OVER (PARTITION BY token ORDER BY frequency DESC, term) AS next FROM (SELECT *, min(distance) OVER (PARTITION BY token) AS m FROM top) WHERE distance = m),
    chosen AS (SELECT token, term, distance, frequency, length(token) > 4 OR next IS NULL OR frequency >= 2 * next AS clear FROM least WHERE rank = 1),
    fixed AS MATERIALIZED (SELECT a.token,
        CASE WHEN c.clear THEN CASE WHEN regexp_matches(a.token, '^[A-Z]') THEN upper(left(c.term, 1)) || substr(c.term, 2) ELSE c.term END ELSE a.token END AS corrected,
        coalesce(c.clear, false) AS changed, CASE WHEN c.clear THEN c.distance END AS distance, CASE WHEN c.clear THEN c.frequency END AS frequency,
        CASE WHEN lower(a.token) IN (SELECT term FROM vocabulary) THEN 'token_exists_in_dictionary' WHEN c.token IS NULL THEN 'no_candidate_found' WHEN NOT c.clear THEN 'candidate_is_ambiguous' ELSE 'non_word_corrected' END AS reason
        FROM asked a LEFT JOIN chosen c ON c.token = a.token),
    audit AS MATERIALIZED (SELECT o.result_id, o.idx AS token_no, o.token AS original, CASE WHEN o.skipped IS NULL THEN f.corrected ELSE o.token END AS corrected, coalesce(f.changed, false) AND o.skipped IS NULL AS changed,
        CASE WHEN o.skipped IS NULL THEN f.distance END AS distance, coalesce(o.skipped, f.reason) AS reason, o.start_char, o.end_char FROM ocr o LEFT JOIN fixed f ON f.token = o.token)"""

# The raw labels in the detector's order, and one unknown.
_NAMES = """['paragraph_title', 'image', 'text', 'number', 'abstract', 'content', 'figure_title', 'formula', 'table', 'table_title', 'reference', 'doc_title', 'footnote',
    'header', 'algorithm', 'footer', 'seal', 'chart_title', 'chart', 'formula_number', 'header_image', 'footer_image', 'aside_text', 'Mystery Box']"""


def _label(column: str) -> str:
    plain = f"translate(lower({_strip(column)}), ' -', '__')"
    return f"""CASE WHEN {plain} IN ('doc_title', 'paragraph_title') THEN 'title'
        WHEN {plain} IN ('text', 'abstract', 'content', 'reference', 'footnote', 'algorithm', 'aside_text') THEN 'paragraph'
        WHEN {plain} IN ('figure_title', 'table_title', 'chart_title') THEN 'caption' WHEN {plain} IN ('table', 'image', 'chart') THEN {plain}
        WHEN {plain} IN ('formula', 'formula_number') THEN 'formula' WHEN {plain} IN ('header', 'header_image') THEN 'header'
        WHEN {plain} IN ('footer', 'footer_image') THEN 'footer' WHEN {plain} = 'number' THEN 'page_number' ELSE 'other' END"""


_REGIONS = f"""
    SELECT * FROM (SELECT page_id, box_no, CAST(greatest(0, least(floor(least(a1, a2)), 1280)) AS INTEGER) AS x1, CAST(greatest(0, least(floor(least(b1, b2)), 720)) AS INTEGER) AS y1,
        CAST(greatest(0, least(ceil(greatest(a1, a2)), 1280)) AS INTEGER) AS x2, CAST(greatest(0, least(ceil(greatest(b1, b2)), 720)) AS INTEGER) AS y2,
        {_label('raw')} AS label, raw AS raw_label, class_id, score AS confidence
    FROM (SELECT l_orderkey AS page_id, l_linenumber AS box_no, {_NAMES}[l_partkey % 24 + 1] AS raw, CAST(l_suppkey AS INTEGER) AS class_id, l_discount * 10 AS score,
        l_quantity * 30 - 100 AS a1, l_partkey % 900 - 40.5::DOUBLE AS b1, l_quantity * 30 - 100 + (l_suppkey % 40) * 7.25::DOUBLE - 60 AS a2, l_partkey % 900 - 40.5::DOUBLE + l_tax * 1500 AS b2 FROM lineitem)
    WHERE score >= 0.35) WHERE x2 > x1 AND y2 > y1 AND label <> 'other'"""
_LOGGED = "SELECT DISTINCT item_id, source_text FROM dictionary_items WHERE item_id IS NOT NULL"
_FORMS = "CASE WHEN normalized IN ('was', 'were', 'is') THEN 'be' WHEN normalized IN ('has', 'had') THEN 'have' WHEN normalized = 'children' THEN 'child' WHEN normalized = 'books' THEN 'book' WHEN normalized = 'made' THEN 'make' WHEN normalized = 'found' THEN 'find' WHEN normalized = 'saw' THEN 'see' ELSE normalized END"
_REPLACED = f"""
    SELECT key AS normalized, source_text, translations FROM (
        WITH entries AS (SELECT {_normal('source_text')} AS key, ord, source_text, translations FROM ({_ITEMS}) WHERE regexp_full_match(source_text, {_quote(WORD)}) AND {_GOOD}),
        live AS (SELECT * FROM (SELECT *, max(CASE WHEN regexp_matches(source_text, '^[A-Z]') THEN ord END) OVER (PARTITION BY key) AS last FROM entries) WHERE last IS NULL OR ord >= last)
        SELECT h.key, h.source_text, t.translations FROM (SELECT key, arg_min(source_text, ord) AS source_text FROM live GROUP BY key) h JOIN ({_TRANSLATIONS}) t ON h.key = t.key)"""
_STORED = "SELECT DISTINCT region_id, raw_label, class_id, confidence, x1, y1, x2, y2 FROM layout_regions"


def oracle_sql() -> dict[str, str]:
    found = _stated()
    # The pipeline is the translation over the corrected texts in place of the documents.
    fixed = f"SELECT result_id AS doc_id, corrected_text AS text FROM ({found['correct_text']})"
    found["screen_pipeline"] = f"SELECT doc_id AS result_id, literal_translation FROM ({found['dict_translate'].replace(_DOCUMENTS, fixed)})"
    return found


def _stated() -> dict[str, str]:
    return {
        "tok_tokens": f"SELECT doc_id, idx, token AS text, start_char, end_char, token_type FROM ({_DOC_TOKENS})",
        "tok_normalized": f"SELECT normalized, token_type, count(*) AS n FROM ({_DOC_TOKENS}) GROUP BY ALL",
        "tok_drop_rules": f"SELECT CASE WHEN length(token) > 128 THEN 'too_long' WHEN token_type = 'number' THEN 'number' WHEN length(token) = 1 THEN 'single_character_word' ELSE 'kept' END AS rule, count(*) AS n FROM ({_DOC_TOKENS}) GROUP BY ALL",
        "ocr_tokens": f"SELECT result_id, idx, token AS text, start_char, end_char FROM ({_OCR})",
        "dict_words": _WORDS,
        "dict_phrases": f"SELECT normalized_tokens, source_text, translations FROM ({_PHRASES})",
        "phrase_candidates": f"{_WITH} SELECT doc_id, start_idx, n FROM candidates",
        "phrase_longest": f"{_WITH} SELECT doc_id, start_idx, n FROM longest",
        "phrase_shortest": f"{_WITH} SELECT doc_id, start_idx, min(n) AS n FROM candidates GROUP BY ALL",
        "phrase_matches": f"{_WITH}{_DOC_ITEMS} SELECT i.doc_id, i.start_idx, m.end_idx, i.start_char, i.end_char FROM items i JOIN matches m ON m.doc_id = i.doc_id AND m.start_idx = i.start_idx",
        "dict_items": f"{_WITH}{_DOC_ITEMS} SELECT item_type, count(*) AS n, CAST(sum(CASE WHEN len(translations) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS translated FROM shown GROUP BY ALL",
        "dict_unknown_items": f"{_WITH}{_DOC_ITEMS} SELECT normalized, count(*) AS n FROM shown WHERE item_type = 'unknown' GROUP BY ALL",
        "dict_translate": f"{_WITH}{_DOC_ITEMS} SELECT s.doc_id, string_agg(coalesce(translations[1], token), ' ' ORDER BY start_idx) AS literal_translation FROM shown s GROUP BY s.doc_id",
        "correct_skip_reason": f"SELECT coalesce({_SKIP}, 'looked_up') AS reason, count(*) AS n FROM ({_OCR}) GROUP BY ALL",
        "vocab_frequency": _VOCABULARY,
        "vocab_contains": f"SELECT token, coalesce(frequency, 0) AS frequency, frequency IS NOT NULL AS present FROM (SELECT DISTINCT token FROM ({_OCR})) LEFT JOIN ({_VOCABULARY}) ON lower(token) = term",
        "suggest_topk": f"""SELECT token, term, CAST(damerau_levenshtein(lower(token), {_PLAIN_TERM}) AS INTEGER) AS distance, frequency, row_number() OVER (PARTITION BY token ORDER BY damerau_levenshtein(lower(token), {_PLAIN_TERM}), frequency DESC, term) AS place
            FROM (SELECT DISTINCT token FROM ({_OCR}) WHERE length(token) BETWEEN 2 AND 64 AND lower(token) NOT IN (SELECT term FROM ({_VOCABULARY}))) JOIN ({_VOCABULARY}) ON abs(length(token) - length(term)) <= 2 AND {_within('lower(token)', _PLAIN_TERM, '2')} QUALIFY place <= 5""",
        "correct_select": f"{_CORRECT} SELECT * FROM fixed",
        "correct_tokens": f"{_CORRECT} SELECT result_id, token_no, original, corrected, changed, distance, reason FROM audit",
        "correct_text": f"""{_CORRECT}, parts AS (SELECT a.result_id, a.start_char, substr(p.original_text, CAST(coalesce(lag(a.end_char) OVER (PARTITION BY a.result_id ORDER BY a.token_no), 0) + 1 AS BIGINT), CAST(a.start_char - coalesce(lag(a.end_char) OVER (PARTITION BY a.result_id ORDER BY a.token_no), 0) AS BIGINT)) || a.corrected AS part
                FROM audit a JOIN ({_PAGES}) p ON p.result_id = a.result_id),
            joined AS (SELECT result_id, string_agg(part, '' ORDER BY start_char) AS body FROM parts GROUP BY result_id),
            ends AS (SELECT result_id, max(end_char) AS last FROM audit GROUP BY result_id)
            SELECT p.result_id, CASE WHEN j.result_id IS NULL THEN p.original_text ELSE j.body || substr(p.original_text, CAST(e.last + 1 AS BIGINT)) END AS corrected_text FROM ({_PAGES}) p LEFT JOIN joined j ON j.result_id = p.result_id LEFT JOIN ends e ON e.result_id = p.result_id""",
        "layout_regions": _REGIONS,
        "layout_label_counts": f"SELECT label, count(*) AS n, CAST(sum(CAST(x2 - x1 AS BIGINT) * (y2 - y1)) AS BIGINT) AS area, max(x2 - x1) AS widest, max(y2 - y1) AS highest FROM ({_REGIONS}) GROUP BY label",
        "layout_reading_order": f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, confidence DESC, x2, y2, raw_label, class_id, box_no) - 1 AS pos, x1, y1, x2, y2, label, confidence FROM ({_REGIONS})",
        "layout_stored": f"SELECT label, count(*) AS n, CAST(sum(CAST(greatest(0, x2 - x1) AS BIGINT) * greatest(0, y2 - y1)) AS BIGINT) AS area FROM (SELECT {_label('raw_label')} AS label, * FROM ({_STORED})) GROUP BY label",
        "layout_decode": f"SELECT label, count(*) AS n FROM (SELECT {_label('raw_label')} AS label, * FROM ({_STORED})) WHERE label <> 'other' AND coalesce(CASE WHEN isfinite(confidence) THEN confidence END, 0) >= 0.35 AND x1 <> x2 AND y1 <> y2 GROUP BY label",
        "nmt_prepare": f"""SELECT translation_id, CASE WHEN error IS NULL THEN processed END AS processed_text, CASE WHEN error IS NULL AND processed <> '' THEN '>>vie<< ' || processed END AS model_input, error
            FROM (SELECT DISTINCT translation_id, {_collapse('source_text')} AS processed, CASE WHEN source_text IS NULL THEN 'null_text' WHEN length(source_text) > 5000 THEN 'too_long' END AS error FROM translation_results)""",
        "nmt_clean": f"SELECT DISTINCT translation_id, {_collapse('translated_text')} AS translated_text FROM translation_results",
        "input_validation": "SELECT doc_id, CASE WHEN text IS NULL THEN 'null_text' WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS error FROM documents",
        "image_validation": "SELECT CASE WHEN image_width IS NULL OR image_height IS NULL THEN 'no_image' WHEN image_height < 16 THEN 'too_low' WHEN image_width < 1000 THEN 'too_narrow' WHEN image_width::BIGINT * image_height > 2100000 THEN 'too_many_pixels' ELSE 'ok' END AS error, count(*) AS n FROM (SELECT DISTINCT page_id, image_width, image_height FROM layout_pages) GROUP BY ALL",
        "ocr_flatten": f"SELECT result_id, CAST(pos - 1 AS INTEGER) AS line_no, text, list_extract([0.5, 0.25, 0.75], pos)::DOUBLE AS score FROM (SELECT result_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS pos FROM (SELECT result_id, string_split(original_text, chr(10)) AS lines FROM ({_PAGES}) WHERE original_text IS NOT NULL))",
        "dict_item_rows": f"""{_WITH}{_DOC_ITEMS}, spans AS (
                SELECT doc_id, start_idx, (SELECT m.end_idx FROM matches m WHERE m.doc_id = i.doc_id AND m.start_idx = i.start_idx) AS end_idx, start_char, end_char FROM items i
                UNION ALL SELECT doc_id, idx, idx + 1, start_char, end_char FROM tok ANTI JOIN covered USING (doc_id, idx))
            SELECT s.doc_id, CASE WHEN s.item_type = 'phrase' THEN substr(d.text, CAST(p.start_char + 1 AS BIGINT), CAST(p.end_char - p.start_char AS BIGINT)) ELSE s.token END AS source_text, s.normalized AS normalized_tokens,
                coalesce(list_aggregate(s.translations, 'string_agg', '|'), '') AS translations, s.item_type, s.start_idx AS start_token_index, p.end_idx AS end_token_index, p.start_char, p.end_char
            FROM shown s JOIN spans p ON p.doc_id = s.doc_id AND p.start_idx = s.start_idx JOIN documents d ON d.doc_id = s.doc_id""",
        "dict_words_replaced": _REPLACED,
        "word_lookup": f"""SELECT item_id, CASE WHEN one THEN {_normal('source_text')} END AS normalized, CASE WHEN one AND NOT number THEN coalesce(list_aggregate(w.translations, 'string_agg', '|'), '') ELSE '' END AS translations,
                CASE WHEN NOT one THEN NULL WHEN number THEN 'number' WHEN w.normalized IS NULL THEN 'unknown' ELSE 'word' END AS item_type, CASE WHEN NOT one THEN 'not_one_token' END AS error
            FROM (SELECT item_id, source_text, coalesce(regexp_full_match(source_text, {_quote(TOKEN)}), false) AS one, coalesce(regexp_matches(source_text, '^\\p{{Nd}}'), false) AS number FROM ({_LOGGED})) i
            LEFT JOIN (SELECT normalized, translations FROM ({_WORDS})) w ON i.one AND w.normalized = {_normal('i.source_text')}""",
        "phrase_lookup": f"""SELECT phrase, coalesce(list_aggregate(p.translations, 'string_agg', '|'), '') AS translations, p.normalized_tokens IS NOT NULL AS present
            FROM (SELECT DISTINCT source_text AS phrase, list_aggregate(list_transform(regexp_extract_all(source_text, {_quote(TOKEN)}), lambda x: {_normal('x')}), 'string_agg', ' ') AS key FROM ({_LOGGED}) WHERE source_text IS NOT NULL) a
            LEFT JOIN ({_PHRASES}) p ON p.normalized_tokens = a.key""",
        "tok_lemmas": f"SELECT CASE WHEN token_type = 'word' THEN {_FORMS} ELSE normalized END AS normalized, count(*) AS n FROM ({_DOC_TOKENS}) GROUP BY ALL",
        "tok_nfc": f"""SELECT translate(nfc_normalize(token), {_quote(APOSTROPHES + _HYPHENS)}, {_quote(chr(39) * len(APOSTROPHES) + '-' * len(_HYPHENS))}) AS normalized, count(*) AS n
            FROM ({_DOC_TOKENS}) WHERE token_type = 'word' AND length(token) > 1 AND length(token) <= 128 GROUP BY ALL""",
        "skip_rules": """SELECT token, opens, reason FROM (VALUES ('I', true, 'token_too_short'), (repeat('x', 65), true, 'token_too_long'), (repeat('x', 64), true, NULL), ('don''t', false, 'token_contains_apostrophe'),
            ('don’t', false, 'token_contains_apostrophe'), ('well-known', true, 'token_contains_hyphen'), ('http://a.b', true, 'token_is_url'), ('HTTPS://A.B', false, 'token_is_url'), ('www.a.b', false, 'token_is_url'),
            ('me@a.b', true, 'token_is_email'), ('me@a', true, NULL), ('USA', true, 'token_is_acronym'), ('eBay', true, 'token_has_mixed_case'), ('McX', false, 'token_has_mixed_case'), ('Title', true, NULL),
            ('Title', false, 'token_may_be_proper_name'), ('plain', false, NULL), ('AB', false, 'token_is_acronym')) t(token, opens, reason)""",
        "token_rules": "SELECT place, error FROM (VALUES (0, 'empty_token'), (1, NULL), (2, 'white_space'), (3, 'white_space'), (4, 'too_long'), (5, NULL), (6, 'white_space'), (7, 'null_token')) t(place, error)",
        "layout_image_rules": "SELECT CASE WHEN image_width IS NULL OR image_height IS NULL THEN 'no_image' WHEN image_width < 1300 THEN 'too_narrow' WHEN image_height < 1000 THEN 'too_low' WHEN image_width::BIGINT * image_height > 2500000 THEN 'too_many_pixels' ELSE 'ok' END AS error, count(*) AS n FROM (SELECT DISTINCT page_id, image_width, image_height FROM layout_pages) GROUP BY ALL",
    }
