"""SQL counterparts of the queries, for an independent engine on the same tables.

They state the expected columns directly from the tables: nothing here builds or parses JSON or
source code, which is what the queries are checked for.
"""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"


def norm(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


def numbered(lines: str, start: str) -> str:
    """Numbered lines of a list expression; ``j`` counts from 1."""
    width = f"length(CAST({start} + len({lines}) - 1 AS VARCHAR))"
    return (
        f"array_to_string(list_transform({lines}, lambda x, j: "
        f"lpad(CAST({start} + j - 1 AS VARCHAR), CAST({width} AS INTEGER), ' ') || ' | ' || x), {NL})"
    )


def fingerprint(text: str, function: str, rule: str = "'rule.' || lang", path: str = "path") -> str:
    key = f"concat_ws('|', '0.1.0', {rule}, {path}, {norm(text)}, {norm(f'coalesce({function}, chr(0))')})"
    key = key.replace("chr(0)", "''")
    return f"substr(sha256({key}), 1, 16)"


EXT = "CASE WHEN lang IN ('en', 'de') THEN '.py' ELSE '.html' END"
DOCS = f"""d AS (SELECT *, string_split(text, {NL}) AS ls, len(string_split(text, {NL})) AS n FROM documents)"""
LINES = f"""{DOCS},
l AS (SELECT doc_id, lang, source, text, n_chars, ls, n, unnest(ls) AS line, CAST(unnest(range(n)) AS INTEGER) AS i,
    lang || '/' || source || '/d' || doc_id || {EXT} AS file_path, 'scan' || doc_id AS scan_id FROM d)"""
VALID = f"""{LINES},
v AS (SELECT *, i AS result_idx, lang IN ('en', 'de') AS processable FROM l WHERE i >= 1 AND contains(line, ' '))"""

STATEMENTS: dict[str, str] = {}

# -- scans -----------------------------------------------------------------------------------------

STATEMENTS["finding_parse"] = f"""
WITH {VALID}
SELECT scan_id, result_idx, 'rule.' || lang AS rule_id, file_path, i AS start_line, i + 1 AS end_line,
    CAST(length(line) AS INTEGER) AS start_col, CAST(0 AS INTEGER) AS end_col, line AS message,
    CASE WHEN length(line) < 40 THEN 'INFO' WHEN length(line) < 120 THEN 'WARNING'
        WHEN length(line) < 240 THEN 'ERROR' WHEN length(line) < 400 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    CASE WHEN length(line) < 40 THEN 'INFO' WHEN length(line) < 120 THEN 'WARNING'
        WHEN length(line) < 240 THEN 'ERROR' WHEN length(line) < 400 THEN 'CRITICAL' ELSE 'EXPERIMENT' END AS severity_raw,
    CASE WHEN contains(line, ',') THEN 'CWE-20' WHEN line LIKE '%.' THEN 'CWE-79;CWE-89' ELSE '' END AS cwe,
    CASE WHEN line LIKE '%.' THEN 'A03:2021' ELSE '' END AS owasp,
    CASE WHEN line LIKE '%.' THEN line ELSE 'requires login' END AS embedded_lines,
    contains(line, ',') AS has_dataflow_trace,
    CASE WHEN contains(line, ',') THEN
        CASE WHEN split_part(line, ' ', 1) <> '' THEN 'Source: ' || split_part(line, ' ', 1) || ' | ' ELSE '' END
        || 'Sink: ["sink","x"] | Intermediate steps: ' || len(string_split(line, ',')) END AS dataflow_trace_summary,
    CASE WHEN length(line) > 200 THEN 'HIGH' WHEN length(line) < 50 THEN 'LOW' END AS scanner_confidence
FROM v"""

STATEMENTS["scan_chunks"] = f"""
WITH {LINES},
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS INTEGER) AS result_idx FROM l)
SELECT source, result_idx, 'rule.' || lang AS rule_id, file_path, i AS start_line, line AS message,
    CASE WHEN length(line) < 40 THEN 'INFO' WHEN length(line) < 120 THEN 'WARNING'
        WHEN length(line) < 240 THEN 'ERROR' WHEN length(line) < 400 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    CASE WHEN contains(line, ',') THEN 'CWE-20' WHEN line LIKE '%.' THEN 'CWE-79;CWE-89' ELSE '' END AS cwe,
    CASE WHEN line LIKE '%.' THEN line ELSE 'requires login' END AS embedded_lines,
    CASE WHEN contains(line, ',') THEN
        CASE WHEN split_part(line, ' ', 1) <> '' THEN 'Source: ' || split_part(line, ' ', 1) || ' | ' ELSE '' END
        || 'Sink: ["sink","x"] | Intermediate steps: ' || len(string_split(line, ',')) END AS dataflow_trace_summary
FROM a WHERE i >= 1 AND contains(line, ' ')"""

STATEMENTS["finding_rejects"] = f"""
WITH {LINES}
SELECT scan_id, i AS result_idx,
    CASE WHEN NOT contains(line, ' ') THEN 'check_id missing or not a string' ELSE 'start_line below 1' END AS reason
FROM l WHERE i = 0 OR NOT contains(line, ' ')"""

STATEMENTS["scan_errors"] = f"""
WITH e AS (SELECT 'scan' || doc_id AS scan_id, CAST(0 AS INTEGER) AS error_idx,
    CASE WHEN lang <> 'fr' THEN source ELSE '<unknown>' END AS path,
    CASE WHEN lang <> 'de' THEN split_part(text, {NL}, 1) ELSE 'Unknown error' END AS message FROM documents)
SELECT *, path || ': ' || message AS summary FROM e"""

STATEMENTS["scan_file_rejects"] = """
SELECT 'junkscan' || doc_id AS scan_id, 'notes' AS repo_id, 'not valid JSON' AS reason FROM documents
UNION ALL SELECT 'twicescan' || doc_id, 'notes',
    CASE WHEN doc_id % 2 = 0 THEN 'not valid JSON' ELSE 'more than one JSON document' END FROM documents
UNION ALL SELECT 'event' || event_id AS scan_id, 'events' AS repo_id, 'no top-level results' AS reason FROM events
UNION ALL SELECT 'text' || doc_id, 'texts', 'not valid JSON' FROM documents"""

STATEMENTS["matched_code"] = f"""
WITH {VALID}
SELECT scan_id, result_idx, CASE WHEN line LIKE '%.' THEN line
    WHEN lang = 'es' THEN '<could not read file: ' || file_path || '>'
    ELSE array_to_string(list_slice(ls, i, i + 1), {NL}) END AS matched_code
FROM v"""

STATEMENTS["language_route"] = f"""
WITH {VALID}
SELECT scan_id, result_idx, processable,
    CASE WHEN NOT processable THEN 'needs_human_review' END AS verdict,
    CASE WHEN NOT processable THEN 'Only Python files are reviewed; ' || file_path || ' requires manual review.' END AS reasoning,
    CASE WHEN NOT processable THEN 'Review manually.' END AS suggested_action
FROM v"""

STATEMENTS["limit_per_scan"] = f"""
WITH {VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY result_idx) AS k FROM v WHERE processable)
SELECT scan_id, result_idx, processable FROM r WHERE k <= 3
UNION ALL SELECT scan_id, result_idx, processable FROM v WHERE NOT processable"""

STATEMENTS["numbered_lines"] = f"""
WITH {DOCS} SELECT doc_id, {numbered('ls', 'n_chars')} AS numbered, text AS stripped FROM d"""

# -- code context ----------------------------------------------------------------------------------

# f0: line of the first function; b: one row per text line with its outer function's start.
CODE = f"""{DOCS},
p AS (SELECT *, list_sort(list_distinct(list_transform(ls, lambda x: length(x)))) AS lens,
    source || '/d' || doc_id || '.py' AS path, CASE WHEN lang = 'en' THEN '    ' ELSE '' END AS pad FROM d),
c AS (SELECT *, CAST(len(lens) + 11 AS INTEGER) AS f0 FROM p),
b AS (SELECT doc_id, lang, source, path, pad, n, f0, ls, lens, line, i, CAST(f0 + 6 * i AS INTEGER) AS fs, line LIKE '%.' AS dotted
    FROM (SELECT *, unnest(ls) AS line, CAST(unnest(range(n)) AS INTEGER) AS i FROM c)),
items AS (SELECT item_id, 'bench/b' || item_id || '.py' AS path, len(string_split(text, {NL})) AS n, text FROM benchmark)"""

STATEMENTS["block_index"] = f"""
WITH {CODE}
SELECT path, 'line_' || i AS name, fs AS start_line, fs + 5 AS end_line, CAST(length(pad) AS INTEGER) AS indent,
    CAST(1 AS INTEGER) AS depth, CASE WHEN lang = 'en' THEN 'method' ELSE 'top' END AS scope FROM b
UNION ALL
SELECT path, 'inner_' || i, fs + 1, fs + 2, CAST(length(pad) + 4 AS INTEGER), 2, 'inner' FROM b
UNION ALL
SELECT path, 'check_' || item_id, 1, CAST(n + 2 AS INTEGER), 0, 1, 'top' FROM items"""

STATEMENTS["enclosing_block"] = f"""
WITH {CODE}
SELECT doc_id || '#0' AS finding_id, CAST(NULL AS VARCHAR) AS function_name,
    CAST(0 AS INTEGER) AS function_start, CAST(0 AS INTEGER) AS function_end FROM c
UNION ALL
SELECT doc_id || '#' || (i + 1), CASE WHEN dotted THEN 'inner_' ELSE 'line_' END || i,
    CASE WHEN dotted THEN fs + 1 ELSE fs END, CASE WHEN dotted THEN fs + 2 ELSE fs + 5 END FROM b"""

IMPORTS = f"""'import os, json as js' || {NL} || 'from bench.common import (' || {NL} || '    first_check,' || {NL}
    || '    other as second,' || {NL} || ')' || {NL}
    || array_to_string(list_transform(lens, lambda k: 'from bench.b' || k || ' import check_' || k), {NL})"""

STATEMENTS["imports_text"] = f"WITH {CODE} SELECT path, {IMPORTS} AS imports FROM c"

STATEMENTS["imports_map"] = f"""
WITH {CODE}, fixed(name, module, target) AS (VALUES ('os', 'os', 'os'), ('js', 'json', 'js'),
    ('first_check', 'bench.common', 'first_check'), ('second', 'bench.common', 'second'))
SELECT path, name, module, target FROM c CROSS JOIN fixed
UNION ALL
SELECT path, 'check_' || k, 'bench.b' || k, 'check_' || k FROM (SELECT path, unnest(lens) AS k FROM c)"""

# Calls of every function, in the order of the syntax tree: the outer ones have seven, the inner ones one.
CALLS = f"""{CODE},
outer_calls AS (SELECT *, unnest(['strip_' || i, 'done_' || i, 'keep_' || i,
    CASE WHEN i > 0 THEN 'line_' || (i - 1) ELSE 'missing_' || n END, 'inner_' || i, 'fold_' || i,
    'check_' || length(line)]) AS name, CAST(unnest(range(7)) AS INTEGER) AS call_no FROM b)"""

STATEMENTS["call_sites"] = f"""
WITH {CALLS}
SELECT path, fs AS start_line, call_no, name FROM outer_calls
UNION ALL SELECT path, fs + 1, 0, 'strip_' || i FROM b"""

RESOLVED = f"""{CALLS},
needed AS (
    SELECT path, fs AS function_start, call_no, name, i, fs, length(line) AS len, doc_id FROM outer_calls WHERE NOT dotted
    UNION ALL SELECT path, fs + 1, 0, 'strip_' || i, i, fs, -1, doc_id FROM b WHERE dotted),
resolved AS (
    SELECT needed.path, function_start, call_no, name, doc_id, i, fs, len,
        CASE WHEN call_no = 3 AND i > 0 THEN needed.path WHEN call_no = 6 THEN items.path END AS def_path,
        CAST(CASE WHEN call_no = 3 AND i > 0 THEN fs - 6 WHEN call_no = 6 AND items.path IS NOT NULL THEN 1 END AS INTEGER) AS def_start,
        CAST(CASE WHEN call_no = 3 AND i > 0 THEN fs - 1 WHEN call_no = 6 THEN items.n + 2 END AS INTEGER) AS def_end,
        CASE WHEN call_no = 3 AND i > 0 THEN 'same_file' WHEN call_no = 6 AND items.path IS NOT NULL THEN 'same_module_import' END
            AS resolution_method,
        items.text AS item_text, items.item_id
    FROM needed LEFT JOIN items ON needed.call_no = 6 AND items.item_id = needed.len)"""

STATEMENTS["import_hop"] = f"""
WITH {RESOLVED}
SELECT path, function_start, call_no, name, def_path, def_start, def_end, resolution_method
FROM resolved WHERE def_path IS NOT NULL"""

STATEMENTS["unresolved_calls"] = f"""
WITH {RESOLVED} SELECT path, function_start, call_no, name FROM resolved WHERE def_path IS NULL"""

STATEMENTS["syntax_problems"] = f"""
WITH {CODE}
SELECT path, ['colon', 'string', 'dedent', 'bracket', 'block', 'indent'][doc_id % 7] AS problem FROM c WHERE doc_id % 7 <> 0"""

SYNTAX = "CASE WHEN doc_id % 7 <> 0 THEN 'File contains syntax errors; extraction is best-effort and may be incomplete.;' ELSE '' END"
MODULE_LEVEL = "Match is at module level (not inside any function or method); function context unavailable."


def function_lines(line: str, i: str, pad: str, n: str) -> str:
    """Source lines of the generated outer function, as a list expression."""
    return f"""['def line_' || {i} || '(self, text):', {pad} || '    def inner_' || {i} || '(t):',
        {pad} || '        return strip_' || {i} || '(t)', {pad} || '    # ' || {line},
        {pad} || '    seen = self.' || CASE WHEN {i} > 0 THEN 'line_' || ({i} - 1) ELSE 'missing_' || {n} END
            || '(inner_' || {i} || '(text)).keep_' || {i} || '(fold_' || {i} || '(text)).done_' || {i} || '()',
        {pad} || '    return check_' || length({line}) || '(seen, "track(%s)" % len(text))']"""


STATEMENTS["code_context"] = f"""
WITH {CALLS},
f AS (SELECT *, {function_lines('line', 'i', 'pad', 'n')} AS body,
    lag({function_lines('line', 'i', 'pad', 'n')}) OVER (PARTITION BY doc_id ORDER BY i) AS body_before FROM b),
g AS (SELECT f.*, items.item_id IS NOT NULL AS has_item,
    list_concat(['def check_' || items.item_id || '(text, *rest):'],
        list_concat(list_transform(string_split(items.text, {NL}), lambda x: '    # ' || x), ['    return text'])) AS item_body
    FROM f LEFT JOIN items ON items.item_id = length(f.line))
SELECT doc_id || '#0' AS finding_id, '5 |     ' AS matched, {IMPORTS} AS imports,
    CAST(NULL AS VARCHAR) AS function_name, CAST(NULL AS VARCHAR) AS function_source, CAST(0 AS INTEGER) AS function_start,
    '' AS callees, '' AS callee_sources, {SYNTAX} || '{MODULE_LEVEL}' AS notes
FROM c
UNION ALL
SELECT doc_id || '#' || (i + 1), (fs + 2) || ' |     ' || line, {IMPORTS},
    CASE WHEN dotted THEN 'inner_' ELSE 'line_' END || i,
    CASE WHEN dotted THEN {numbered("['def inner_' || i || '(t):', pad || '        return strip_' || i || '(t)']", '(fs + 1)')}
        ELSE {numbered('body', 'fs')} END,
    CASE WHEN dotted THEN fs + 1 ELSE fs END,
    CASE WHEN dotted THEN '' ELSE concat_ws(';', CASE WHEN i > 0 THEN 'line_' || (i - 1) || '@' || path END,
        CASE WHEN has_item THEN 'check_' || length(line) || '@bench/b' || length(line) || '.py' END) END,
    CASE WHEN dotted THEN '' ELSE concat_ws({NL}, CASE WHEN i > 0 THEN {numbered('body_before', '(fs - 6)')} END,
        CASE WHEN has_item THEN {numbered('item_body', '1')} END) END,
    {SYNTAX} || CASE WHEN dotted THEN 'Definition of `strip_' || i || '()` not resolved.'
        ELSE concat_ws(';', 'Definition of `strip_' || i || '()` not resolved.',
            'Definition of `done_' || i || '()` not resolved.', 'Definition of `keep_' || i || '()` not resolved.',
            CASE WHEN i = 0 THEN 'Definition of `missing_' || n || '()` not resolved.' END,
            'Definition of `inner_' || i || '()` not resolved.', 'Definition of `fold_' || i || '()` not resolved.',
            CASE WHEN NOT has_item THEN 'Definition of `check_' || length(line) || '()` not resolved.' END) END
FROM g"""

# -- exchange --------------------------------------------------------------------------------------

FINDINGS = f"""{DOCS},
f AS (SELECT *, lang || '/' || source || {EXT} AS path, 'rule.' || lang AS rule_id, ls[1] AS message, lang = 'en' AS english,
    CASE WHEN n_chars < 300 THEN 'INFO' WHEN n_chars < 1200 THEN 'WARNING' WHEN n_chars < 4000 THEN 'ERROR'
        ELSE 'CRITICAL' END AS severity,
    CASE WHEN lang = 'en' THEN text END AS function_text FROM d)"""

_FENCE = f"'```python' || {NL}"
_HELPER = "' 9 | def helper_' || source || '():'"
REQUEST = f"""concat_ws({NL}, '# The finding', '', 'Rule ID: ' || rule_id, 'Rule message: ' || message, 'Severity: ' || severity,
    CASE WHEN n_chars > 2000 THEN 'CWE: CWE-79, CWE-89' END, CASE WHEN english THEN 'OWASP: A03:2021' END,
    CASE WHEN n_chars > 500 THEN 'Scanner''s own confidence: HIGH' END, 'File: ' || path, 'Lines: 1-' || n,
    '', '## Matched code', '', {_FENCE} || {numbered('ls', '1')} || {NL} || '```',
    CASE WHEN english THEN concat_ws({NL}, '', '## File imports', '', {_FENCE} || 'import ' || source || {NL} || '```') END,
    CASE WHEN english THEN concat_ws({NL}, '', '## Containing function: `doc_' || doc_id || '`', '',
        {_FENCE} || {numbered('ls', 'n_chars')} || {NL} || '```')
      ELSE concat_ws({NL}, '', '## Containing function', '',
        '_The match is at module level (not inside any function). No containing function context available._') END,
    CASE WHEN english AND n_chars > 1000 THEN concat_ws({NL}, '', '## Called functions (1 resolved)', '',
        '### `helper_' || source || '` (from ' || lang || '/helpers.py, same_module_import)', '',
        {_FENCE} || {_HELPER} || {NL} || '10 |     pass' || {NL} || '```', '') END,
    CASE WHEN n > 4 THEN concat_ws({NL}, '', '## Dataflow trace', '', 'Source: ' || message) END,
    CASE WHEN NOT english THEN concat_ws({NL}, '', '## Extraction notes', '',
        '_The following could not be fully extracted. Treat these as missing context, not as facts about the code:_', '',
        '- File contains no function.') END)"""

STATEMENTS["request_text"] = f"WITH {FINDINGS} SELECT doc_id, {REQUEST} AS request FROM f"

STATEMENTS["request_export"] = f"""
WITH {FINDINGS}, k AS (SELECT {fingerprint('text', 'function_text')} AS fingerprint, CAST(doc_id AS VARCHAR) AS id,
    {REQUEST} AS request FROM f)
SELECT fingerprint, '0.1.0' AS prompt_version, 'Decide.' AS instructions, arg_min(request, id) AS request
FROM k GROUP BY fingerprint"""

LABEL = """CASE WHEN toxic = 1 THEN 'likely_true_positive' WHEN quality = 1 THEN 'false_positive' ELSE 'needs_human_review' END"""

STATEMENTS["reply_validate"] = f"""
WITH {FINDINGS},
r AS (SELECT f.*, quality, toxic, {LABEL} AS label, CASE WHEN lang = 'de' AND quality IS NULL THEN 'api_error: Timeout'
        WHEN quality IS NULL THEN 'no_tool_use'
        WHEN n = 1 OR lang = 'es' OR source = 'src1' THEN 'schema_validation_failed' END AS synth_reason
    FROM f LEFT JOIN labels USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS fingerprint,
    CASE WHEN synth_reason IS NULL THEN label ELSE 'needs_human_review' END AS verdict,
    CASE WHEN synth_reason IS NULL AND n_chars > 2000 THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN synth_reason IS NULL THEN message
        WHEN synth_reason = 'api_error: Timeout' THEN 'LLM call failed after retries: Timeout'
        WHEN synth_reason = 'no_tool_use' THEN 'LLM did not call submit_verdict. Routing to human review.'
        ELSE 'LLM returned malformed verdict. Routing to human review.' END AS reasoning,
    CAST(CASE WHEN synth_reason IS NULL AND toxic = 0 THEN n ELSE 0 END AS INTEGER) AS n_quotes,
    CASE WHEN synth_reason IS NULL THEN '' ELSE 'LLM verdict could not be obtained' END AS missing,
    CASE WHEN synth_reason IS NULL THEN 'other' ELSE '' END AS categories,
    CASE WHEN synth_reason IS NULL THEN 'Act.'
        ELSE 'Review this finding manually; the LLM triage step did not complete.' END AS suggested_action,
    synth_reason, 'LLM call did not produce a usable verdict: ' || synth_reason AS note, n_chars AS input_tokens
FROM r"""

# -- verification ----------------------------------------------------------------------------------

NO_QUOTES = (
    "Verdict is false_positive but no evidence_quotes were provided. Per the prompt contract, FP verdicts "
    "require at least one verbatim code quote."
)


def status(quote: str, hay: str, hay_norm: str) -> str:
    return (
        f"CASE WHEN {norm(quote)} = '' THEN 'empty' WHEN contains({hay}, {quote}) THEN 'exact' "
        f"WHEN contains({hay_norm}, {norm(quote)}) THEN 'normalized' ELSE 'fabricated' END"
    )


LABELLED = f"""{FINDINGS},
said AS (SELECT conv_id, list(text ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
q AS (SELECT f.*, quality, toxic, quality IS NOT NULL AS has_label, {LABEL} AS label,
    CASE WHEN quality IS NOT NULL AND n > 1 THEN list_filter(list_concat([ls[1], replace(ls[2], ' ', ' ' || chr(9) || ' ') || {NL}],
        ls[3:], coalesce(said, CASE WHEN lang = 'fr' THEN ['  '] ELSE [] END)), lambda x: x IS NOT NULL) ELSE [] END AS quotes,
    concat_ws({NL}, text, message, rule_id, path, text, CASE WHEN english THEN concat_ws({NL}, 'import ' || source, text,
        'doc_' || doc_id) END, CASE WHEN english AND n_chars > 1000 THEN concat_ws({NL}, 'def helper_' || source || '():',
        '    pass', 'helper_' || source) END) AS hay
    FROM f LEFT JOIN labels USING (doc_id) LEFT JOIN said ON conv_id = doc_id),
s AS (SELECT *, list_transform(quotes, lambda x: {status('x', 'hay', norm('hay'))}) AS statuses FROM q),
issues AS (SELECT *, CASE WHEN label = 'false_positive' AND len(quotes) = 0 THEN ['{NO_QUOTES}']
    ELSE list_filter(list_transform(statuses, lambda x, j: CASE WHEN x = 'empty' THEN 'Evidence quote #' || j || ' is empty.'
        WHEN x = 'fabricated' THEN 'Evidence quote #' || j
            || ' does not appear verbatim in the code shown to the LLM. Quote: ''' || quotes[j] || '''' END),
        lambda x: x IS NOT NULL) END AS issues FROM s),
o AS (SELECT *, has_label AND len(issues) > 0 AND label <> 'needs_human_review' AS lowered FROM issues)"""

STATEMENTS["evidence_quotes"] = f"""
WITH {LABELLED}
SELECT doc_id, array_to_string(statuses, ';') AS statuses, array_to_string(issues, {NL}) AS issues FROM o"""

STATEMENTS["quote_checks"] = f"""
WITH {LABELLED}
SELECT CAST(doc_id AS VARCHAR) AS finding_id, CAST(unnest(range(len(quotes))) + 1 AS INTEGER) AS quote_no,
    unnest(quotes) AS quote, unnest(statuses) AS status FROM s"""

STATEMENTS["quote_search"] = f"""
WITH t AS (SELECT conv_id, turn, text, count(*) AS copies FROM conversations GROUP BY ALL),
x AS (SELECT doc_id, coalesce(turn, -1) AS turn, coalesce(copies, 0) AS copies, d.text AS hay,
    coalesce(t.text, split_part(d.text, '.', 1)) AS q FROM documents d LEFT JOIN t ON conv_id = doc_id)
SELECT doc_id, turn, copies, {status('q', 'hay', norm('hay'))} AS turn_status,
    {status(norm('hay'), 'hay', norm('hay'))} AS own_status, CAST(length({norm('q')}) AS INTEGER) AS normalized_length
FROM x"""

_WORDS = "'div', 'class_name', 'page_id', 'example', 'this', 'ref_x'"
STATEMENTS["grounding"] = rf"""
WITH p AS (SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE coalesce(regexp_replace(html, '[^\x00-\x7f]', 'e', 'g'), '')
    || ' `made_up_' || length(text) || '` and `ref_x` and `the` ' END AS reasoning, text AS hay
    FROM documents LEFT JOIN pages ON page_id = doc_id),
t AS (SELECT doc_id, hay, list_distinct(list_concat(
    regexp_extract_all(reasoning, '`([A-Za-z_][A-Za-z0-9_]*)`', 1),
    regexp_extract_all(reasoning, '\b([a-z_][a-zA-Z0-9_]*)\s*\(', 1),
    regexp_extract_all(reasoning, '\b([a-z_][a-zA-Z0-9_]*\.[a-z_][a-zA-Z0-9_]+)', 1),
    regexp_extract_all(reasoning, '\b([A-Z][a-zA-Z0-9]*[a-z][A-Z][A-Za-z0-9]*|[a-z]+_[a-z_0-9]+)\b', 1))) AS tokens FROM p)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(list_sort(list_filter(tokens, lambda x:
    lower(x) NOT IN ({_WORDS}) AND NOT contains(hay, x)
    AND NOT (contains(x, '.') AND contains(hay, split_part(x, '.', -1))))), ' ') AS suspects
FROM t"""

STATEMENTS["downgrade"] = f"""
WITH {LABELLED}
SELECT doc_id, CASE WHEN lowered OR NOT has_label THEN 'needs_human_review' ELSE label END AS verdict,
    CASE WHEN lowered OR NOT has_label THEN 'low' WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 500 THEN 'medium'
        ELSE 'low' END AS confidence,
    CASE WHEN has_label AND NOT lowered AND label = 'false_positive' THEN 'test_code;other' ELSE '' END AS categories,
    NOT has_label OR len(issues) = 0 AS verification_passed,
    CASE WHEN lowered THEN label END AS original_verdict,
    CAST(CASE WHEN has_label THEN len(issues) ELSE 1 END AS INTEGER) AS n_notes, '' AS advisory
FROM o"""

# -- reuse -----------------------------------------------------------------------------------------

KEYED = f"""{FINDINGS}, k AS (SELECT *, {fingerprint('text', 'function_text')} AS fingerprint FROM f),
stored AS (SELECT k.fingerprint, {LABEL} AS label, 'Read ' || n_chars || ' characters.' AS reasoning, n_chars AS input_tokens,
    1700000000 + doc_id AS seconds, true AS passed FROM k JOIN labels USING (doc_id)),
latest AS (SELECT fingerprint, arg_max(label, seconds) AS verdict, arg_max(reasoning, seconds) AS reasoning,
    arg_max(input_tokens, seconds) AS input_tokens FROM stored GROUP BY fingerprint)"""

STATEMENTS["fingerprint"] = f"WITH {KEYED} SELECT doc_id, fingerprint, fingerprint AS edited FROM k"

STATEMENTS["reuse_hits"] = f"""
WITH {KEYED}
SELECT doc_id, fingerprint, latest.verdict IS NOT NULL AS from_cache, verdict, reasoning,
    coalesce(input_tokens, 0) AS input_tokens
FROM k LEFT JOIN latest USING (fingerprint)"""

STATEMENTS["work_list"] = f"""
WITH {KEYED}
SELECT fingerprint, min(doc_id) AS first_doc, count(*) AS findings FROM k
WHERE fingerprint NOT IN (SELECT fingerprint FROM stored) GROUP BY fingerprint"""

STATEMENTS["store_upsert"] = f"""
WITH {KEYED},
fresh AS (SELECT k.fingerprint, {LABEL} AS label, c.text AS reasoning, length(c.text) AS input_tokens,
    1800000000 + doc_id * 100 + turn AS seconds, false AS passed
    FROM k JOIN conversations c ON conv_id = doc_id LEFT JOIN labels USING (doc_id)),
every AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)
SELECT fingerprint, arg_max(label, seconds) AS verdict, arg_max(reasoning, seconds) AS reasoning,
    arg_max(passed, seconds) AS verification_passed, CAST(arg_max(input_tokens, seconds) AS BIGINT) AS input_tokens,
    max(seconds) AS stored_at
FROM every GROUP BY fingerprint"""

# -- report ----------------------------------------------------------------------------------------

VERDICTS = f"""w AS (SELECT doc_id, lang AS run_id, 'rule.' || source AS rule_id, {LABEL} AS verdict,
    CASE WHEN n_chars < 300 THEN 3 WHEN n_chars < 1200 THEN 2 WHEN n_chars < 4000 THEN 1 ELSE 0 END AS s_rank,
    lang IN ('en', 'de') AS processable FROM documents LEFT JOIN labels USING (doc_id)),
stats AS (SELECT run_id, rule_id, count(*) AS total, count(*) FILTER (verdict = 'false_positive') AS false_positive,
    count(*) FILTER (verdict = 'likely_true_positive') AS likely_true_positive,
    count(*) FILTER (verdict = 'needs_human_review') AS needs_human_review,
    count(*) FILTER (verdict = 'false_positive') / count(*) AS fp_rate FROM w GROUP BY run_id, rule_id)"""

STATEMENTS["rule_stats"] = f"WITH {VERDICTS} SELECT *, CAST(trunc(fp_rate * 100) AS INTEGER) AS fp_percent FROM stats"
STATEMENTS["noisy_rules"] = f"""
WITH {VERDICTS} SELECT run_id, rule_id, false_positive, total, CAST(trunc(fp_rate * 100) AS INTEGER) AS fp_percent
FROM stats WHERE total >= 5 AND fp_rate >= 0.35"""
STATEMENTS["verdict_counts"] = f"""
WITH {VERDICTS} SELECT run_id, count(*) AS total_findings, count(*) FILTER (verdict = 'false_positive') AS false_positive_count,
    count(*) FILTER (verdict = 'likely_true_positive') AS likely_true_positive_count,
    count(*) FILTER (verdict = 'needs_human_review') AS needs_human_review_count FROM w GROUP BY run_id"""

USAGE = """e AS (SELECT event_type AS run_id, CAST(floor(value) AS BIGINT) AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b,
    value >= 20 AS cached, value FROM events),
u AS (SELECT run_id, CAST(sum(a) AS BIGINT) AS total_input_tokens, CAST(sum(b) AS BIGINT) AS total_output_tokens,
    CAST(coalesce(sum(a) FILTER (NOT cached), 0) AS BIGINT) AS spent_input_tokens,
    CAST(coalesce(sum(b) FILTER (NOT cached), 0) AS BIGINT) AS spent_output_tokens,
    count(*) FILTER (cached) AS cache_hits, count(*) FILTER (NOT cached AND a > 0) AS cache_misses,
    count(*) FILTER (NOT cached AND a = 0) AS fallback_count, round(coalesce(sum(value) FILTER (NOT cached), 0), 2) AS review_seconds
    FROM e GROUP BY run_id)"""
STATEMENTS["usage"] = f"WITH {USAGE} SELECT * FROM u"
STATEMENTS["cost"] = f"""
WITH {USAGE} SELECT run_id, round(total_input_tokens * 3.0 / 1000000 + total_output_tokens * 15.0 / 1000000, 6)::DOUBLE AS cost,
    CASE WHEN cache_hits + cache_misses > 0 THEN cache_hits * 100 // (cache_hits + cache_misses) ELSE -1 END AS hit_rate FROM u"""

V_RANK = "CASE verdict WHEN 'likely_true_positive' THEN 0 WHEN 'needs_human_review' THEN 1 ELSE 2 END"
STATEMENTS["actionable_order"] = f"""
WITH {VERDICTS} SELECT run_id, doc_id, row_number() OVER (PARTITION BY run_id
    ORDER BY {V_RANK}, s_rank, rule_id, processable, doc_id) AS finding_no FROM w"""
STATEMENTS["row_numbers"] = """
SELECT l_returnflag AS flag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_shipdate, l_orderkey * 16 + l_linenumber) AS row_no FROM lineitem"""

TRIAGED = f"""{LABELLED},
t AS (SELECT *, source AS run_id, CASE WHEN lowered OR NOT has_label THEN 'needs_human_review' ELSE label END AS verdict,
    CASE WHEN lowered OR NOT has_label OR n_chars <= 500 THEN 'low' WHEN n_chars > 2000 THEN 'high' ELSE 'medium' END AS confidence,
    lang = 'fr' AND has_label AS cached, lang IN ('en', 'de') AS processable FROM o),
no AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {V_RANK},
    CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END, rule_id, processable, doc_id)
    AS finding_no FROM t),
md AS (SELECT run_id, finding_no, concat_ws(chr(10) || chr(10),
    '### ' || finding_no || '. ' || CASE verdict WHEN 'likely_true_positive' THEN '\U0001f6a8 Likely true positive'
        WHEN 'needs_human_review' THEN '⚠️ Needs human review' ELSE '✅ False positive' END || ' — `' || rule_id || '`',
    '**File:** `' || path || ':1`  ',
    '**Severity:** ' || severity || '  **Confidence:** ' || confidence || CASE WHEN n_chars > 2000 THEN ' — CWE-79' ELSE '' END
        || CASE WHEN cached THEN ' _(from cache)_' ELSE '' END,
    CASE WHEN lowered THEN '> ⚠️ LLM originally returned `' || label || '` — downgraded due to verification failure.' END,
    '**Reasoning:** ' || CASE WHEN has_label THEN 'Read ' || n_chars || ' characters.'
        ELSE 'LLM did not call submit_verdict. Routing to human review.' END,
    CASE WHEN len(quotes) > 0 THEN concat_ws(chr(10) || chr(10), '**Evidence from the code:**', array_to_string(
        list_transform(quotes, lambda x: '```' || chr(10) || trim(x, ' ' || chr(9) || chr(10)) || chr(10) || '```'), chr(10) || chr(10))) END,
    CASE WHEN NOT has_label THEN '**Missing context:**' || chr(10) || chr(10) || '- LLM verdict could not be obtained' END,
    CASE WHEN has_label AND NOT lowered AND label = 'false_positive' THEN '**FP categories:** `test_code`, `other`' END,
    CASE WHEN NOT has_label THEN '**Verifier notes:**' || chr(10) || chr(10)
            || '- ⚠️ LLM call did not produce a usable verdict: no_tool_use'
        WHEN len(issues) > 0 THEN concat_ws(chr(10) || chr(10), '**Verifier notes:**',
            array_to_string(list_transform(issues, lambda x: '- ⚠️ ' || x), chr(10) || chr(10))) END,
    '**Suggested action:** ' || CASE WHEN has_label THEN 'Look at ' || source || '.'
        ELSE 'Review this finding manually; the LLM triage step did not complete.' END) AS markdown FROM no),
rules AS (SELECT run_id, rule_id, count(*) AS total, count(*) FILTER (verdict = 'false_positive') AS fp,
    count(*) FILTER (verdict = 'likely_true_positive') AS tp, count(*) FILTER (verdict = 'needs_human_review') AS review,
    count(*) FILTER (verdict = 'false_positive') / count(*) AS rate FROM t GROUP BY run_id, rule_id),
errors AS (SELECT source AS run_id, count(*) AS scan_error_count FROM documents WHERE lang = 'es' GROUP BY source),
runs AS (SELECT t.run_id, TIMESTAMP '2024-01-02 03:04:05' AS generated_at, '0.1.0' AS tool_version, '0.1.0' AS prompt_version,
    'reviewer-1' AS model, '/repos/' || t.run_id AS repo_path, '/scans/' || t.run_id || '.json' AS findings_path,
    count(*) AS total_findings, count(*) FILTER (verdict = 'false_positive') AS false_positive_count,
    count(*) FILTER (verdict = 'likely_true_positive') AS likely_true_positive_count,
    count(*) FILTER (verdict = 'needs_human_review') AS needs_human_review_count,
    CAST(coalesce(sum(n_chars) FILTER (has_label), 0) AS BIGINT) AS total_input_tokens,
    CAST(coalesce(sum(n) FILTER (has_label), 0) AS BIGINT) AS total_output_tokens,
    CAST(coalesce(sum(n_chars) FILTER (has_label AND NOT cached), 0) AS BIGINT) AS spent_input_tokens,
    CAST(coalesce(sum(n) FILTER (has_label AND NOT cached), 0) AS BIGINT) AS spent_output_tokens,
    length(t.run_id)::DOUBLE AS total_duration_seconds, count(*) FILTER (NOT cached) * 0.5::DOUBLE AS review_seconds, count(*) FILTER (cached) AS cache_hits,
    count(*) FILTER (NOT cached AND has_label) AS cache_misses, count(*) FILTER (NOT has_label) AS fallback_count
    FROM t GROUP BY t.run_id),
summary AS (SELECT runs.*, coalesce(scan_error_count, 0) AS scan_error_count,
    CASE WHEN cache_hits + cache_misses > 0 THEN cache_hits * 100 // (cache_hits + cache_misses) END AS hit_rate_percent,
    total_input_tokens * 3.0::DOUBLE / 1000000 + total_output_tokens * 15.0::DOUBLE / 1000000 AS estimated_cost
    FROM runs LEFT JOIN errors USING (run_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rate DESC, total DESC, rule_id) AS rule_no,
    total >= 5 AND rate >= 0.35 AS noisy FROM rules),
tables AS (SELECT run_id, 0 AS part, 0 AS rule_no, concat_ws(chr(10), '## Per-rule statistics' || chr(10),
        '| Rule | Total | FP | Likely TP | Review | FP rate |', '|---|---:|---:|---:|---:|---:|') AS markdown FROM runs
    UNION ALL SELECT run_id, 1, rule_no, '| `' || rule_id || '` | ' || total || ' | ' || fp || ' | ' || tp || ' | ' || review
        || ' | ' || CAST(trunc(rate * 100) AS INTEGER) || '% |' FROM numbered
    UNION ALL SELECT DISTINCT run_id, 2, 0, chr(10) || '**Rules with high false-positive rates that may be worth tuning:**'
        || chr(10) FROM numbered WHERE noisy
    UNION ALL SELECT run_id, 3, rule_no, '- `' || rule_id || '`' FROM numbered WHERE noisy)"""

STATEMENTS["finding_markdown"] = f"WITH {TRIAGED} SELECT * FROM md"

STATEMENTS["run_report"] = f"""
WITH {TRIAGED}
SELECT summary.* EXCLUDE (estimated_cost, hit_rate_percent, generated_at), strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at,
    coalesce(hit_rate_percent, -1) AS hit_rate_percent, round(estimated_cost, 6) AS estimated_cost, rule_no, rule_id, total, fp AS false_positive, noisy
FROM summary JOIN numbered USING (run_id)"""

STATEMENTS["json_report"] = f"""
WITH {TRIAGED},
r AS (SELECT run_id, string_agg(rule_id || ':' || total, ';' ORDER BY rule_no) AS rules,
    coalesce(string_agg(rule_id, ';' ORDER BY rule_no) FILTER (noisy), '') AS tuning FROM numbered GROUP BY run_id),
e AS (SELECT source AS run_id, string_agg(text, {NL} ORDER BY doc_id) AS texts FROM documents WHERE lang = 'es' GROUP BY source)
SELECT run_id, total_findings, rules, tuning, sha256(coalesce(texts, '')) AS errors,
    CAST(row_number() OVER (PARTITION BY run_id ORDER BY doc_id) - 1 AS INTEGER) AS place,
    CAST(doc_id AS VARCHAR) AS finding_id, message, verdict,
    CASE WHEN has_label THEN array_to_string(quotes, {NL}) ELSE '' END AS quotes,
    CASE WHEN NOT has_label THEN 'LLM call did not produce a usable verdict: no_tool_use'
        ELSE array_to_string(issues, {NL}) END AS notes
FROM t JOIN runs USING (run_id) JOIN r USING (run_id) LEFT JOIN e USING (run_id)"""

STATEMENTS["report_markdown"] = f"""
WITH {TRIAGED}, texts AS (
SELECT run_id, CAST(0 AS BIGINT) AS block_no,
    '# Triage report' || chr(10) || chr(10) || '_Generated 2024-01-02 03:04 UTC_' AS markdown FROM summary
UNION ALL SELECT run_id, 1, concat_ws(chr(10), '## Summary' || chr(10), '| Metric | Value |', '|---|---|',
    '| Total findings | ' || total_findings || ' |', '| Likely true positive | ' || likely_true_positive_count || ' |',
    '| Needs human review | ' || needs_human_review_count || ' |', '| False positive | ' || false_positive_count || ' |',
    '| Estimated cost | ' || printf('~$%.3f', estimated_cost) || ' |',
    '| Tokens (in / out) | ' || total_input_tokens || ' / ' || total_output_tokens || ' |',
    '| Duration | ' || printf('%.1fs', total_duration_seconds) || ' |',
    '| Review time of new findings | ' || printf('%.1fs', review_seconds) || ' |',
    '| Cache | ' || cache_hits || ' hits, ' || cache_misses || ' misses'
        || coalesce(' (' || hit_rate_percent || '% hit rate)', '') || ' |',
    '| Model | `reviewer-1` |', '| Prompt version | `0.1.0` |') FROM summary
UNION ALL SELECT run_id, 2, '## Findings' FROM summary
UNION ALL SELECT run_id, finding_no + 2, markdown FROM md
UNION ALL SELECT run_id, total_findings + 4, concat_ws(chr(10) || chr(10), '---',
    '_Triaged with winnow v0.1.0, prompt v0.1.0._', CASE WHEN scan_error_count > 0 THEN
    '_The scanner had ' || scan_error_count || ' parse errors during the scan (not counted as findings)._' END) FROM summary)
SELECT run_id, block_no, CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS rule_no, markdown FROM texts
UNION ALL SELECT run_id, total_findings + 3, part, rule_no, tables.markdown FROM summary JOIN tables USING (run_id)"""

STATEMENTS["triage_run"] = f"""
WITH {CODE}
SELECT 'scan' || doc_id AS scan_id, i AS result_idx, 'review' AS route,
    CASE WHEN i = 0 THEN 'false_positive' ELSE 'needs_human_review' END AS verdict,
    CASE WHEN i > 0 THEN 'false_positive' END AS original_verdict, i = 0 AS verification_passed,
    'Reasoning references `made_up_name` but this token does not appear in the code or context shown to the LLM.' AS advisory,
    CASE WHEN dotted THEN 'inner_' ELSE 'line_' END || i AS function_name FROM b
UNION ALL SELECT 'scan' || doc_id, CAST(n AS INTEGER), 'unsupported_language', 'needs_human_review', NULL, true, '', NULL FROM c"""

LEAVES = "from ...shared.tools import go\n\ndef f(x):\n    return go(x)\n"
STAYS = "def f(x):\n    return go(x)\n"
NO_CONTEXT = "Could not extract enough context (no containing function or called functions) to send to the LLM."
TOO_LARGE = "'File too large to parse (' || size || ' bytes); skipping AST-based extraction.'"

STATEMENTS["triage_faults"] = f"""
WITH {DOCS},
s AS (SELECT doc_id, ls[1] AS message, strlen(text) + 2 * n AS size FROM d),
f AS (
    SELECT doc_id, message, 0 AS result_idx, 'degraded_context' AS route, size,
        CASE WHEN size > 2000 THEN {TOO_LARGE} ELSE '{MODULE_LEVEL}' END AS notes FROM s
    UNION ALL
    SELECT doc_id, message, 1, CASE WHEN size > 2000 THEN 'degraded_context' ELSE 'context_failure' END, size,
        CASE WHEN size > 2000 THEN {TOO_LARGE} ELSE 'Extractor crashed: ValueError' END
        FROM (SELECT doc_id, message, size + {len(LEAVES)} AS size FROM s)
    UNION ALL
    SELECT doc_id, message, 2, CASE WHEN size > 2000 THEN 'degraded_context' ELSE 'review' END, size,
        CASE WHEN size > 2000 THEN {TOO_LARGE} ELSE 'Definition of `go()` not resolved.' END
        FROM (SELECT doc_id, message, size + {len(STAYS)} AS size FROM s)
    UNION ALL
    SELECT doc_id, message, 3, 'degraded_context', size, 'Source file not found: gone/d' || doc_id || '.py' FROM s
    UNION ALL
    SELECT doc_id, message, 4, 'unsupported_language', size, 'Language not yet supported (file: page' || doc_id || '.html).' FROM s)
SELECT 'scan' || doc_id AS scan_id, CAST(result_idx AS INTEGER) AS result_idx, route, false AS from_cache,
    'needs_human_review' AS verdict, CASE route WHEN 'degraded_context' THEN '{NO_CONTEXT}'
        WHEN 'context_failure' THEN 'No context could be built: ValueError'
        WHEN 'review' THEN 'LLM call failed after retries: no reply'
        ELSE 'Only Python files are reviewed; page' || doc_id || '.html requires manual review.' END AS reasoning,
    CASE WHEN route = 'review' THEN 'LLM verdict could not be obtained' ELSE 'Verdict synthesized; LLM was not called.' END AS missing,
    notes, CASE WHEN route = 'review' THEN 'f' END AS function_name, message
FROM f"""

# -- files: the same results by way of a folder ----------------------------------------------------

STATEMENTS["reply_files"] = STATEMENTS["reply_validate"]
STATEMENTS["request_files"] = STATEMENTS["request_export"]
STATEMENTS["store_runs"] = STATEMENTS["store_upsert"]
STATEMENTS["store_lookup"] = f"""
SELECT * FROM ({STATEMENTS["store_upsert"]})
WHERE fingerprint IN (WITH {KEYED} SELECT k.fingerprint FROM k JOIN documents d USING (doc_id) WHERE d.lang = 'fr')"""
STATEMENTS["source_tree"] = """
SELECT 'source=' || source AS repo_id, 'lang=' || lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
    CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines
FROM documents GROUP BY source, lang"""
