"""SQL of the queries that SQL can express as a whole.

Words and windows are written out as strings and pairs are found by joining on
them, which is far too slow for large tables and right for small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from vicinal.llm.quality import COMMON, N_COMMON

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _windows() -> str:
    """Windows of five words of a list w, as strings; all words of a shorter list."""
    short = "CASE WHEN len(w) > 0 AND len(w) < 5 THEN [array_to_string(w, ' ')] WHEN len(w) < 5 THEN [] "
    return short + "ELSE list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END"


NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
sets AS (SELECT doc_id, {_windows()} AS s FROM docs),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, k = n AND k = m AS same FROM met WHERE k * 5 >= 4 * (n + m - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT sets.doc_id, class_id, coalesce(n_links, 0) AS n_links, least(sets.doc_id, coalesce(copy, sets.doc_id)) AS copy_id
FROM sets JOIN (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS copy FROM links GROUP BY a) USING (doc_id)
"""

LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, CAST(len(string_split(text, chr(10))) AS BIGINT))) AS i FROM documents),
worded AS (SELECT doc_id, i, {_words('line')} AS w FROM lines),
sets AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS r, doc_id, i, {_windows()} AS s FROM worded),
each AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.r, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND b.r < a.r GROUP BY a.r, b.r),
gone AS (SELECT DISTINCT doc_id, i FROM met JOIN sets USING (r) WHERE k * 5 >= 4 * (n + m - k)),
left_over AS (SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS rest
    FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(rest) AS BIGINT) AS n_chars, sha256(rest) AS text_sha256 FROM left_over
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
items AS (SELECT row_number() OVER () AS own, CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
sized AS (SELECT own, item, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT own, item, n, i AS j, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM sized)),
places AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) AS BIGINT) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, i, j, n, own, item FROM places JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id),
matches AS (SELECT doc_id, own, item, min(i) - 1 AS doc_word, min(j) - 1 AS item_word, count(*) - 1 + any_value(n) AS words FROM
    (SELECT *, i - row_number() OVER (PARTITION BY doc_id, own, i - j ORDER BY i) AS island FROM found) GROUP BY doc_id, own, item, i - j, island),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, doc_word, coalesce(item, ''), item_word) AS r FROM matches) WHERE r = 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
    CAST(coalesce(words, 0) AS BIGINT) AS longest, item AS longest_item, item_word AS longest_item_word, doc_word AS longest_doc_word
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""

_BY_LANGUAGE = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items()) + " END"


def _left(others: str) -> str:
    return f"CAST(length(regexp_replace(t, '{others}', '', 'g')) AS BIGINT)"


def _js(a: str, b: str) -> str:
    """Jensen-Shannon distance (base 2) of two lists of counts."""
    p, q = (f"list_transform({x}, lambda x: x / nullif(CAST(list_sum({x}) AS DOUBLE), 0.0))" for x in (a, b))
    term = "CASE WHEN z[{0}] <= 0 THEN 0.0 ELSE z[{0}] * log2(2 * z[{0}] / (z[1] + z[2])) END"
    return f"sqrt(abs(0.5 * list_sum(list_transform(list_zip({p}, {q}), lambda z: {term.format(1)} + {term.format(2)}))))"


QUALITY = rf"""
WITH texts AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(repr(k) for k in COMMON)}) THEN lang ELSE '' END AS key, {_BY_LANGUAGE} AS common, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
triples AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM texts)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM triples),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, key, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {_left('[^#*$%&|<>]+')} AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, CAST(length(t) AS BIGINT) AS chars, {_left('[^a-z]+')} AS lower, {_left('[^A-Z]+')} AS upper, {_left('[^0-9]+')} AS digit, {_left('[^.,;:!?' + "''" + '"()-]+')} AS mark,
    list_transform(common, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS named FROM texts LEFT JOIN covered USING (doc_id)),
hist AS (SELECT *, [lower, upper, digit, chars - word_chars, mark, n_symbols, word_chars - lower - upper - digit - mark - n_symbols] AS by_class,
    CASE WHEN key <> '' THEN list_append(named, greatest(0, n_words - list_sum(named))) ELSE [] END AS by_word FROM counts),
refs AS (SELECT key, [{', '.join(f'sum(by_class[{k}])' for k in range(1, 8))}] AS all_class, [{', '.join(f'sum(by_word[{k}])' for k in range(1, N_COMMON + 2))}] AS all_word FROM hist GROUP BY key),
others AS (SELECT * EXCLUDE (all_class, all_word), list_transform(list_zip(all_class, by_class), lambda z: z[1] - z[2]) AS all_class, list_transform(list_zip(all_word, by_word), lambda z: z[1] - z[2]) AS all_word FROM hist JOIN refs USING (key)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words >= 50 THEN {_js('by_class', 'all_class')} END AS js_class,
    CASE WHEN n_words >= 200 AND key <> '' THEN {_js('by_word', 'all_word')} END AS js_word FROM others)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(js_class, 0) <= 0.3 AND coalesce(js_word, 0) <= 0.25 AS kept,
    round(js_class, 6) AS js_class, round(js_word, 6) AS js_word FROM judged
"""


def _named(table: str) -> str:
    """host, path and canonical URL of the column url of a table, with its column page_id."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    cut = f"(SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, {rest} AS rest FROM {table}))"
    host = r"regexp_replace(regexp_replace(host, ':[0-9]*\z', ''), '^(www|m)\.', '')"
    path = r"regexp_replace(regexp_replace(path, '(/index)?\.html?\z', ''), '/+\z', '')"
    return f"SELECT *, CASE WHEN host <> '' THEN concat({host}, {path}) END AS canonical FROM {cut}"


def urls(rules: Sequence[tuple[str, str, str]], hosts: Sequence[str]) -> str:
    """The query of the URL filter: the longest rule that fits, else whether the list has the canonical URL."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in by_length)
    blocked = ", ".join(f"'{h + p}'" for v, h, p in rules if v == "block")
    return f"""
WITH named AS ({_named('pages')}),
bad AS (SELECT * FROM named WHERE page_id % 3 <> 0 AND ({' OR '.join(f"contains(host, '{h}')" for h in hosts)})),
written AS (SELECT page_id, unnest(['https://WWW.' || canonical || '/?from=list', 'http://' || host || '/unseen/' || page_id]) AS url FROM bad),
listed AS (SELECT DISTINCT canonical FROM ({_named('written')}) WHERE canonical IS NOT NULL),
ruled AS (SELECT *, CASE {fits} END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed USING (canonical)
"""
