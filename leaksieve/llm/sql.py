"""What the operators compute, as DuckDB SQL over the same tables."""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAM_GROUPS = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS grams FROM w),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS node, doc_id AS other FROM documents
    UNION SELECT r.node, s.b FROM reach r JOIN steps s ON r.other = s.a)
SELECT s.doc_id, len(s.grams) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""

QUALITY_RULES = r"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS three,
        unnest(range(1, len(ws) - 1)) AS place_1 FROM w WHERE len(ws) > 2),
often AS (SELECT doc_id, three FROM t GROUP BY doc_id, three HAVING count(*) > 1),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (
        SELECT doc_id, unnest([place_1, place_1 + 1, place_1 + 2]) AS place FROM t JOIN often USING (doc_id, three)) GROUP BY doc_id),
lines AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
base AS (
    SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM w JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
    SELECT source, count(*) AS n, sum(CAST(base_failed AS INTEGER)) AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
prior AS (SELECT m, v, CASE WHEN v > 0 THEN CASE WHEN m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 1 END END AS s FROM moments),
verdicts AS (
    SELECT source, CASE WHEN s IS NULL THEN m ELSE (f + m * s) / (n + s) END > 0.5 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM failed LEFT JOIN verdicts USING (source)
"""

FILTER_AUDIT = r"""
WITH w AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
    SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM w JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
    SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
walked AS (
    SELECT part, fs, n, good, toxic, fails, len(list_filter(fails, lambda x: x)) AS k,
        coalesce(list_position(list_transform(fs, lambda f: fails[f]), true), 6) AS falls FROM counts, orders),
steps AS (
    SELECT part, fs, step, fs[step] AS f, sum(CASE WHEN falls > step THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN falls = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN falls < step AND fails[fs[step]] THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN k = 1 AND fails[fs[step]] THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN falls = step THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN falls = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM walked, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY part, fs, step)
SELECT part, array_to_string(list_transform(fs, lambda f: substr('ABCDE', f, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
    CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM steps
"""
