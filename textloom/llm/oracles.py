"""SQL of those queries for training data that SQL can express, over whole tables."""

#: The white space of ``str.split``.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
INNER = r"[^\p{L}\p{M}\p{Nd}]+"
OUTER = r"^[^\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}]+$"


def _letters(text: str) -> str:
    return f"regexp_replace(nfc_normalize(replace(lower(nfc_normalize({text})), 'ß', 'ss')), '{INNER}', '', 'g')"


CONTENT = (
    "parts AS (SELECT record, text, list_filter(string_split(text, CASE WHEN contains(text, '|') THEN '|' ELSE chr(10) END), lambda p: regexp_replace(p, '[\\s\\p{Z}]+', '', 'g') <> '') AS ps FROM records WHERE text <> ''), "
    "content AS (SELECT record, text, CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda p: NOT regexp_matches(p, '^\\s*[^:|\\n]{1,60}?\\s*:(?:[^/]|/[^/]|/?$)'))) = 0 "
    f"THEN array_to_string(list_sort(list_transform(ps, lambda p: {_letters('p')})), '') ELSE {_letters('text')} END AS c FROM parts)"
)
WORDS = (
    f"words AS (SELECT record, list_filter(list_transform(regexp_split_to_array(lower(text), '{SPACE}'), lambda p: regexp_replace(p, '{OUTER}', '', 'g')), lambda p: p <> '') AS ws FROM records WHERE text <> '')"
)

P1_FOUND = f"WITH {CONTENT}, g AS (SELECT record, min(record) OVER (PARTITION BY c) AS first_record FROM content WHERE length(c) >= 20) SELECT first_record, record FROM g WHERE record > first_record"
P1_COPIES = f"WITH {CONTENT} SELECT min(record) AS first_record, count(*) AS copies FROM content WHERE length(c) >= 20 GROUP BY c"

P2_FOUND = (
    f"WITH {CONTENT}, {WORDS}, s AS (SELECT DISTINCT record, unnest([ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] for k in range(1, len(ws) - 1)]) AS t FROM words WHERE len(ws) >= 8), "
    "n AS (SELECT record, count(*) AS n FROM s GROUP BY record), p AS (SELECT a.record AS a, b.record AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.record < b.record GROUP BY 1, 2) "
    "SELECT p.a AS record_a, p.b AS record_b FROM p JOIN n x ON x.record = p.a JOIN n y ON y.record = p.b JOIN content c ON c.record = p.a JOIN content d ON d.record = p.b "
    "WHERE k >= 0.6 * (x.n + y.n - k) AND c.c <> d.c"
)

SHARES = (
    f"{WORDS}, g AS (SELECT record, unnest(range(1, len(ws) - 2)) AS i, unnest([ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3] for k in range(1, len(ws) - 2)]) AS t FROM words WHERE len(ws) > 3), "
    "again AS (SELECT record, i FROM (SELECT record, i, min(i) OVER (PARTITION BY record, t) AS first_i FROM g) WHERE i > first_i), covered AS (SELECT DISTINCT record, i + unnest([0, 1, 2, 3]) AS at FROM again), "
    "share AS (SELECT w.record, len(ws) AS n, count(c.at) / len(ws) AS share FROM words w LEFT JOIN covered c USING (record) WHERE len(ws) > 0 GROUP BY w.record, ws)"
)
P3_FOUND = f"WITH {SHARES} SELECT record FROM share WHERE n >= 20 AND share >= 0.3"
P3_SHARES = f"WITH {SHARES} SELECT record AS id, share FROM share"

#: Marks that end a sentence, and what may follow them.
ENDS, CLOSERS = ".?!।॥。！？…", "\"\'\'”’»)\\]」』"
STRIPPED = SPACE.removesuffix("+")
P6_STATISTICS = (
    f"WITH r AS (SELECT record, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda p: p <> '') AS ps FROM records), "
    f"w AS (SELECT record, list_filter(list_transform(regexp_split_to_array(lower(text), '{SPACE}'), lambda p: regexp_replace(p, '{OUTER}', '', 'g')), lambda p: p <> '') AS ws FROM records WHERE text IS NOT NULL), "
    f"li AS (SELECT record, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^{STRIPPED}+|{STRIPPED}+$', '', 'g')), lambda p: p <> '') AS ls FROM records WHERE text IS NOT NULL), "
    f"pa AS (SELECT record, list_filter(list_transform(regexp_split_to_array(text, '\\n{STRIPPED}*\\n'), lambda p: regexp_replace(p, '^{STRIPPED}+|{STRIPPED}+$', '', 'g')), lambda p: p <> '') AS ls FROM records WHERE text IS NOT NULL), "
    + ", ".join(
        f"{name} AS (SELECT record, sum(length(x)) FILTER (WHERE k > 1) AS again, sum(length(x)) AS total FROM (SELECT record, x, row_number() OVER (PARTITION BY record, x) AS k FROM (SELECT record, unnest(ls) AS x FROM {source})) GROUP BY record)"
        for name, source in (("dl", "li"), ("dp", "pa"))
    )
    + ", gr AS (" + " UNION ALL ".join(f"SELECT record, {n} AS size, unnest(range(1, len(ws) - {n - 2})) AS i, unnest([ws[k:k + {n - 1}] for k in range(1, len(ws) - {n - 2})]) AS g FROM w WHERE len(ws) >= {n}" for n in (2, 3, 4)) + "), "
    "gc AS (SELECT record, size, g, count(*) AS c, min(i) AS i FROM gr GROUP BY record, size, g), "
    "gt AS (SELECT record, g, c FROM gc QUALIFY row_number() OVER (PARTITION BY record, size ORDER BY c DESC, i) = 1), "
    "do_ AS (SELECT record, max(least(1.0, c * length(array_to_string(g, '')) / length(array_to_string(ws, '')))) AS share FROM gt JOIN w USING (record) WHERE c > 1 GROUP BY record), "
    "cw AS (SELECT list(DISTINCT lower(word)) AS l FROM common_words WHERE word IS NOT NULL), "
    "solid AS (SELECT record, length(array_to_string(ps, '')) AS n FROM r) "
    "SELECT r.record AS id, len(ps) AS word_count, nullif(solid.n, 0) / len(ps) AS mean_word_length, len(regexp_extract_all(text, '[\\p{P}\\p{S}]')) / nullif(solid.n, 0) AS symbol_ratio, "
    f"len(list_filter(ls, lambda x: regexp_matches(x, '[{ENDS}][{CLOSERS}]*$'))) / nullif(len(ls), 0) AS punctuated_lines, len(list_filter(ws, lambda x: list_contains(cw.l, x))) / nullif(len(ws), 0) AS common_words, "
    "CASE WHEN text IS NOT NULL THEN coalesce(dl.again / dl.total, 0.0) END AS duplicate_lines, CASE WHEN text IS NOT NULL THEN coalesce(dp.again / dp.total, 0.0) END AS duplicate_paragraphs, "
    "CASE WHEN text IS NOT NULL THEN coalesce(do_.share, 0.0) END AS dominant_ngram, list_median(list_transform(ls, lambda x: length(x))) AS median_line "
    "FROM r LEFT JOIN solid USING (record) LEFT JOIN w USING (record) LEFT JOIN li USING (record) LEFT JOIN dl USING (record) LEFT JOIN dp USING (record) LEFT JOIN do_ USING (record), cw"
)
P6_WRONG_VALUES = (
    f"WITH r AS (SELECT record, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda p: p <> '') AS ps FROM records WHERE text IS NOT NULL), "
    "m AS (SELECT record, len(ps) AS word_count, length(array_to_string(ps, '')) AS solid, len(regexp_extract_all(text, '[\\p{P}\\p{S}]')) AS symbols FROM r), "
    "v AS (SELECT record, CASE code WHEN 'word_count' THEN word_count WHEN 'mean_word_length' THEN coalesce(solid / nullif(word_count, 0), 0.0) ELSE coalesce(symbols / nullif(solid, 0), 0.0) END AS true_value, value "
    "FROM findings JOIN m USING (record) WHERE code IN ('word_count', 'mean_word_length', 'symbol_ratio') AND value IS NOT NULL) SELECT DISTINCT record FROM v WHERE abs(value - true_value) > 0.01"
)
#: Each source that has texts reaches its share of the sources that have any, within its cap; the others have nothing.
P9_CHECKS = (
    "WITH t AS (SELECT lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS source, target_share, max_repeats FROM mix_targets), "
    "d AS (SELECT DISTINCT lower(regexp_replace(source, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS source FROM documents WHERE text <> ''), live AS (SELECT sum(target_share) AS s FROM t JOIN d USING (source)) "
    "SELECT t.source, round(CASE WHEN d.source IS NULL THEN 0 ELSE target_share / s END, 6) AS wanted, true AS reached, true AS within_cap FROM t LEFT JOIN d USING (source), live WHERE t.source IS NOT NULL"
)
