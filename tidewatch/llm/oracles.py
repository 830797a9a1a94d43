"""SQL equivalents of the queries that SQL can express, in its own terms.

Not here: language models, SimHash components (all pairs would be compared), disguised
personal data, tokenizers and Spark's hash function. Tests compare those with plain
versions. Thresholds of the quality rules are exact quantiles here; the sketches of the
query equal them while a group has fewer texts than a sketch holds.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP6 = f"""
    WITH d AS (SELECT doc_id, {_bench_words('text')} AS w FROM documents),
    b AS (SELECT cast(item_id AS varchar) AS item, w, least(10, len(w)) AS k
          FROM (SELECT item_id, {_bench_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
    tests AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
              FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    probes AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
               FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
                     FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, item, i, k FROM probes JOIN tests USING (k, g)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits)
              GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS named
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
           sha256(coalesce(named, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> (35 - 5 * k)) & 31 AS int) + 1, 1)"
OP9 = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
    digits AS (SELECT page_id, string_agg({_DIGIT}, '' ORDER BY part, k) AS payload_digest
               FROM (SELECT page_id, part, cast('0x' || substr(hex, 1 + 10 * part, 10) AS bigint) AS v
                     FROM p, range(4) AS r(part)), range(8) AS s(k) GROUP BY page_id),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS lead FROM p)
    SELECT page_id, cast(strlen(body) AS bigint) AS payload_bytes, payload_digest,
           CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> lead THEN lead END AS refers_to, cast(NULL AS varchar) AS error
    FROM f JOIN digits USING (page_id)"""

_RULES = {"word_length": 1.0, "symbol_rate": 0.1, "dup_line_rate": 0.4, "repeat_rate": 0.3}


def _fence(measure: str) -> str:
    """The measure lies within three interquartile ranges and its margin around the quartiles."""
    low, high = (f"(g.n / (g.n + 200) * g.{measure}[{i}] + (1 - g.n / (g.n + 200)) * (l.n / (l.n + 200) * l.{measure}[{i}] "
                 f"+ (1 - l.n / (l.n + 200)) * a.{measure}[{i}]))" for i in (1, 2))
    reach = f"(3.0 * (({high}) - ({low})) + {_RULES[measure]})"
    return f"m.{measure} BETWEEN ({low}) - {reach} AND ({high}) + {reach}"


_QUARTILES = ", ".join(f"[quantile_disc({m}, 0.25), quantile_disc({m}, 0.75)] AS {m}" for m in _RULES)
OP10 = rf"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS body,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice)
                 GROUP BY doc_id),
    lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
              FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM t)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    c AS (SELECT t.doc_id, lang, source, cast(len(w) AS bigint) AS n_words,
                 cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
                 cast(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
                 coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
                 coalesce(lines.n, 0) AS n_lines
          FROM t LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)),
    m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbol_rate,
                 n_dup_lines / greatest(n_lines, 1) AS dup_line_rate,
                 n_repeat_words / greatest(n_words, 1) AS repeat_rate FROM c),
    g AS (SELECT lang, source, count(*) AS n, {_QUARTILES} FROM m WHERE n_words > 0 GROUP BY lang, source),
    l AS (SELECT lang, count(*) AS n, {_QUARTILES} FROM m WHERE n_words > 0 GROUP BY lang),
    a AS (SELECT {_QUARTILES} FROM m WHERE n_words > 0)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           coalesce(NOT base_failed AND {' AND '.join(map(_fence, _RULES))}, false) AS kept
    FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
    LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""

SQL: dict[str, str] = {"op6_decontaminate": OP6, "op9_warc": OP9, "op10_quality": OP10}
