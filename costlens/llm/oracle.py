"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import REST, SEED
from .quality import RULES, STOP_WORDS, STOP_WORDS_FROM
from .queries import MIX_TARGETS


def _mixing() -> str:
    named = ", ".join(f"'{s}'" for s in MIX_TARGETS)
    weights = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in MIX_TARGETS.items())
    rest = max(0.0, 1.0 - sum(MIX_TARGETS.values()))
    bits = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
    key = "coalesce(CAST(doc_id AS VARCHAR), md5(text), '')"
    draw = bits.format(f"'{SEED}|' || {key}")
    order = bits.format(f"'{SEED}|order|' || {key} || '|' || CAST(copy AS VARCHAR)")
    return f"""
WITH d AS (SELECT *, CASE WHEN source IN ({named}) THEN source ELSE '{REST}' END AS g,
                  {draw} / 4503599627370496.0::DOUBLE AS u
           FROM documents),
     w(g, weight) AS (VALUES {weights}, ('{REST}', {rest!r}::DOUBLE)),
     b AS (SELECT g, sum(coalesce(strlen(text), 0)) AS own FROM d GROUP BY g),
     r AS (SELECT g, CASE WHEN own > 0 THEN weight * (SELECT sum(own) FROM b)::DOUBLE / own ELSE 1.0 END AS rate
           FROM b JOIN w USING (g)),
     p AS (SELECT g, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
           FROM r, (SELECT unnest(range(0, 120)) AS k) WHERE rate > 0),
     c AS (SELECT g, list(total ORDER BY k) AS totals
           FROM (SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS total FROM p) GROUP BY g),
     n AS (SELECT d.*, unnest(range(0, len(list_filter(totals, lambda x: x <= u)))) AS copy FROM d JOIN c USING (g))
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {order} AS shuffle_key FROM n
"""


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    ratio = {"mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words",
             "stop_word_ratio": "n_stop_words / n_words", "dup_line_ratio": "n_dup_lines / n_lines",
             "mean_line_words": "n_words / n_lines"}
    broken = []
    for name, least, greatest in RULES:
        bounds = [f"{ratio[name]} {op} {x!r}" for op, x in (("<", least), (">", greatest)) if x is not None]
        below = ratio[name].split(" / ")[1]
        least_words = STOP_WORDS_FROM if name == "stop_word_ratio" else 1
        broken.append(f"CASE WHEN {below} >= {least_words} AND ({' OR '.join(bounds)}) THEN '{name}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
           FROM d),
     t AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
     g AS (SELECT r, i, len(words) AS n, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] AS five
           FROM w JOIN t USING (r)),
     f AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM g WHERE i + 4 <= n),
     c AS (SELECT DISTINCT r, i + k AS i FROM f, (SELECT unnest(range(0, 5)) AS k) WHERE times >= 2),
     m AS (SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                  len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                  (SELECT count(*) FROM c WHERE c.r = d.r) AS n_repeat_words, len(lines) AS n_lines,
                  len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words
           FROM d JOIN w USING (r)),
     b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                  concat_ws(',', {", ".join(broken)}) AS broken FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, n_lines, n_stop_words, broken
FROM b
"""


def _audit() -> str:
    letters = "ABCDE"
    slots = ", ".join(f"(SELECT unnest(string_split('{letters}', '')) AS l{i}) AS t{i}" for i in range(1, 6))
    order = " || ".join(f"l{i}" for i in range(1, 6))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
     q AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
     f AS (SELECT r, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  concat(CASE WHEN len(words) < 200 THEN 'A' END,
                         CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                         CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
                         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
                         CASE WHEN doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' END) AS failed
           FROM d LEFT JOIN q USING (doc_id)),
     o AS (SELECT {order} AS filter_order FROM {slots} WHERE len(list_distinct([l1, l2, l3, l4, l5])) = 5),
     s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter,
                  substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
     x AS (SELECT part, filter_order, step, letter, good, toxic, failed,
                  contains(failed, letter) AS fails, translate(failed, earlier, '') <> failed AS gone
           FROM f, s),
     c AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT fails AND NOT gone) AS kept,
                  count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant,
                  count(*) FILTER (failed = letter) AS unique_fails,
                  count(*) FILTER (fails AND NOT gone AND good = 1) AS good_lost,
                  count(*) FILTER (fails AND NOT gone AND toxic = 1) AS toxic_lost
           FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM c
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _mixing(), "op10_quality": _quality(), "op13_audit": _audit()}
