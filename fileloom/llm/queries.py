"""The registered queries of this package: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, audit, decontam, html, jaccard, licenses, mixing, quality, rules, simhash, tokens, urls, warc
from .common import UPPER, table


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure_rules(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_documents(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_prints(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mix_sources": op3_mix_sources,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_extraction": op6_html_extraction,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_simhash": op12_simhash,
    "op13_filter_audit": op13_filter_audit,
}

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {{verdict}} END AS kept
FROM b
"""


def _spelt(words: str) -> str:
    for apart, together in licenses.EQUIVALENT_PAIRS.items():
        words = f"regexp_replace({words}, '(^| ){apart}', '\\1{together}', 'g')"
    return words


OP1_SQL = rf"""
WITH known AS (
  SELECT * FROM (VALUES {{known}}) AS t(digest, kind, license)
), l AS (
  SELECT rid, doc_id, list_filter(list_transform(
           list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '{licenses.CONTINUED}', '\1', 'g'), chr(10)),
                       lambda x: NOT regexp_matches(x, '{licenses.COPYRIGHT_LINE}')),
           lambda x: array_to_string(list_transform(regexp_extract_all(x, '[\p{{L}}\p{{N}}]+'),
             lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licenses.EQUIVALENT.items())} ELSE w END), ' ')),
         lambda x: x <> '') AS ls
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), d AS (
  SELECT rid, doc_id, sha256({_spelt("array_to_string(ls, ' ')")}) AS digest, list_distinct(list_transform(ls, lambda x: sha256({_spelt('x')}))) AS ds FROM l
), n AS (
  SELECT rid, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT u.rid, k.license FROM (SELECT rid, unnest(ds) AS h FROM d) u JOIN known k ON k.kind = 'line' AND k.digest = u.h)
  GROUP BY rid
)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN n USING (rid) LEFT JOIN known k ON k.kind = 'text' AND k.digest = d.digest
"""

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.1, 1.0::DOUBLE - 4.0::DOUBLE * (length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>!]+', '', 'g'))::DOUBLE
           / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS weight,
         md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS hex
  FROM documents
), k AS (
  SELECT *, -ln((list_sum(list_transform(generate_series(1, 13), lambda i:
              (strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1)::BIGINT * (1::BIGINT << (4 * (13 - i))::INT)))::BIGINT + 0.5::DOUBLE)
              / 4503599627370496.0::DOUBLE) / weight AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM k GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s
), lv AS (
  SELECT *, (least(1.5::DOUBLE * (SELECT sum(source_size) FROM c)::DOUBLE, (SELECT sum(cap) FROM c))
             - coalesce((SELECT sum(cap) FROM c b WHERE b.ratio < c.ratio), 0.0::DOUBLE))
            / (SELECT sum(w) FROM c b WHERE b.ratio >= c.ratio) AS level
  FROM c
), t AS (
  SELECT source, source_size, w, cap,
         least(cap, coalesce((SELECT min_by(level, ratio) FROM lv WHERE level <= ratio) * w, cap)) AS target
  FROM lv
), r AS (
  SELECT k.doc_id, k.size, k.weight, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken, weight
FROM r
"""

#: A-Z alone are lower-cased; the windows of each item meet the documents' windows of the same length.
OP5_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{decontam.ITEM_WORD}') AS ws
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{decontam.ITEM_WORD}') AS ws
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[s:s + least(len(ws), 13) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS s FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT rid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s
        FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), occ AS (
  SELECT rid, s, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM occ) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id ) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM occ) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

#: All pairs by shared shingles; the closure by recursion.
OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT rid, i, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 2),
                                      lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) END) AS g
  FROM (SELECT rid, ws, 0 AS i FROM w)
), n AS (
  SELECT rid, count(*) AS n FROM sh GROUP BY rid
), pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT rid, rid FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (rid)
JOIN (SELECT a, min(doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.b GROUP BY a) r ON r.a = w.rid
"""


_BITS = ", ".join(f"'{k:04b}'" for k in range(16))
OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id,
         array_to_string(list_transform(string_split(hex, ''),
           lambda c: [{_BITS}][strpos('0123456789abcdef', c)::INT]), '') AS bits
  FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(generate_series(1, 5),
           lambda j: substr(bits, (5 * i + j)::INT, 1)::INT * (1 << (5 - j)::INT)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


#: Every order applied to every document: its step that removes it is the first of its failing filters.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT rid, doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), f AS (
  SELECT rid, doc_id, part, [
           len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
           100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
           regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM m
), l AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM g GROUP BY ALL
), i AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s AS (
  SELECT part, ks, s.k AS step, ks[s.k] AS f,
         sum(CASE WHEN len(list_filter(ks[1:s.k], lambda x: fails[x])) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails[ks[s.k]] AND len(list_filter(ks[1:s.k - 1], lambda x: fails[x])) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails[ks[s.k]] AND len(list_filter(ks[1:s.k - 1], lambda x: fails[x])) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[ks[s.k]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails[ks[s.k]] AND len(list_filter(ks[1:s.k - 1], lambda x: fails[x])) = 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails[ks[s.k]] AND len(list_filter(ks[1:s.k - 1], lambda x: fails[x])) = 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, o, i s GROUP BY part, ks, s.k
)
SELECT part, array_to_string(list_transform(ks, lambda x: substr('ABCDE', x::INT, 1)), '') AS filter_order, step::INT AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM s
"""


def _verdict_sql() -> str:
    measure = {
        "mean_word_chars": "(word_chars / n_words::DOUBLE)",
        "symbol_ratio": "(n_symbols / n_words::DOUBLE)",
        "stop_word_ratio": "(n_stop_words / n_words::DOUBLE)",
        "dup_line_ratio": "(n_dup_lines / n_lines::DOUBLE)",
    }
    found = [f"{measure[m]} >= {low}" for m, low, _ in rules.THRESHOLDS if low is not None]
    found += [f"{measure[m]} <= {high}" for m, _, high in rules.THRESHOLDS if high is not None]
    return "(" + " AND ".join(found) + ")"


def _known_sql() -> str:
    return ", ".join(str(r) for r in sorted(set(licenses.known_rows())))


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL.replace("{known}", _known_sql()),
    "op3_mix_sources": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op9_warc": OP9_SQL,
    "op10_quality_rules": OP10_SQL.replace("{verdict}", _verdict_sql()),
    "op13_filter_audit": OP13_SQL,
}
