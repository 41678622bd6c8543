"""The queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (
    bpe, collocations, compression, langid, license_tfidf, line_winnow, mixing, periodic_runs, pii, secret_ledger,
    suffix_dedup, va_file, vp_simhash,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_file_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_winnow.drop_copied_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_deleted", "text")


def domain(source: Column) -> Column:
    """The domain of a source, by its number; sources without one are in ``web``."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint") % 3
    return F.when(number == 1, "books").when(number == 2, "reference").otherwise("web")


#: Weights of domains and of languages in a domain; sources in a language weigh alike.
MIX_WEIGHTS = {("web",): 5, ("books",): 3, ("reference",): 2} | {
    (d, lang): w for d in ("web", "books", "reference") for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))}


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    return mixing.mix(docs, [domain(F.col("source")), F.col("lang"), F.col("source")], MIX_WEIGHTS, **options)


def op4_hierarchical_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs, share=0.6, max_epochs=2, seed=17).select(
        "doc_id", domain(F.col("source")).alias("domain"), "lang", "source",
        mixing.word_tokens().alias("n_tokens"), "copies")


def op5_bpe_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(_table(spark, sf_dir, "documents"))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def _listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    versions = docs.select(F.col("source").alias("path"), F.col("doc_id").alias("version"), "text")
    base = F.filter("found", lambda s: s["kind"].isin(*secret_ledger.BASE))
    return secret_ledger.scan_versions(versions).select(
        F.col("version").alias("doc_id"), *[_count("found", k) for k in secret_ledger.BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed("found").alias("spans"))


def op8_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_tfidf.scan_licenses(files).select(
        F.regexp_extract("path", "([^/]*)$", 1).cast("bigint").alias("doc_id"), "path", "license", "cosine", "origin",
        "license_path")


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents")).select(
        "doc_id", *[_count("base", k) for k in pii.KINDS],
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def op10_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(
        _table(spark, sf_dir, "documents"),
        ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"),
        change=periodic_runs.plant_period)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def _license_sql(least: float = 0.7) -> str:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    notices, fulls = license_tfidf.TEMPLATES, license_tfidf.FULL_TEXTS
    given = ", ".join(f"({i}, {text(name)}, {text(body)}, {i >= len(notices)})" for i, (name, body) in enumerate([*notices, *fulls]))
    stop = "[" + ", ".join(map(text, license_tfidf.STOP_WORDS)) + "]"
    words = f"list_distinct(regexp_extract_all(lower({{0}}), '{license_tfidf.WORDS}'))"

    def measured(templates: Sequence[tuple[str, str]]) -> tuple[str, str]:
        found = {w for _, body in templates for w in re.findall(license_tfidf.WORDS, body.lower())}
        known = "[" + ", ".join(map(text, sorted(found - set(license_tfidf.STOP_WORDS)))) + "]"
        return (f"list_filter(words, lambda x: list_contains({known}, x))",
                f"len(list_filter(words, lambda x: NOT list_contains({known}, x) AND NOT list_contains({stop}, x)))")

    (known, others), (full_known, full_others) = measured(notices), measured(fulls)
    return f"""
WITH given(template, license, body, is_full) AS (VALUES {given}),
terms AS (
  SELECT template, license, is_full, term FROM (SELECT template, license, is_full, unnest({words.format('body')}) AS term FROM given)
  WHERE NOT list_contains({stop}, term)
), vocabulary AS (SELECT DISTINCT term FROM terms),
files AS (
  SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, coalesce(text, '') AS body FROM documents
), wholes AS (
  SELECT path, {known} AS terms, {others} AS others, {full_known} AS full_terms, {full_others} AS full_others
  FROM (SELECT path, {words.format('body')} AS words FROM files)
), lines AS (
  SELECT * FROM (
    SELECT path, line, {known} AS terms, {others} AS others FROM (
      SELECT path, line, {words.format('body')} AS words FROM (
        SELECT path, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) AS line
        FROM files)))
  WHERE len(terms) > 0
), blocks AS (
  SELECT *, sum(CASE WHEN line = before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line) AS block
  FROM (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line) AS before FROM lines)
), units AS (
  SELECT path, 'line' AS kind, line AS unit, terms, others FROM lines
  UNION ALL
  SELECT path, 'block', block, list_distinct(flatten(list(terms))), sum(others) FROM blocks GROUP BY path, block HAVING count(*) > 1
  UNION ALL
  SELECT path, 'whole', 0, terms, others FROM wholes WHERE len(terms) > 0
  UNION ALL
  SELECT path, 'full', 0, full_terms, full_others FROM wholes WHERE len(full_terms) > 0
), df AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(terms, full_terms))) AS term FROM wholes) GROUP BY term
), idf AS (
  SELECT term, ln(((SELECT count(*) FROM files) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM vocabulary LEFT JOIN df USING (term)
), rare AS (SELECT ln(CAST((SELECT count(*) FROM files) + 1 AS DOUBLE)) + 1 AS idf),
weighed AS (
  SELECT path, kind, unit, others, term, idf FROM (SELECT path, kind, unit, others, unnest(terms) AS term FROM units) JOIN idf USING (term)
), squares AS (
  SELECT path, kind, unit, sum(idf * idf) + max(others) * (SELECT idf * idf FROM rare) AS square FROM weighed GROUP BY ALL
), norms AS (
  SELECT template, license, sum(idf * idf) AS square FROM terms JOIN idf USING (term) GROUP BY ALL
), close AS (
  SELECT d.path, d.kind, n.license, round(d.dot / sqrt(s.square * n.square), 6) AS cosine
  FROM (SELECT path, kind, unit, template, sum(idf * idf) AS dot FROM weighed JOIN terms USING (term) WHERE is_full = (kind = 'full') GROUP BY ALL) d
  JOIN squares s USING (path, kind, unit) JOIN norms n USING (template)
), best AS (
  SELECT path, kind IN ('whole', 'full') AS whole, license, cosine,
    row_number() OVER (PARTITION BY path, kind IN ('whole', 'full') ORDER BY cosine DESC, license) AS place
  FROM close WHERE cosine >= {least}
), own AS (
  SELECT f.doc_id, f.path, regexp_replace(f.path, '(^|/)[^/]*$', '') AS folder, coalesce(w.license, h.license) AS license,
    coalesce(w.cosine, h.cosine) AS cosine,
    CASE WHEN w.license IS NOT NULL OR (h.license IS NOT NULL AND regexp_matches(f.path, '(?i)(^|/)(LICEN[SC]E|COPYING)(\\.[a-z]+)?$'))
      THEN 'file' WHEN h.license IS NOT NULL THEN 'header' END AS origin
  FROM files f LEFT JOIN (SELECT * FROM best WHERE whole AND place = 1) w ON f.path = w.path
  LEFT JOIN (SELECT * FROM best WHERE NOT whole AND place = 1) h ON f.path = h.path
), covers AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, path) AS place FROM own WHERE origin = 'file')
  WHERE place = 1
), nearest AS (
  SELECT o.path, arg_max(c.path, length(c.folder)) AS from_path, arg_max(c.license, length(c.folder)) AS license,
    arg_max(c.cosine, length(c.folder)) AS cosine
  FROM own o JOIN covers c ON o.origin IS NULL AND (c.folder = '' OR o.folder = c.folder OR starts_with(o.folder, c.folder || '/'))
  GROUP BY o.path
)
SELECT o.doc_id, o.path, coalesce(o.license, n.license) AS license, coalesce(o.cosine, n.cosine) AS cosine,
  CASE WHEN o.origin IS NULL AND n.path IS NOT NULL THEN 'inherited' ELSE o.origin END AS origin,
  CASE WHEN o.origin IS NOT NULL THEN o.path ELSE n.from_path END AS license_path
FROM own o LEFT JOIN nearest n ON o.path = n.path
"""


QUERIES = {f.__name__: f for f in (
    op1_va_file_top_k, op2_simhash_vp_tree, op3_line_winnowing, op4_hierarchical_budgets, op5_bpe_tree_join,
    op6_compression_bands, op7_secret_ledger, op8_license_tfidf, op9_pii_spans, op10_string_kernel_language,
    op11_phrase_collocations, op12_periodic_runs, op13_suffix_dedup,
)}

ORACLES = {
    "op1_va_file_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place AS query, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.place <> c.place AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored)
WHERE place <= 20
""",
    "op3_line_winnowing": r"""
WITH plain AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: CASE WHEN regexp_full_match(x, '[\x20\x09-\x0D]*') THEN '' ELSE x END) AS h
  FROM plain
), starts AS (
  SELECT doc_id, lines, h, unnest(range(0, len(lines))) AS start FROM l
), windows AS (
  SELECT doc_id, start, 3 AS size, list_slice(h, start + 1, start + 3) AS content FROM starts
  WHERE start + 3 <= len(lines) AND len(list_filter(list_slice(h, start + 1, start + 3), lambda x: x <> '')) > 0
  UNION ALL
  SELECT doc_id, start, 1, [h[start + 1]] FROM starts
  WHERE len(regexp_extract_all(lines[start + 1], '[^\x20\x09-\x0D]+')) >= 50
), copied AS (
  SELECT doc_id, start, size
  FROM (SELECT *, row_number() OVER (PARTITION BY size, content ORDER BY doc_id, start) AS place FROM windows)
  WHERE place > 1
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS line FROM copied
), kept AS (
  SELECT s.doc_id, string_agg(s.lines[s.start + 1], chr(10) ORDER BY s.start) AS text
  FROM starts s LEFT JOIN cut c ON s.doc_id = c.doc_id AND s.start = c.line WHERE c.line IS NULL GROUP BY s.doc_id
), n AS (SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(p.lines), 0) AS BIGINT) AS n_lines, coalesce(n.n, 0) AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN plain p ON d.doc_id = p.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op4_hierarchical_budgets": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 3 WHEN 1 THEN 'books' WHEN 2 THEN 'reference' ELSE 'web' END AS domain
  FROM documents
), leaf AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, 2 * sum(n_tokens) AS cap FROM d GROUP BY ALL
),
-- each level: children in the order in which they fill up
a AS (
  SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w,
         CAST(floor((SELECT sum(tokens) FROM leaf) * 0.6) AS HUGEINT) AS b FROM leaf GROUP BY domain
), a1 AS (
  SELECT *, cap * sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (b - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM a
), a2 AS (
  SELECT *, sum(w) FILTER (NOT f) OVER () AS ow, b - coalesce(sum(cap) FILTER (f) OVER (), 0) AS r FROM a1
), a3 AS (
  SELECT *, CASE WHEN f THEN cap ELSE w * r // ow + CASE WHEN row_number() OVER (PARTITION BY f ORDER BY domain)
    <= r - sum(w * r // ow) FILTER (NOT f) OVER () THEN 1 ELSE 0 END END AS g FROM a2
),
b AS (
  SELECT l.domain, l.lang, sum(l.cap) AS cap, CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w, max(a3.g) AS b
  FROM leaf l JOIN a3 ON l.domain = a3.domain GROUP BY l.domain, l.lang
), b1 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY CAST(cap AS DOUBLE) / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM b
), b2 AS (
  SELECT *, sum(w) FILTER (NOT f) OVER (PARTITION BY domain) AS ow, b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY domain), 0) AS r FROM b1
), b3 AS (
  SELECT *, CASE WHEN f THEN cap ELSE w * r // ow + CASE WHEN row_number() OVER (PARTITION BY domain, f ORDER BY lang)
    <= r - sum(w * r // ow) FILTER (NOT f) OVER (PARTITION BY domain) THEN 1 ELSE 0 END END AS g FROM b2
),
c AS (
  SELECT l.domain, l.lang, l.source, l.tokens, l.cap, 1 AS w, b3.g AS b
  FROM leaf l JOIN b3 ON l.domain = b3.domain AND l.lang = b3.lang
), c1 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY CAST(cap AS DOUBLE) / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY CAST(cap AS DOUBLE) / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM c
), c2 AS (
  SELECT *, sum(w) FILTER (NOT f) OVER (PARTITION BY domain, lang) AS ow, b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY domain, lang), 0) AS r FROM c1
), c3 AS (
  SELECT *, CASE WHEN f THEN cap ELSE w * r // ow + CASE WHEN row_number() OVER (PARTITION BY domain, lang, f ORDER BY source)
    <= r - sum(w * r // ow) FILTER (NOT f) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END END AS g FROM c2
), e AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN g // tokens ELSE 0 END AS whole, g - CASE WHEN tokens > 0 THEN g // tokens ELSE 0 END * tokens AS rest FROM c3
), keyed AS (
  SELECT d.*, e.whole, e.rest, md5('17:' || e.whole || ':' || d.doc_id) AS k
  FROM d JOIN e ON d.domain = e.domain AND d.lang = e.lang AND d.source = e.source
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) - n_tokens AS before FROM keyed
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed WHERE whole + CASE WHEN before < rest THEN 1 ELSE 0 END > 0
""",
    "op8_license_tfidf": _license_sql(),
    "op11_phrase_collocations": r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1 AND f >= 10
), sized AS (
  SELECT c.*, h.f AS l, t.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cuts c JOIN f h ON c.lang = h.lang AND h.phrase = array_to_string(list_slice(c.w, 1, c.k), ' ')
  JOIN f t ON c.lang = t.lang AND t.phrase = array_to_string(list_slice(c.w, c.k + 1, c.size), ' ')
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM sized) WHERE place = 1
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM lowest s JOIN (
    SELECT lang, a, array_to_string(list_slice(w, 1, 2), ' ') AS inner_phrase FROM lowest WHERE size = 3
    UNION ALL SELECT lang, a, array_to_string(list_slice(w, 2, 3), ' ') FROM lowest WHERE size = 3
  ) b ON s.lang = b.lang AND s.phrase = b.inner_phrase AND 100 * b.a >= 50 * s.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
