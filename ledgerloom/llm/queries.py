"""One query for each operator of this package over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import contamination, htmltext, jaccard, langid, pieces, pii, quality, substrings, tokenstore, urlcascade
from .common import scratch, table


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    tokenstore.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return tokenstore.read_documents(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score_quality(documents, model)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_texts(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlcascade.judge(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find_personal_data(documents, pii.fit(documents)).drop("masked")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that no model decides."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "probability")


def personal_data_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op8 that no model decides."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"), None)
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_quality_rules, op3_decontamination, op4_ngram_jaccard, op5_language_id, op6_url_filter, op7_substring_dedup, op8_personal_data, op9_sentencepiece, op10_html_text, quality_base_counts, personal_data_base_counts)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "quality_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 7) + 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(rep.n, 0) > 30 * len(w) AS base_failed
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)""",
    "personal_data_base_counts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT) <= 255)))) AS BIGINT) AS n_ip,
CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: string_split(reverse(regexp_replace(x, '[ -]', '', 'g')), '')), lambda x: len(x) BETWEEN 13 AND 19
  AND list_sum(list_transform(x, lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM d""",
    "op3_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT s.doc_id, s.i, s.n, win.item_id FROM spots s JOIN win ON win.n = s.n AND win.g = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM dw WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS d, x AS r FROM sym UNION SELECT reach.d, sym.y FROM reach JOIN sym ON sym.x = reach.r),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT dw.doc_id, coalesce(sz.n, 0) AS n_shingles, coalesce(comp.c, dw.doc_id) AS component_id
FROM dw LEFT JOIN sz USING (doc_id) LEFT JOIN comp ON comp.d = dw.doc_id""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u),
q AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM p),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(rh, rp, v)),
m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
      FROM q JOIN rules ON (q.host = rh OR ends_with(q.host, '.' || rh)) AND starts_with(q.path, rp))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.k = 1""",
}

