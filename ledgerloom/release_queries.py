"""Registered queries that build and check a ledger, each with its SQL; importing this adds them to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import _number, _register, _table
from .operators import dataflow, ledgers, retrieval

_SPEC = ledgers.MasterSpec("PART", "key_text", "p_name", (
    ledgers.Field("size_text", "part.size", unit="unit"),
    ledgers.Field("p_brand", "part.brand", "text"),
    ledgers.Field("made", "part.made", "date"),
))

#: A master file of text cells with markers, unreadable numbers, blank and repeated keys.
_MASTER = """raw AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN ' ' WHEN p_partkey % 29 = 0 THEN '29' ELSE CAST(p_partkey AS VARCHAR) END AS key_text, p_name, p_brand,
  CASE WHEN p_partkey % 13 = 0 THEN 'N/A' WHEN p_partkey % 17 = 0 THEN '1x' WHEN p_partkey % 19 = 0 THEN '-' WHEN p_partkey % 7 = 0 THEN '0' ELSE ' ' || CAST(p_size AS VARCHAR) END AS size_text,
  CASE WHEN p_partkey % 3 = 0 THEN '20260131' WHEN p_partkey % 3 = 1 THEN '20260231' END AS made FROM part),
keyed AS (SELECT *, trim(key_text) AS k, CASE WHEN trim(key_text) = '' THEN 2 ELSE count(*) OVER (PARTITION BY trim(key_text)) END AS n FROM raw),
mapped AS (SELECT *, CASE WHEN n > 1 THEN 'quarantined' WHEN size_text = '1x' OR made = '20260231' THEN 'limited' ELSE 'accepted' END AS disposition FROM keyed)"""


def _master(spark, sf_dir):
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.when(k % 23 == 0, " ").when(k % 29 == 0, "29").otherwise(k.cast("string")).alias("key_text"), "p_name", "p_brand",
        F.when(k % 13 == 0, "N/A").when(k % 17 == 0, "1x").when(k % 19 == 0, "-").when(k % 7 == 0, "0").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("size_text"),
        F.when(k % 3 == 0, "20260131").when(k % 3 == 1, "20260231").alias("made"))


@_register("master_dispositions", f"WITH {_MASTER} SELECT disposition, count(*) AS n FROM mapped GROUP BY disposition")
def _(spark, sf_dir):
    return ledgers.map_master(_master(spark, sf_dir), _SPEC).groupBy("disposition").agg(F.count("*").alias("n"))


@_register("master_observations", f"""WITH {_MASTER}, obs AS (
SELECT k, 'part.size' AS metric_id, size_text AS raw_value, CASE WHEN size_text = '-' THEN 'missing' WHEN size_text = 'N/A' THEN 'placeholder' WHEN size_text = '1x' THEN 'unknown' WHEN size_text = '0' THEN 'zero' ELSE 'present' END AS value_status, TRY_CAST(trim(size_text) AS DOUBLE) AS numeric_value, disposition FROM mapped
UNION ALL SELECT k, 'part.brand', p_brand, 'present', NULL, disposition FROM mapped
UNION ALL SELECT k, 'part.made', made, CASE WHEN made IS NULL THEN 'missing' WHEN made = '20260231' THEN 'unknown' ELSE 'present' END, NULL, disposition FROM mapped)
SELECT k AS entity_key, metric_id, raw_value, value_status, numeric_value, CASE value_status WHEN 'missing' THEN 'NOT_REPORTED' WHEN 'placeholder' THEN 'PLACEHOLDER' WHEN 'unknown' THEN 'UNPARSEABLE' END AS reason_code FROM obs WHERE disposition <> 'quarantined'""")
def _(spark, sf_dir):
    rows = ledgers.master_observations(ledgers.map_master(_master(spark, sf_dir), _SPEC))
    return _number(rows.select("entity_key", "metric_id", "raw_value", "value_status", "numeric_value", "reason_code"))


@_register("bind_products", """WITH daily AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 7 = 0 THEN 'renamed' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 11 = 0),
per AS (SELECT code, count(*) AS n, min(name) AS d FROM daily GROUP BY code)
SELECT s_suppkey AS code, s_name AS name, CASE WHEN n IS NULL THEN 'UNMATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'BOUND' END AS binding, CASE WHEN n = 1 THEN s_name <> d END AS name_drift FROM supplier LEFT JOIN per ON code = s_suppkey""")
def _(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    daily = s.where("code % 5 != 0").withColumn("name", F.when(F.col("code") % 7 == 0, "renamed").otherwise(F.col("name"))).unionByName(s.where("code % 11 = 0"))
    return ledgers.bind_products(s, daily)


@_register("current_documents", "SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey - 1 FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") - 1).alias("amends_document_id"))
    return ledgers.current_documents(o).select("document_id")


@_register("representative_population", "SELECT c_nationkey, count(DISTINCT c_custkey - CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 3 END) AS n FROM customer GROUP BY c_nationkey")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), "c_nationkey")
    edges = c.where("entity_id % 3 != 0").select(F.col("entity_id").alias("subject_id"), (F.col("entity_id") - F.col("entity_id") % 3).alias("object_id"))
    return ledgers.representatives(c, edges).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@_register("calculation_verdicts", """WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'max' WHEN 1 THEN 'median' ELSE 'count' END AS op, CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE o_orderkey % 8 END AS claimed FROM orders),
p AS (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS m FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey)
SELECT id AS calculation_id, CASE WHEN op = 'median' THEN 'UNKNOWN_OPERATION' WHEN n IS NULL THEN 'NO_INPUTS' WHEN claimed = CASE op WHEN 'max' THEN m ELSE n END THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM c LEFT JOIN p ON l_orderkey = id""")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    claims = _table(spark, sf_dir, "orders").select(k.alias("calculation_id"), F.when(k % 4 == 0, "max").when(k % 4 == 1, "median").otherwise("count").alias("operation"), F.when(k % 4 == 0, 50).otherwise(k % 8).cast("double").alias("claimed"))
    inputs = _table(spark, sf_dir, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("calculation_id"), F.col("l_quantity").cast("double").alias("value"))
    return ledgers.check_calculations(claims, inputs).select("calculation_id", "verdict")


@_register("claim_verdicts", """SELECT o_orderkey AS claim_id, coalesce(n, 0) AS n_evidence, CASE WHEN n IS NULL THEN 'NO_EVIDENCE' WHEN bad > 0 THEN 'INELIGIBLE' WHEN late > 0 THEN 'AFTER_CUTOFF' ELSE 'VERIFIED' END AS verdict
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad, count(*) FILTER (CAST(l_shipdate AS DATE) > DATE '1996-06-30') AS late FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    claims = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    evidence = _table(spark, sf_dir, "lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_returnflag") != "R").alias("eligible"), F.to_date("l_shipdate").alias("available_on"))
    return ledgers.verify_claims(claims, evidence, F.to_date(F.lit("1996-06-30")))


def _hashed(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.col("item_id").alias("doc_id"), F.sha2("text", 256).alias("content_hash"))


@_register("promote_hits", """WITH b AS (SELECT item_id, sha256(text) AS h FROM benchmark)
SELECT 'E:' || item_id || ':' || item_id || ':' || substr(h, 1, 16) AS evidence_id, item_id AS rank FROM b WHERE item_id % 5 <> 0 AND substr(h, 1, 1) < 'c'""")
def _(spark, sf_dir):
    chunks = _hashed(spark, sf_dir)
    hits = chunks.select("chunk_id", F.when(F.col("chunk_id") % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.col("chunk_id").alias("rank"))
    return ledgers.promote_hits(hits, chunks, chunks.where("substring(content_hash, 1, 1) < 'c'")).select("evidence_id", "rank")


@_register("authority_rules", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic IS NOT NULL) AND lang = 'en' UNION SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic IS NOT NULL) AND lang = 'de'")
def _(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    bindings = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "issuer").otherwise("manager").alias("role"))
    chunks = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("publisher"))
    return ledgers.authorised(chunks, bindings, labels.where("toxic is not null"), [("issuer", "en"), ("manager", "de")]).select("doc_id")


@_register("carry_forward", "SELECT CAST(d AS VARCHAR) AS changed, count(*) AS n_old, count(*) + CASE WHEN d = 2 THEN 1 ELSE 0 END AS n_new, d = 0 AS same FROM customer, (VALUES (0), (1), (2)) v(d) GROUP BY d")
def _(spark, sf_dir):
    # carried as it is; with one cell changed; with one row twice
    from functools import reduce

    old = _table(spark, sf_dir, "customer").withColumn("dataset_version", F.lit("v1"))
    new = ledgers.carry_forward(old, "v1", "v2")
    first = F.col("c_custkey") == old.agg(F.min("c_custkey")).first()[0]
    cases = [new, new.withColumn("c_name", F.when(first, "other").otherwise(F.col("c_name"))), new.unionByName(new.where(first))]
    return reduce(lambda a, b: a.unionByName(b), [ledgers.compare_versions(old.unionByName(x), "v1", "v2").withColumn("changed", F.lit(str(i))) for i, x in enumerate(cases)])


@_register("known_weight_relations", "SELECT o_orderkey AS relation_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(CASE WHEN l_quantity < 20 THEN 1 ELSE 0 END) = 0 OR max(CASE WHEN l_quantity < 20 AND l_quantity * 5.5 > 100 THEN 1 ELSE 0 END) = 1)")
def _(spark, sf_dir):
    weights = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), F.when(F.col("l_quantity") < 20, F.col("l_quantity") * 5.5).alias("weight"))
    return dataflow.known_weight_relations(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id")), weights)


@_register("listing_end", "SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 1, 3)")
def _(spark, sf_dir):
    k = F.col("c_custkey") % 4
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "").when(k == 1, "20261232").when(k == 2, "20260101").otherwise("20260701").alias("end"))
    return dataflow.not_ended(c, "end", F.to_date(F.lit("2026-07-01"))).select("c_custkey")


@_register("recall_at_k", """WITH h AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'keyword' ELSE 'vector' END AS mode, label AS case_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY vec_id % 2, label ORDER BY vec_id) AS rank FROM embeddings),
g AS (SELECT label AS case_id, vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 = 0)
SELECT mode, (SELECT count(*) FROM g) AS n_gold, count(g.chunk_id) AS found, round(count(g.chunk_id) / (SELECT count(*) FROM g), 6) AS recall FROM h LEFT JOIN g ON g.case_id = h.case_id AND g.chunk_id = h.chunk_id AND rank <= 10 GROUP BY mode""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    e = _table(spark, sf_dir, "embeddings")
    hits = e.select(F.when(F.col("vec_id") % 2 == 0, "keyword").otherwise("vector").alias("mode"), F.col("label").alias("case_id"), F.col("vec_id").alias("chunk_id"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("mode", "case_id").orderBy("chunk_id")))
    found = retrieval.quality_at_k(ranked, e.where("vec_id % 3 = 0").select(F.col("label").alias("case_id"), F.col("vec_id").alias("chunk_id")), 10)
    return found.select("mode", "n_gold", "found", F.round("recall", 6).alias("recall"))


@_register("embedding_reconciliation", """WITH c AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0), e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label, embedding FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 11 = 0)
SELECT (SELECT count(*) FROM c WHERE vec_id NOT IN (SELECT vec_id FROM e)) AS missing, (SELECT count(*) FROM e WHERE vec_id NOT IN (SELECT vec_id FROM c)) AS orphan, (SELECT count(*) FROM e JOIN c USING (vec_id) WHERE e.label <> c.label) AS stale, (SELECT count(*) - count(DISTINCT vec_id) FROM e) AS duplicate, (SELECT count(*) FROM e WHERE len(embedding) <> 64) AS wrong_dimension""")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("content_hash"), "embedding")
    stored = e.where("chunk_id % 3 != 0").withColumn("content_hash", F.when(F.col("chunk_id") % 7 == 0, "-1").otherwise(F.col("content_hash"))).unionByName(e.where("chunk_id % 11 = 0"))
    return retrieval.reconcile_embeddings(e.where("chunk_id % 5 != 0").select("chunk_id", "content_hash"), stored, 64)
