"""Registered queries of feeds, integrity rules, graph projection, claims and documents; importing this adds them to the catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .catalog_queries import _LEDGER, _register, _table
from .functions import text as T
from .operators import claims as C
from .operators import graph, integrity, retrieval
from .plans.compile import compile_plan
from .plans.model import Lookup, Scope
from .plans.registry import DEFAULT
from .sources import feeds
from .sources import ledger as L

_WITH = f"WITH {_LEDGER} "


@_register("feed_daily_market", "SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, DATE '2026-08-21' AS day, CAST(p_size AS DOUBLE) + 0.5 AS close, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS DOUBLE) END AS nav FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(
        F.lit("20260821").alias("BAS_DD"), F.lpad(k.cast("string"), 6, "0").alias("ISU_CD"), F.col("p_name").alias("ISU_NM"), F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("TDD_CLSPRC"), F.when(k % 3 == 0, "-").otherwise(k.cast("string")).alias("NAV"))
    return feeds.daily_market(rows).select("code", "day", F.col("close").cast("double").alias("close"), F.col("nav").cast("double").alias("nav"))


@_register("feed_exchange_rates", "SELECT 'I' || (n_nationkey % 5) AS item_code, DATE '2024-01-01' + CAST(n_nationkey // 5 AS INTEGER) AS day, CAST(n_nationkey AS DOUBLE) + 1.25 AS rate FROM nation WHERE n_nationkey % 5 < 3")
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    day = F.date_format(F.date_add(F.lit(dt.date(2024, 1, 1)), F.floor(k / 5).cast("int")), "yyyyMMdd")
    rows = _table(spark, sf_dir, "nation").select(
        F.lit("731Y001").alias("STAT_CODE"), F.concat(F.lit("I"), (k % 5).cast("string")).alias("ITEM_CODE1"), F.concat(F.lit("won per "), (k % 5).cast("string")).alias("ITEM_NAME1"), F.lit("원").alias("UNIT_NAME"), day.alias("TIME"),
        F.when(k % 5 < 3, F.concat((k + 1).cast("string"), F.lit(".25"))).otherwise("none of ours").alias("DATA_VALUE"))
    return feeds.exchange_rates(rows, {f"I{i}": f"won per {i}" for i in range(3)}).withColumn("rate", F.col("rate").cast("double"))


@_register("feed_holder_weights", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'WEIGHTS_INCOMPLETE' WHEN 2 THEN 'WEIGHTS_SECURITY' WHEN 3 THEN 'WEIGHTS_VALUE' WHEN 4 THEN 'WEIGHTS_RESPONSE' ELSE NULL END AS code,
CASE WHEN p_partkey % 6 IN (0, 5) THEN p_size + 0.5 END AS weight_pct, CASE WHEN p_partkey % 6 IN (0, 5) THEN 1 END AS place FROM part""")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 6
    weight = F.when(k == 3, "101").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    name = F.when(k == 2, "another").otherwise("One")
    body = F.format_string('{"pdf": {"gijunYMD": "%s", "totalCnt": %d, "list": [{"itmNo": "000001", "secNm": "x", "ratio": "1"}, {"itmNo": "005930", "secNm": "%s", "ratio": "%s"}]}}', F.when(k == 4, "20260820").otherwise("20260821"), F.when(k == 1, 3).otherwise(2), name, weight)
    form = feeds.weight_formats(dt.date(2026, 8, 21), "005930", "KR7005930003", "One", "F", "G")["samsung"]
    found = feeds.holder_weight(_table(spark, sf_dir, "part").select("p_partkey", body.alias("body")), form, key="p_partkey")
    return found.select("p_partkey", "code", F.col("weight_pct").cast("double").alias("weight_pct"), "place")


@_register("subtype_mismatches", "SELECT 'C' || c_custkey AS entity_id, 'security' AS subtype, CASE WHEN c_custkey % 7 = 0 THEN 'product' END AS entity_type FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("C"), k.cast("string")).alias("entity_id"))
    entities = c.where("k % 11 != 0 or k % 7 = 0").select("entity_id", F.when(F.col("k") % 7 == 0, "product").otherwise("security").alias("entity_type"))
    return integrity.subtype_mismatches(entities, {"security": c, "product": c.where("k % 7 = 0")})


@_register("subtype_chain", "SELECT o_orderkey AS entity_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS product_family, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS security_issuer FROM orders")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "entity_id")
    return integrity.hydrate_subtypes(o.select("entity_id"), {"product": o.where("o_orderstatus = 'F'").select("entity_id", F.col("o_orderpriority").alias("family")), "security": o.where("o_orderstatus = 'O'").select("entity_id", F.col("o_custkey").alias("issuer"))})


@_register("value_kind_mismatches", _WITH + "SELECT 'O:part.brand:' || k AS observation_id, 'text' AS stored_kind, 'numeric' AS value_kind FROM prod UNION ALL SELECT 'O:part.size:' || k, 'numeric', NULL FROM prod")
def _(spark, sf_dir):
    known = {"part.retail_price": "numeric", "part.promo_size": "numeric", "part.brand": "numeric", "part.grade": "text", "part.maturity": "date", "part.remaining_days": "numeric"}
    definitions = spark.createDataFrame([(m, "1", k) for m, k in known.items()], "metric_id string, metric_definition_version string, value_kind string")
    return integrity.value_kind_mismatches(L.star(spark, sf_dir).observations, definitions)


@_register("foreign_publishers", "SELECT s_suppkey AS source_id FROM supplier WHERE s_nationkey % 3 = 0")
def _(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"), F.when(F.col("n_nationkey") % 3 == 0, "product").otherwise("institution").alias("entity_type"))
    return integrity.foreign_publishers(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("publisher")), n)


@_register("dimension_mismatches", "SELECT vec_id AS embedding_id FROM embeddings WHERE vec_id % 7 = 0 OR label % 2 = 1")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("embedding_id"), F.when(F.col("vec_id") % 7 == 0, 63).otherwise(64).alias("dimension"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model_id"), F.lit("1").alias("model_version"), "embedding")
    return integrity.dimension_mismatches(e, spark.createDataFrame([("m0", "1", 64), ("m1", "1", 32)], "model_id string, model_version string, dimension int"))


@_register("three_key_sets", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'fund,registrant' WHEN o_orderkey % 3 = 0 THEN 'registrant' ELSE 'fund' END AS missing_in FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return integrity.unequal_keys({"submission": o, "registrant": o.where("k % 3 != 0"), "fund": o.where("k % 2 != 0")}, "k")


@_register("left_join_with_proof", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    proof = c.join(_table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey"))
    return integrity.with_condition(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c.select("o_custkey", "c_name", "c_acctbal"), "o_custkey", F.col("c_acctbal") > 0, proof).select("o_orderkey", "c_name")


@_register("release_audit", "SELECT 'count:documents' AS check, (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents) AS expected, true AS ok UNION ALL SELECT 'count:labels', (SELECT count(*) FROM labels), 1, (SELECT count(*) FROM labels) = 1 UNION ALL SELECT 'orphans:documents.doc_id->labels', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 0, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0")
def _(spark, sf_dir):
    tables = {n: _table(spark, sf_dir, n).select("doc_id") for n in ("documents", "labels")}
    return integrity.release_audit(tables, {"documents": tables["documents"].count(), "labels": 1}, [("documents", "doc_id", "labels")])


@_register("build_acceptance", "WITH t AS (SELECT source, substr(text, 1, 12) AS title, doc_id FROM documents), p AS (SELECT source, title, count(*) AS n FROM t GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS n_documents, count(*) AS n_titles, count(*) FILTER (n > 1) AS n_repeated, (SELECT count(*) FROM t WHERE t.source = p.source AND doc_id IN (SELECT doc_id FROM labels)) AS n_observed FROM p GROUP BY source")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 12).alias("title"))
    return integrity.acceptance(d, "source", "title", _table(spark, sf_dir, "labels"), "doc_id")


_BASE = "urn:x:"


def _graph(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    entities = ledger.products.select("entity_id", F.array(F.lit("Product"), F.concat(F.lit("Family_"), F.col("product_family"))).alias("classes"))
    relations = ledger.relations.where("predicate_id = 'suppliedBy'").select("relation_id", "subject_id", "predicate_id", "object_id", "valid_from", "valid_to")
    return graph.project(entities, relations, ledger.relation_evidence.join(relations.select("relation_id"), "relation_id", "left_semi"), "star", _BASE)


_ENC = "replace({}, ':', '%3A')"
_REL = "'<urn:x:relation/star/' || " + _ENC.format("relation_id") + " || '>'"


@_register("graph_quads", _WITH + f""", q AS (SELECT '<urn:x:entity/' || {_ENC.format('entity_id')} || '>' AS s, '<urn:x:ontology#entityId>' AS p, '"' || entity_id || '"' AS o FROM prod
UNION ALL SELECT '<urn:x:entity/' || {_ENC.format('entity_id')} || '>', '{graph.TYPE}', '<urn:x:ontology#' || c || '>' FROM (SELECT entity_id, unnest(['Product', 'Family_' || fam]) AS c FROM prod)
UNION ALL SELECT '<urn:x:entity/' || {_ENC.format('subject_id')} || '>', '<urn:x:ontology#suppliedBy>', '<urn:x:entity/' || {_ENC.format('object_id')} || '>' FROM edge
UNION ALL SELECT {_REL}, '{graph.TYPE}', '<urn:x:ontology#RelationAssertion>' FROM edge UNION ALL SELECT {_REL}, '<urn:x:ontology#subject>', '<urn:x:entity/' || {_ENC.format('subject_id')} || '>' FROM edge
UNION ALL SELECT {_REL}, '<urn:x:ontology#predicate>', '<urn:x:ontology#suppliedBy>' FROM edge UNION ALL SELECT {_REL}, '<urn:x:ontology#object>', '<urn:x:entity/' || {_ENC.format('object_id')} || '>' FROM edge
UNION ALL SELECT {_REL}, '<urn:x:ontology#relationId>', '"' || relation_id || '"' FROM edge UNION ALL SELECT {_REL}, '<urn:x:ontology#datasetVersion>', '"star"' FROM edge
UNION ALL SELECT {_REL}, '<urn:x:ontology#validFrom>', '"' || valid_from || '"^^<http://www.w3.org/2001/XMLSchema#date>' FROM edge UNION ALL SELECT {_REL}, '<urn:x:ontology#validTo>', '"' || valid_to || '"^^<http://www.w3.org/2001/XMLSchema#date>' FROM edge WHERE valid_to IS NOT NULL)
SELECT p, count(*) AS n, md5(string_agg(s || ' ' || o, chr(10) ORDER BY s, o)) AS content FROM q GROUP BY p""")
def _(spark, sf_dir):
    data, _ = _graph(spark, sf_dir)
    lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "s", "o"))), "\n")
    return data.groupBy("p").agg(F.count("*").alias("n"), F.md5(lines).alias("content"))


@_register("graph_constraints", _WITH + f"""SELECT 'unproven' AS shape, {_REL} AS node FROM edge WHERE CAST(substr(subject_id, 3) AS BIGINT) % 9 = 0 UNION ALL SELECT 'family', '<urn:x:entity/' || {_ENC.format('entity_id')} || '>' FROM prod WHERE fam = 'ECONOMY'
UNION ALL SELECT 'dated', {_REL} FROM edge WHERE valid_to IS NULL UNION ALL SELECT 'object', {_REL} FROM edge""")
def _(spark, sf_dir):
    data, proof = _graph(spark, sf_dir)
    dropped = proof.where("not coalesce(p = '<urn:x:ontology#supportedBy>' and try_cast(regexp_extract(s, 'R%3A([0-9]+)%3A', 1) as long) % 9 = 0, false)")
    term = lambda n: f"<urn:x:ontology#{n}>"
    shapes = [
        graph.Shape("unproven", target_class=term("RelationAssertion"), path=term("supportedBy"), least=1, value_class=term("EvidenceRecord")), graph.Shape("family", target_class=term("Product"), disjoint=term("Family_ECONOMY")),
        graph.Shape("dated", target_class=term("RelationAssertion"), path=term("validTo"), least=1, most=1), graph.Shape("object", target_subjects_of=term("relationId"), path=term("object"), least=1, value_class=term("Supplier")),
        graph.Shape("named", target_class=term("Product"), path=term("entityId"), least=1, most=1, pattern=r'^"P:\d+"$')]
    return graph.violations(graph.store(data.unionByName(dropped), L.shared_folder(spark)), shapes)


@_register("graph_unproven_edges", _WITH + f"SELECT '<urn:x:entity/' || {_ENC.format('subject_id')} || '>' AS s, '<urn:x:entity/' || {_ENC.format('object_id')} || '>' AS o FROM edge WHERE CAST(substr(subject_id, 3) AS BIGINT) % 9 = 0")
def _(spark, sf_dir):
    data, proof = _graph(spark, sf_dir)
    dropped = proof.where("coalesce(try_cast(regexp_extract(s, 'R%3A([0-9]+)%3A', 1) as long) % 9, -1) != 0")
    return graph.unproven_edges(data, dropped, _BASE, ["suppliedBy"]).select("s", "o")


def _shown(spark, sf_dir):
    rows = compile_plan(Lookup(Scope("ECONOMY"), ("price", "promo_size")), L.star(spark, sf_dir), DEFAULT)
    each = [rows.select(F.lit(c).alias("task_id"), "entity_id", F.lit(c).alias("concept"), F.round(F.col(c).cast("double"), 2).cast("string").alias("value"), F.col(f"{c}_evidence_ids").alias("evidence_ids")) for c in ("price", "promo_size")]
    return each[0].unionByName(each[1])


@_register("claims_of_rows", _WITH + """SELECT task_id, entity_id, evidence_ids FROM (SELECT 'price' AS task_id, entity_id, 'E:O:part.retail_price:' || k || ':a' || CASE WHEN k % 7 = 0 THEN ',E:O:part.retail_price:' || k || ':b' ELSE '' END AS evidence_ids, k FROM kept WHERE fam = 'ECONOMY'
UNION ALL SELECT 'promo_size', entity_id, 'E:O:part.promo_size:' || k || ':a' || CASE WHEN k % 7 = 0 THEN ',E:O:part.promo_size:' || k || ':b' ELSE '' END, k FROM kept WHERE fam = 'ECONOMY' AND promo IS NOT NULL) WHERE k % 5 <> 0""")
def _(spark, sf_dir):
    proof = L.star(spark, sf_dir).observation_evidence.where("eligible_for_claim")
    return C.claims_of(_shown(spark, sf_dir), proof).select("task_id", "entity_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@_register("claim_bundle", _WITH + "SELECT 'price' AS task_id, count(*) AS n_claims, 'ANSWERED' AS state FROM kept WHERE fam = 'ECONOMY' AND k % 5 <> 0 UNION ALL SELECT 'nothing', 0, 'NO_RESULT_IN_BOUNDED_SCOPE' UNION ALL SELECT 'unproven', 0, 'NO_EXACT_FIELD_EVIDENCE'")
def _(spark, sf_dir):
    found = C.claims_of(_shown(spark, sf_dir).where("task_id = 'price'"), L.star(spark, sf_dir).observation_evidence.where("eligible_for_claim"))
    return C.bundle(spark.createDataFrame([("price", 9), ("nothing", 0), ("unproven", 4)], "task_id string, n_rows long"), found)


@_register("claim_render", _WITH + "SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS position, product_name || ' — price: ' || printf('%.1f', round(CAST(price AS DOUBLE), 1)) || ' [E:O:part.retail_price:' || k || ':a]' AS line FROM kept WHERE fam = 'ECONOMY' AND k % 5 = 1 AND k % 7 <> 0")
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    rows = _shown(spark, sf_dir).where("concept = 'price'").withColumn("k", F.substring("entity_id", 3, 20).cast("long")).where("k % 5 = 1 and k % 7 != 0")
    rows = rows.join(ledger.observations.where("metric_id = 'part.retail_price'").select("entity_id", F.format_string("%.1f", F.round(F.col("numeric_value").cast("double"), 1)).alias("shown")), "entity_id").withColumn("value", F.col("shown"))
    found = C.claims_of(rows, ledger.observation_evidence.where("eligible_for_claim"))
    order = found.select("claim_id", F.substring("entity_id", 3, 20).cast("long").alias("k"))
    planned = dense(order)
    return C.render(C.gate(planned, found.select("claim_id", F.lit("VERIFIED").alias("verdict")), found), ledger.products.select("entity_id", F.col("product_name").alias("name")))


def dense(order):
    """claim_id and its position from 1: an answer's claims are few, its blocks are laid out in one place."""
    from pyspark.sql import Window

    return order.select("claim_id", F.row_number().over(Window.orderBy("k")).cast("long").alias("position"))


@_register("row_validation", _WITH + """SELECT entity_id, 'price' AS concept, CASE WHEN k % 4 = 1 THEN 'NAME_MISMATCH' WHEN k % 4 = 2 THEN 'VALUE_MISMATCH' WHEN k % 13 = 0 THEN 'FACT_MISSING' ELSE 'EVIDENCE_INELIGIBLE' END AS reason FROM prod
WHERE fam = 'ECONOMY' AND k % 11 <> 0 AND (k % 13 = 0 OR k % 4 IN (1, 2) OR k % 5 = 0)""".replace("CASE WHEN k % 4 = 1", "CASE WHEN k % 13 = 0 THEN 'FACT_MISSING' WHEN k % 4 = 1"))
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    k = F.substring("entity_id", 3, 20).cast("long")
    price = ledger.observations.where("metric_id = 'part.retail_price' and evidence_ids is not null").join(L.sorted_by_key(ledger.products).where("product_family = 'ECONOMY'"), "entity_id")
    value = F.col("numeric_value").cast("string")
    rows = price.select("entity_id", F.when(k % 4 == 1, "other").otherwise(F.col("product_name")).alias("product_name"), F.lit("price").alias("concept"), F.when(k % 4 == 2, "0").otherwise(value).alias("value"))
    facts = price.where(k % 13 != 0).select("entity_id", F.col("product_name").alias("canonical_name"), F.lit("price").alias("concept"), value.alias("value"), F.explode("evidence_ids").alias("evidence_id"), F.when(F.col("proven"), "eligible").otherwise("late").alias("cutoff_status"), "applicable_date")
    return integrity.row_violations(rows, facts, F.lit(dt.date(1998, 8, 2)))


@_register("embed_missing", "SELECT chunk_id, content_hash, first FROM (SELECT doc_id AS chunk_id, sha256(text) AS content_hash, CAST(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE length(text) END AS DOUBLE) AS first FROM documents UNION ALL SELECT doc_id, 'old', -1 FROM documents WHERE doc_id % 3 = 1)")
def _(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.sha2("text", 256).alias("content_hash"))
    there = chunks.where("chunk_id % 3 != 2").select("chunk_id", F.when(F.col("chunk_id") % 3 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.array(F.lit(-1.0), F.lit(0.0)).alias("embedding"))
    out = retrieval.embed_missing(chunks, there, lambda texts: [[len(t), 1.0] for t in texts], 2)
    return out.select("chunk_id", "content_hash", F.col("embedding")[0].cast("double").alias("first"))


@_register("applicable_dates", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN DATE '2026-08-21' WHEN 1 THEN DATE '2026-01-31' WHEN 2 THEN NULL ELSE DATE '2026-01-31' END AS day FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey") % 4
    p = _table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, " 20260821").when(k == 1, "00000000").when(k == 2, "99991231").otherwise("2026083x").alias("a"), F.when(k != 2, "20260131").alias("b"))
    return p.select("p_partkey", T.applicable_date(F.col("a"), F.col("b")).alias("day"))


@_register("cutoff_in_two_zones", "SELECT event_id, CASE WHEN CAST(ts AS DATE) <= c THEN 'eligible' ELSE 'late' END AS evidence, CASE WHEN CAST(ts + INTERVAL 9 HOUR AS DATE) <= c THEN 'eligible' ELSE 'late' END AS document FROM events, (SELECT CAST(min(ts) AS DATE) + 5 AS c FROM events)")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "ts")
    cut = e.agg(F.date_add(F.to_date(F.min("ts")), 5).alias("c"))
    both = e.crossJoin(F.broadcast(cut))  # one row
    return both.select("event_id", T.cutoff_status(F.col("ts"), F.col("c")).alias("evidence"), T.cutoff_status(F.col("ts"), F.col("c"), "Asia/Seoul").alias("document"))


@_register("claims_verified", """SELECT o_orderkey AS claim_id, CASE WHEN n IS NULL THEN 'NO_EVIDENCE' WHEN bad > 0 THEN 'INELIGIBLE' WHEN late > 0 THEN 'AFTER_CUTOFF' WHEN o_orderkey % 7 = 0 THEN 'CALCULATION_MISMATCH' WHEN o_orderkey % 2 = 0 AND c_mktsegment <> 'BUILDING' THEN 'CLASS_NOT_ALLOWED'
WHEN o_orderkey % 5 = 0 AND c_acctbal < 0 THEN 'NOT_COVERED' ELSE 'VERIFIED' END AS verdict FROM orders JOIN customer ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad, count(*) FILTER (CAST(l_shipdate + INTERVAL 9 HOUR AS DATE) > DATE '1997-06-30') AS late FROM lineitem WHERE l_quantity > 20 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    claims = o.select(k.alias("claim_id"), F.col("o_custkey").cast("string").alias("entity_id"), F.when(k % 2 == 0, "weight").otherwise("price").alias("concept"), (k % 5 == 0).alias("absence"))
    evidence = _table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_returnflag") != "R").alias("eligible"), F.col("l_shipdate").alias("published_at"))
    calculations = o.select(k.alias("claim_id"), F.when(k % 7 == 0, "MISMATCH").otherwise("MATCH").alias("verdict"))
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_mktsegment").alias("class"), "c_acctbal")
    coverage = c.where("c_acctbal >= 0").select("entity_id", F.explode(F.array(F.lit("price"), F.lit("weight"))).alias("concept"))
    return C.verify(claims, evidence, F.lit(dt.date(1997, 6, 30)), calculations, coverage, c.select("entity_id", "class"), {"weight": "BUILDING"})
