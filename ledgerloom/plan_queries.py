"""Registered queries of scopes, aggregates with their lineage, results, literals and fixed plans; importing this adds them to the catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .catalog_queries import _F, _LEDGER, CUTOFF, _number, _register, _table
from .functions import literals as Lit
from .operators import fixed, retrieval
from .plans.compile import compile_plan, lineage_rows
from .plans.model import Aggregate, Atom, Lookup, Qualifiers, Scope, Screen
from .plans.registry import DEFAULT, Member, Registry
from .plans.results import exclusions, once, refuse_duplicates, with_status
from .sources import ledger as L

_FAMILY = "ECONOMY"
_SCOPE = Scope(_FAMILY)
_WITH = f"WITH {_LEDGER} "
_OF = f"FROM kept WHERE fam = '{_FAMILY}'"
_VARIANT = "variant AS (SELECT 'P:' || p_partkey AS s, 'P:' || (p_partkey - p_partkey % 6) AS o, CASE WHEN p_partkey % 4 = 0 THEN DATE '1995-12-31' END AS until FROM part WHERE p_partkey % 6 IN (1, 2) AND p_partkey - p_partkey % 6 > 0)"


def _joined(df, *arrays):
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if c in arrays else F.col(c) for c in df.columns])


_COMPANIONS = ("metric_ids", "metric_definition_versions", "units", "currencies", "applicable_dates")


@_register("agg_companions", _WITH + f"SELECT {_F.format('size', 'size')}, round(CAST(sum(price) AS DOUBLE), 4) AS value, count(*) AS n_observations, 'part.retail_price' AS metric_ids, '1' AS metric_definition_versions, 'amount' AS units, 'USD' AS currencies, '1998-08-02' AS applicable_dates FROM prod WHERE fam = '{_FAMILY}' GROUP BY prod.size HAVING count(*) FILTER (k % 11 <> 0) > 0")
def _(spark, sf_dir):
    rows = compile_plan(Aggregate(_SCOPE, "sum", "price", ("size",)), L.star(spark, sf_dir), DEFAULT)
    return _number(_joined(rows, *_COMPANIONS).select("size", "value", "n_observations", *_COMPANIONS)).withColumn("value", F.round("value", 4))


@_register("agg_lineage_rows", _WITH + f"SELECT brand, entity_id, 'O:part.retail_price:' || k AS observation_id, 'part.retail_price' AS metric_id, 'E:O:part.retail_price:' || k || ':' || c AS evidence_id {_OF.replace('FROM kept', 'FROM kept, (VALUES (chr(97)), (chr(98))) v(c)')} AND (c = 'a' OR k % 7 = 0) AND size >= 5")
def _(spark, sf_dir):
    plan = Aggregate(_SCOPE, "sum", "price", ("brand",), Atom("size", "gte", (5,)))
    return lineage_rows(plan, L.star(spark, sf_dir), DEFAULT)


@_register("count_lineage_rows", _WITH + f"SELECT entity_id, 'O:part.size:' || k AS observation_id, 'part.size' AS metric_id, 'E:O:part.size:' || k || ':' || c AS evidence_id {_OF.replace('FROM kept', 'FROM kept, (VALUES (chr(97)), (chr(98))) v(c)')} AND (c = 'a' OR k % 7 = 0) AND promo > 0")
def _(spark, sf_dir):
    return lineage_rows(Aggregate(_SCOPE, "count", predicate=Atom("promo_size", "gt", (0,))), L.star(spark, sf_dir), DEFAULT, concepts=("size",))


def _representative(name: str, plan, value: str, condition: str) -> None:
    @_register(name, _WITH + f", {_VARIANT}, pop AS (SELECT DISTINCT coalesce(o, entity_id) AS entity_id FROM prod LEFT JOIN variant ON s = entity_id AND {condition} WHERE fam = '{_FAMILY}') SELECT {value} FROM pop JOIN prod USING (entity_id)")
    def _(spark, sf_dir):
        rows = compile_plan(plan, L.star(spark, sf_dir), DEFAULT)
        return _number(rows.select("value", *(["n_entities"] if "n_entities" in rows.columns else []))).withColumn("value", F.round(F.col("value").cast("double"), 4))


_representative("representative_sum_asof", Aggregate(_SCOPE, "sum", "price", qualifiers=Qualifiers(as_of=CUTOFF), representative="variantOf"), "round(CAST(sum(price) AS DOUBLE), 4) AS value, count(*) AS n_entities", "(until IS NULL OR until >= DATE '1998-08-02')")
_representative("representative_max_open", Aggregate(_SCOPE, "max", "price", representative="variantOf"), "round(CAST(max(price) AS DOUBLE), 4) AS value, count(*) AS n_entities", "until IS NULL")
_representative("representative_count", Aggregate(_SCOPE, "count", representative="variantOf"), "CAST(count(*) AS DOUBLE) AS value", "until IS NULL")

_STRICT = Registry(tuple(DEFAULT._by.values()), (Member(_FAMILY, "part.grade", "AA0"),))  # noqa: SLF001


@_register("screen_proven_members", _WITH + f"SELECT entity_id, product_name, {_F.format('price', 'price')} {_OF} AND k % 6 = 2 AND k % 5 <> 0 AND price > 920")
def _(spark, sf_dir):
    rows = compile_plan(Screen(_SCOPE, ("price",), Atom("price", "gt", (920,))), L.star(spark, sf_dir), _STRICT)
    return _number(rows.select("entity_id", "product_name", "price"))


@_register("credit_threshold", _WITH + f"SELECT entity_id, ['AAA', 'AA+', 'AA0', 'AA-', 'A+', 'BBB'][k % 6 + 1] AS grade {_OF} AND k % 6 < 4")
def _(spark, sf_dir):
    rows = compile_plan(Screen(_SCOPE, ("grade",), Lit.credit_at_least("grade", "AA-")), L.star(spark, sf_dir), DEFAULT)
    return rows.select("entity_id", "grade")


@_register("bond_saleable", _WITH + f"SELECT entity_id, DATE '1998-01-01' + CAST(k % 400 AS INTEGER) AS maturity {_OF} AND DATE '1998-01-01' + CAST(k % 400 AS INTEGER) > DATE '1998-08-02' AND k % 5 - 1 > 0")
def _(spark, sf_dir):
    rows = compile_plan(Screen(_SCOPE, ("maturity",), Lit.saleable(CUTOFF)), L.star(spark, sf_dir), DEFAULT)
    return rows.select("entity_id", "maturity")


@_register("result_exclusions", _WITH + f"SELECT entity_id AS subject_id, 'promo_size' AS concept, 'exclude_missing.v1' AS rule_id, 'not_offered' AS reason_code, 'MISSING_VALUE_EXCLUDED' AS warning {_OF} AND promo IS NULL")
def _(spark, sf_dir):
    rows = compile_plan(Lookup(_SCOPE, ("price", "promo_size")), L.star(spark, sf_dir), DEFAULT)
    return exclusions(refuse_duplicates(rows, ["entity_id"]), ("price", "promo_size"))


@_register("status_and_rows", "SELECT 'READY' AS kind, count(*) AS n, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'ROW', NULL, s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(spark, sf_dir):
    return with_status(_table(spark, sf_dir, "supplier").where("s_acctbal > 0"), ["s_suppkey", "s_name"])


_SIX = ["l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount"]


@_register("once_per_six_keys", f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(_SIX)}) AS n FROM lineitem) WHERE n = 1")
def _(spark, sf_dir):
    return once(_table(spark, sf_dir, "lineitem").select("l_orderkey", *_SIX), _SIX).select("l_orderkey", "l_linenumber", "l_partkey")


# requests, written from a part's key so that SQL knows what they say
def _requests(spark, sf_dir):
    k = F.col("p_partkey")
    grouped = F.format_number(k * 1000 + 500, 0)
    cue = F.element_at(F.array(*[F.lit(x) for x in ("이하", "미만이 아닌", "이상", "초과가 아닌", "사이", "제외")]), (k % 6 + 1).cast("int"))
    words = F.element_at(F.array(*[F.lit(x) for x in Lit.NATIVE]), (k % 14 + 1).cast("int"))
    grade = F.element_at(F.array(*[F.lit(x) for x in ("AAA", "AA+", "AA", "AA-")]), (k % 4 + 1).cast("int"))
    text = F.concat(
        F.lit("보수 "), k.cast("string"), F.lit(".50%와 "), grouped, F.lit("만원 "), cue, F.lit(", "), k.cast("string"), F.lit("원, 2024-02-"), F.lpad((k % 31 + 1).cast("string"), 2, "0"), F.lit(" 기준, 2023년 "),
        (k % 12 + 1).cast("string"), F.lit("월 5일부터, 최근 "), (k % 9 + 1).cast("string"), F.lit("년 "), (k % 11 + 1).cast("string"), F.lit("개월 "), (k % 50).cast("string"), F.lit("위 안의 "), grade, F.lit(" 등급 "), words, F.lit(" 종목"))
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))


@_register("request_literals", """SELECT p_partkey, CAST((p_partkey * 1000 + 500) * 10000 AS VARCHAR) || ',' || p_partkey AS amounts, p_partkey || '.5' AS percentages,
CASE WHEN p_partkey % 31 + 1 <= 29 THEN '2024-02-' || lpad(CAST(p_partkey % 31 + 1 AS VARCHAR), 2, '0') || ',' ELSE '' END || '2023-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS days,
'P' || (p_partkey % 9 + 1) || 'Y,P' || (p_partkey % 11 + 1) || 'M' AS periods, CAST(p_partkey % 50 AS VARCHAR) AS ranks, CAST([1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9, 10][p_partkey % 14 + 1] AS VARCHAR) AS limits,
['lte', 'gte', 'gte', 'lte', 'between', 'not_in'][p_partkey % 6 + 1] AS operator, ['AAA', 'AA+', 'AA0', 'AA-'][p_partkey % 4 + 1] AS grade FROM part""")
def _(spark, sf_dir):
    t = F.col("t")
    listed = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _requests(spark, sf_dir).select(
        "p_partkey", F.array_join(F.transform(Lit.amounts(t), lambda x: x.cast("decimal(38,0)").cast("string")), ",").alias("amounts"), listed(Lit.percentages(t)).alias("percentages"), listed(Lit.days(t)).alias("days"), listed(Lit.periods(t)).alias("periods"),
        listed(Lit.ranks(t)).alias("ranks"), listed(Lit.limits(t)).alias("limits"), Lit.comparison(F.regexp_extract(t, "만원 ([^,]*),", 1)).alias("operator"), Lit.credit_grade(t).alias("grade"))


_TAGGED = """CASE p_partkey % 12 WHEN 0 THEN '{"type":"string","value":"' || p_name || '"}' WHEN 1 THEN '{"type":"integer","value":' || p_partkey || '}' WHEN 2 THEN '{"type":"integer","value":"7"}' WHEN 3 THEN '{"type":"decimal","value":"1.50"}'
WHEN 4 THEN '{"type":"decimal","value":"-0.25"}' WHEN 5 THEN '{"type":"date","value":"2024-02-30"}' WHEN 6 THEN '{"type":"date","value":"2024-02-29"}' WHEN 7 THEN '{"type":"null","value":null}' WHEN 8 THEN '{"type":"boolean","value":true}'
WHEN 9 THEN '{"type":"tuple","items":[{"type":"integer","value":1},{"type":"string","value":"x"}]}' WHEN 10 THEN '{"type":"tuple","items":[{"type":"tuple","items":[]}]}' ELSE '{"type":"string","value":"x","more":1}' END"""


@_register("tagged_values", "SELECT p_partkey, p_partkey % 12 IN (0, 1, 4, 6, 7, 8, 9) AS valid FROM part")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", Lit.valid_tagged(F.expr(_TAGGED)).alias("valid"))


@_register("iri_encoding", "SELECT p_partkey, 'urn:x/' || url_encode(p_name || ' & ~*/é') || '/' || url_encode(p_brand) AS iri FROM part")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", Lit.iri("urn:x/", F.concat("p_name", F.lit(" & ~*/é")), F.col("p_brand")).alias("iri"))


# fixed plans and examples


@_register("rank_return", f"SELECT entity_id, product_name, 'O:part.promo_size:' || k AS observation_id, {_F.format('promo', 'numeric_value')}, count(*) OVER () AS matched_products FROM prod WHERE product_name ILIKE '%PART%' AND promo IS NOT NULL ORDER BY promo DESC, entity_id LIMIT 5".replace("SELECT", _WITH + "SELECT", 1))
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    found = fixed.rank_return(ledger.products, ledger.observations.where("metric_id = 'part.promo_size'"), "PART", F.lit(CUTOFF), 5)
    return _number(found.select("entity_id", "product_name", "observation_id", "numeric_value", "matched_products"))


@_register("holding_weight", """WITH h AS (SELECT l_partkey, l_suppkey, CASE WHEN (l_partkey + l_suppkey) % 4 <> 0 THEN round(sum(l_quantity), 4) END AS weight FROM lineitem GROUP BY 1, 2),
m AS (SELECT 'P:' || l_partkey AS subject_id, p_name AS product_name, s_name AS holding_name, weight FROM h JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE replace(s_name, ' ', '') = 'Supplier#000000003')
SELECT subject_id, holding_name, weight, count(*) OVER () AS matched_products, count(weight) OVER () AS products_with_known_weight, count(*) OVER () = count(weight) OVER () AS ranked FROM m ORDER BY weight DESC NULLS LAST, product_name, subject_id LIMIT 5""")
def _(spark, sf_dir):
    keyword = "Supplier #000000003"
    # weights are summed for holdings of that name only: other pairs of part and supplier are nearly as many as lineitem has rows
    asked = fixed.called(_table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "holding_name"), keyword).select(F.col("s_suppkey").alias("l_suppkey"))
    w = _table(spark, sf_dir, "lineitem").join(asked, "l_suppkey", "left_semi").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 4).alias("w"))
    of = lambda letter, c: F.concat(F.lit(f"{letter}:"), F.col(c).cast("string"))
    holdings = w.select(of("P", "l_partkey").alias("subject_id"), of("S", "l_suppkey").alias("object_id"), F.when((F.col("l_partkey") + F.col("l_suppkey")) % 4 != 0, F.col("w")).alias("weight"))
    names = _table(spark, sf_dir, "supplier").select(of("S", "s_suppkey").alias("object_id"), F.col("s_name").alias("holding_name"))
    found = fixed.holding_weight(L.star(spark, sf_dir).products, holdings, names, keyword, 5)
    return found.select("subject_id", "holding_name", "weight", "matched_products", "products_with_known_weight", "ranked")


_LINES = "ln AS (SELECT doc_id, unnest(range(len(s))) AS ordinal, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), sec AS (SELECT *, ['risk', 'strategy', 'fee'][(doc_id + ordinal) % 3 + 1] AS section_type FROM ln)"


def _sections(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    kind = F.element_at(F.array(F.lit("risk"), F.lit("strategy"), F.lit("fee")), ((F.col("doc_id") + F.col("ordinal")) % 3 + 1).cast("int"))
    return d.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "text", kind.alias("section_type"), (F.col("doc_id") * 100000 + F.col("ordinal")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


@_register("document_risk", f"""WITH {_LINES}, hits AS (SELECT *, DATE '1998-01-01' + CAST(doc_id % 300 AS INTEGER) AS published_on, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k FROM sec WHERE section_type = 'risk' AND doc_id % 4 <> 0 AND strpos(text, 'the') > 0 AND doc_id % 300 <= 213)
SELECT doc_id, ordinal, published_on, substr(text, greatest(1, strpos(text, 'the') - 180), 1280) AS excerpt, count(*) OVER () AS matched_documents FROM hits WHERE k = 1 ORDER BY published_on DESC, doc_id LIMIT 3""")
def _(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4 != 0).alias("cutoff_eligible"), F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("doc_id") % 300).cast("int")).alias("published_on"))
    found = fixed.document_risk(_sections(spark, sf_dir), documents, "the", F.lit(CUTOFF), 3)
    return found.select("doc_id", "ordinal", "published_on", "excerpt", "matched_documents")


@_register("canonical_sections", f"""WITH {_LINES}, own AS (SELECT *, length(text) < 200 AS concise FROM sec WHERE section_type IN ('risk', 'fee')), best AS (SELECT *, max(concise) OVER (PARTITION BY doc_id, section_type) AS b FROM own),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256(text) ORDER BY section_type, ordinal) AS k FROM best WHERE concise = b) SELECT doc_id, section_type, ordinal FROM kept WHERE k = 1""")
def _(spark, sf_dir):
    return fixed.canonical_sections(_sections(spark, sf_dir), F.length("text") < 200, ("risk", "fee"))


@_register("missing_sections", f"WITH {_LINES} SELECT doc_id, w AS section_type FROM documents, (VALUES ('risk'), ('strategy'), ('fee')) v(w) WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = documents.doc_id AND section_type = w)")
def _(spark, sf_dir):
    return fixed.missing_sections(_table(spark, sf_dir, "documents"), _sections(spark, sf_dir), ("risk", "strategy", "fee"))


@_register("example_names", _WITH + "SELECT fam AS product_family, entity_id, product_name FROM prod WHERE product_name ILIKE '%ART 00%' OR product_name ILIKE '%1%' ORDER BY product_name, entity_id LIMIT 10")
def _(spark, sf_dir):
    p = L.star(spark, sf_dir).products
    both = fixed.name_contains(p, "product_name", "art 00").unionByName(fixed.name_contains(p, "product_name", "1")).distinct()
    return both.select("product_family", "entity_id", "product_name").orderBy("product_name", "entity_id").limit(10)


@_register("example_holdings", _WITH + "SELECT fam AS product_family, product_name, entity_id, count(*) AS holdings FROM edge JOIN prod ON subject_id = entity_id GROUP BY ALL ORDER BY 1, 2, 3 LIMIT 15")
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    return fixed.holdings_per_product(ledger.products, ledger.relations, "suppliedBy").select("product_family", "product_name", "entity_id", "holdings")


@_register("example_observed", _WITH + f"SELECT entity_id, 'part.brand' AS metric_id, 'E:O:part.brand:' || k || ':' || c AS evidence_id, 'part-' || c AS source_id FROM kept, (VALUES ('a'), ('b')) v(c) WHERE (c = 'a' OR k % 7 = 0) AND product_name ILIKE '%1%' ORDER BY entity_id, evidence_id LIMIT 10")
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    found = fixed.observed_with_locators(ledger.products, ledger.observations.where("metric_id = 'part.brand'").drop("evidence_ids", "source_ids"), ledger.observation_evidence, "1")
    return found.select("entity_id", "metric_id", "evidence_id", "source_id")


@_register("example_nearest", "WITH a AS (SELECT vec_id AS anchor_id, embedding AS anchor FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), 6) AS distance FROM embeddings, a WHERE vec_id <> anchor_id ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST(anchor AS DOUBLE[])), vec_id LIMIT 5")
def _(spark, sf_dir):
    return fixed.nearest_to_stored(_table(spark, sf_dir, "embeddings")).select("vec_id", F.round("distance", 6).alias("distance"))


@_register("ledger_scan", "SELECT 'part.size' AS metric_id, count(*) AS n, round(sum(p_size), 4) AS total FROM part")
def _(spark, sf_dir):
    o = L.star(spark, sf_dir).observations.where("metric_id = 'part.size'")
    return o.groupBy("metric_id").agg(F.count("*").alias("n"), F.round(F.sum("numeric_value").cast("double"), 4).alias("total"))


@_register("unnest_semi_join", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'O' END FROM customer)")
def _(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") < 0, "F").otherwise("O").alias("o_orderstatus"))
    return _table(spark, sf_dir, "orders").join(wanted, ["o_custkey", "o_orderstatus"], "left_semi").select("o_orderkey")


@_register("eligible_documents", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 200 <= 100 AND doc_id % 7 <> 0")
def _(spark, sf_dir):
    k = F.col("doc_id")
    at = F.to_timestamp(F.lit("1998-06-01 20:00:00"))  # the next morning in Seoul
    d = _table(spark, sf_dir, "documents").select("doc_id", at.alias("published_at"), F.when(k % 3 == 0, at + F.expr("INTERVAL 1 DAY")).otherwise(at).alias("available_at"), F.date_add(F.lit(dt.date(1998, 2, 22)), (k % 200).cast("int")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.when(k % 7 == 0, "  ").otherwise("v1").alias("document_version"))
    return retrieval.eligible(d, "1998-06-02").select("doc_id")


@_register("canonical_document", "SELECT o_orderkey AS document_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CAST(o_orderdate AS DATE) DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "summary").otherwise("full").alias("kind"), F.to_date("o_orderdate").alias("effective_from"), F.col("o_totalprice").alias("published_at"))
    return retrieval.canonical_document(o).select("document_id")


@_register("parsed_values", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN NULL ELSE p_partkey / 4.0 END AS value, p_partkey % 5 = 1 AS bad FROM part")
def _(spark, sf_dir):
    from .functions import text as T

    raw = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " ").when(F.col("p_partkey") % 5 == 1, "1,5").otherwise(F.concat(F.lit(" "), (F.col("p_partkey") / 4).cast("decimal(20,2)").cast("string"))).alias("raw"))
    return _number(raw.select("p_partkey", T.parse_decimal(F.col("raw")).alias("value"), T.bad_decimal(F.col("raw")).alias("bad")))

