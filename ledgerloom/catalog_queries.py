"""Registered queries of the ledger engine, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dataflow, retrieval, search
from .plans.compile import compile_plan
from .plans.model import Aggregate, AllOf, AnyOf, Atom, Compare, Lookup, Not, Operation, Qualifiers, Rank, RelationCondition, Scope, Screen
from .plans.registry import DEFAULT
from .sources import ledger as L
from .sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

CUTOFF = dt.date(1998, 8, 2)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(df: DataFrame) -> DataFrame:
    """Decimals as doubles of six places, so that both engines' values hash alike."""
    return df.select(*[F.round(F.col(f.name).cast("double"), 6).alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema])


def _register(name: str, sql: str | None = None):
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return put



def _plan(name: str, make: Callable[[], Operation], columns: list[str], sql: str, joined: tuple[str, ...] = (), prior: Callable[[], Operation] | None = None) -> None:
    """A query that compiles a plan, its arrays in `joined` as comma lists."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = L.star(spark, sf_dir)
        frames = {"first": compile_plan(prior(), ledger, DEFAULT)} if prior else {}
        rows = compile_plan(make(), ledger, DEFAULT, frames)
        return _number(rows.select(*[F.array_join(c, ",").alias(c) if c in joined else F.col(c) for c in columns]))

    _register(name, sql)(query)


#: The ledger over the star schema, in SQL.
_LEDGER = """
prod AS (SELECT 'P:' || p_partkey AS entity_id, p_name AS product_name, p_type AS fam, p_partkey AS k, CAST(p_retailprice AS DECIMAL(38,12)) AS price, CAST(p_size AS DECIMAL(38,12)) AS size, p_brand AS brand,
  CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_size > 45 THEN 0 ELSE p_size END AS promo FROM part),
kept AS (SELECT * FROM prod WHERE k % 11 <> 0),
edge AS (SELECT 'P:' || l_partkey AS subject_id, 'S:' || l_suppkey AS object_id, 'R:' || l_partkey || ':' || l_suppkey AS relation_id, min(CAST(l_shipdate AS DATE)) AS valid_from,
  CASE WHEN (l_partkey + l_suppkey) % 3 <> 0 THEN max(CAST(l_shipdate AS DATE)) END AS valid_to FROM lineitem GROUP BY l_partkey, l_suppkey)
"""
_F = "round(CAST({} AS DOUBLE), 6) AS {}"


def _ev(metric: str, alias: str) -> str:
    base = f"'E:O:{metric}:' || k || ':a'"
    return f"CASE WHEN k % 7 = 0 THEN {base} || ',E:O:{metric}:' || k || ':b' ELSE {base} END AS {alias}"


_PRICE, _SIZE, _BRAND = _F.format("price", "price"), _F.format("size", "size"), "brand"
_S = "SELECT entity_id, product_name, "



def _define(family: str) -> None:
    """Plans over one product family."""
    scope = Scope(family)
    of = f"FROM kept WHERE fam = '{family}'"
    w = f"WITH {_LEDGER} "
    num = lambda c, op, *v: Atom(c, op, tuple(Decimal(x) if isinstance(x, str) else x for x in v))
    _plan("lookup_fields", lambda: Lookup(scope, ("price", "promo_size")), ["entity_id", "product_name", "price", "price_status", "price_evidence_ids", "promo_size", "promo_size_status", "promo_size_reason", "promo_size_observation_id"],
          w + _S + f"{_PRICE}, CASE WHEN price = 0 THEN 'zero' ELSE 'present' END AS price_status, {_ev('part.retail_price', 'price_evidence_ids')}, {_F.format('promo', 'promo_size')}, CASE WHEN promo IS NULL THEN 'missing' WHEN promo = 0 THEN 'zero' ELSE 'present' END AS promo_size_status, CASE WHEN promo IS NULL THEN 'not_offered' END AS promo_size_reason, 'O:part.promo_size:' || k AS promo_size_observation_id {of}", ("price_evidence_ids",))
    screen = lambda p, c=("price", "size"): (lambda: Screen(scope, c, p))
    shown = ["entity_id", "product_name", "price", "size"]
    sel = w + _S + f"{_PRICE}, {_SIZE} {of} AND "
    _plan("screen_eq", screen(Atom("size", "eq", (10,))), shown, sel + "size = 10")
    _plan("screen_range", screen(AllOf((num("size", "between", 10, 20), num("price", "gt", "930"), num("price", "lte", "980")))), shown, sel + "size BETWEEN 10 AND 20 AND price > 930 AND price <= 980")
    _plan("screen_in", screen(AllOf((Atom("size", "in", (1, 2, 3, 5)), Atom("brand", "not_in", ("Brand#11", "Brand#22")))), ("price", "size", "brand")), shown, sel + "size IN (1, 2, 3, 5) AND brand NOT IN ('Brand#11', 'Brand#22')")
    _plan("screen_contains", screen(Atom("brand", "contains", ("d#_2",)), ("price", "size", "brand")), [*shown, "brand"], w + _S + f"{_PRICE}, {_SIZE}, brand {of} AND brand LIKE '%d#_2%'")
    _plan("screen_any_of", screen(AnyOf((num("size", "lt", 3), num("price", "gte", "995.5")))), shown, sel + "(size < 3 OR price >= 995.5)")
    _plan("screen_not_guarded", screen(Not(AnyOf((Atom("promo_size", "gt", (20,)), Atom("size", "eq", (7,)))))), shown, sel + "promo IS NOT NULL AND NOT (promo > 20 OR size = 7)")
    _plan("screen_neq_zero", screen(Atom("promo_size", "neq", (0,)), ("promo_size",)), ["entity_id", "product_name", "promo_size"], w + _S + f"{_F.format('promo', 'promo_size')} {of} AND promo IS NOT NULL AND promo <> 0")
    _plan("screen_missing", screen(Atom("promo_size", "is_missing"), ("price",)), shown[:3], w + _S + f"{_PRICE} {of} AND promo IS NULL")
    _plan("screen_present", screen(Atom("promo_size", "is_present"), ("price",)), shown[:3], w + _S + f"{_PRICE} {of} AND promo IS NOT NULL")
    _plan("screen_bounded_count", lambda: Screen(scope, ("price",), num("price", "gt", "950"), limit=20), [*shown[:3], "population"],
          w + f", elig AS (SELECT * {of} AND price > 950 AND k % 5 <> 0) " + _S + f"{_PRICE}, (SELECT count(*) FROM elig) AS population FROM elig ORDER BY entity_id LIMIT 20")
    _plan("rank_desc_ties", lambda: Rank(scope, (("size", "desc"),), limit=25), ["entity_id", "product_name", "size"], w + _S + f"{_SIZE} {of} ORDER BY kept.size DESC, entity_id LIMIT 25")
    _plan("rank_multi_key", lambda: Rank(scope, (("size", "asc"), ("price", "desc")), num("size", "between", 10, 20), limit=5), ["entity_id", "product_name", "size", "price", "price_evidence_ids", "price_observation_id"],
          w + _S + f"{_SIZE}, {_PRICE}, {_ev('part.retail_price', 'price_evidence_ids')}, 'O:part.retail_price:' || k AS price_observation_id {of} AND kept.size BETWEEN 10 AND 20 ORDER BY kept.size, kept.price DESC, entity_id LIMIT 5", ("price_evidence_ids",))
    _plan("compare_subjects", lambda: Compare(Scope(family, tuple(f"P:{i}" for i in range(1, 17))), ("price", "promo_size")), ["entity_id", "product_name", "price", "promo_size"],
          w + _S + f"{_PRICE}, {_F.format('promo', 'promo_size')} {of} AND promo IS NOT NULL AND k BETWEEN 1 AND 16")
    agg = w + "SELECT round(CAST({} AS DOUBLE), 6) AS value, count(*) AS n_entities, "
    nev = f"(SELECT sum(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END) {of} AND {{}}) AS n_evidence FROM prod WHERE fam = '{family}' AND {{}}"
    _plan("agg_sum", lambda: Aggregate(scope, "sum", "price", predicate=num("size", "gte", 5)), ["value", "n_entities", "n_evidence"],
          agg.format("sum(price)") + f"CAST((SELECT sum(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END) {of} AND size >= 5) AS BIGINT) AS n_evidence FROM prod WHERE fam = '{family}' AND size >= 5")
    _plan("agg_no_fanout", lambda: Aggregate(scope, "sum", "price"), ["value", "n_entities", "n_evidence"],
          agg.format("sum(price)") + f"CAST((SELECT sum(CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END) {of}) AS BIGINT) AS n_evidence FROM prod WHERE fam = '{family}'")
    _plan("agg_avg_group", lambda: Aggregate(scope, "avg", "price", ("brand",)), ["brand", "value", "n_entities", "n_evidence"],
          w + f"SELECT brand, round(CAST(sum(price) AS DOUBLE) / count(*), 6) AS value, count(*) AS n_entities, CAST(sum(CASE WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_evidence FROM prod WHERE fam = '{family}' GROUP BY brand HAVING count(*) FILTER (k % 11 <> 0) > 0")
    for f in ("min", "max"):
        _plan(f"agg_{f}_group", lambda f=f: Aggregate(scope, f, "price", ("size",)), ["size", "value", "n_entities"],
              w + f"SELECT {_SIZE}, round(CAST({f}(price) AS DOUBLE), 6) AS value, count(*) AS n_entities FROM prod WHERE fam = '{family}' GROUP BY prod.size HAVING count(*) FILTER (k % 11 <> 0) > 0")
    _plan("agg_count_population", lambda: Aggregate(scope, "count", groups=("brand",), predicate=Atom("promo_size", "gt", (0,))), ["brand", "value", "entity_ids"],
          w + f"SELECT brand, count(*) AS value, string_agg(entity_id, ',' ORDER BY entity_id) AS entity_ids FROM prod WHERE fam = '{family}' AND promo > 0 GROUP BY brand", ("entity_ids",))
    held = RelationCondition("suppliedBy", ("S:1", "S:2", "S:3", "S:4", "S:5"))
    rel = w + f", hit AS (SELECT subject_id, string_agg(object_id, ',' ORDER BY object_id) AS suppliedBy_objects FROM edge WHERE object_id IN ('S:1','S:2','S:3','S:4','S:5') AND {{}} GROUP BY subject_id) SELECT entity_id, product_name, {_PRICE}, suppliedBy_objects FROM kept JOIN hit ON subject_id = entity_id WHERE fam = '{family}' AND price > 0"

    def relation(name: str, q: Qualifiers, condition: str) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .plans.compile import related

            ledger = L.star(spark, sf_dir)
            plan = Screen(Scope(family, conditions=(held,)), ("price",), num("price", "gt", "0"), q)
            objects = related(ledger, held.predicate, held.objects, q).select("entity_id", F.array_join("suppliedBy_objects", ",").alias("suppliedBy_objects"))
            return _number(compile_plan(plan, ledger, DEFAULT).select(*shown[:3]).join(L.sorted_by_key(objects), "entity_id"))

        _register(name, rel.format(condition))(query)

    relation("relation_asof", Qualifiers(as_of=CUTOFF), "valid_from <= DATE '1998-08-02' AND (valid_to IS NULL OR valid_to >= DATE '1998-08-02')")
    relation("relation_open_ended", Qualifiers(), "valid_to IS NULL")
    _plan("prior_result_rank_then_screen", lambda: Screen(Scope(family, prior="first"), ("price", "size"), num("price", "gt", "940")), shown,
          w + f", top AS (SELECT entity_id {of} ORDER BY kept.size DESC, entity_id LIMIT 50) " + _S + f"{_PRICE}, {_SIZE} {of} AND entity_id IN (SELECT entity_id FROM top) AND price > 940", prior=lambda: Rank(scope, (("size", "desc"),), limit=50))
    _plan("screen_qualified", lambda: Screen(scope, ("price",), num("price", "lt", "960"), Qualifiers(currency="USD", unit="amount", as_of=CUTOFF)), shown[:3], w + _S + f"{_PRICE} {of} AND price < 960")


_define("ECONOMY")


@_register("status_violations", """SELECT 'O:' || m || ':' || p_partkey AS observation_id FROM part, (VALUES ('part.size', 3), ('part.promo_size', 5)) v(m, d)
WHERE p_partkey % 10 = d AND NOT (m = 'part.promo_size' AND p_partkey % 4 <> 0 AND p_size <= 45) AND NOT (m = 'part.size' AND p_size = 0)""")
def _(spark, sf_dir):
    # sizes that call themselves zero, and sizes of promotions that call themselves present
    o = L.star(spark, sf_dir).observations
    k = F.regexp_extract("observation_id", r"(\d+)$", 1).cast("long") % 10
    wrong = F.when((F.col("metric_id") == "part.size") & (k == 3), "zero").when((F.col("metric_id") == "part.promo_size") & (k == 5), "present").otherwise(F.col("value_status"))
    return L.status_violations(o.withColumn("value_status", wrong)).select("observation_id")


@_register("semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)")
def _(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000")
    return _table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@_register("anti_missing", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def _(spark, sf_dir):
    return dataflow.unsupported(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")


@_register("left_outer_hydrate", "SELECT d.doc_id, l.quality, l.toxic, b.n FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) b ON b.source = d.source")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(_table(spark, sf_dir, "labels"), "doc_id", "left").join(d.groupBy("source").agg(F.count("*").alias("n")), "source", "left").select("doc_id", "quality", "toxic", "n")


@_register("latest_per_key", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id) AS k FROM events WHERE CAST(ts AS DATE) <= (SELECT CAST(max(ts) AS DATE) - 3 FROM events)) WHERE k = 1")
def _(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    cut = e.agg(F.date_sub(F.max("day"), 3).alias("cut"))
    return dataflow.latest_per_key(e.crossJoin(F.broadcast(cut)), ["user_id"], "day", F.col("cut"), "event_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@_register("latest_filing", "SELECT o_custkey AS cik, o_orderpriority AS series_id, o_orderkey AS accession FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY m DESC) AS r FROM (SELECT *, date_trunc('month', o_orderdate) AS m, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1) WHERE r = 1")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("report_date"), F.col("o_orderdate").alias("filed_at"), F.col("o_orderkey").alias("accession"))
    return dataflow.latest_filing(o).select("cik", "series_id", "accession")


_CHUNKS = "ch AS (SELECT doc_id, doc_id * 100000 + i AS chunk_id, i AS ordinal, p AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return d.select("doc_id", (F.col("doc_id") * 100000 + F.col("ordinal")).alias("chunk_id"), F.col("ordinal").cast("long").alias("ordinal"), "text")


@_register("first_chunk_per_doc", f"WITH {_CHUNKS} SELECT doc_id, chunk_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, chunk_id) AS k FROM ch WHERE strpos(text, 'the') > 0) WHERE k = 1")
def _(spark, sf_dir):
    return retrieval.first_chunk(_chunks(spark, sf_dir), "the").select("doc_id", "chunk_id", "ordinal")


@_register("excerpt_risk", "SELECT doc_id, substr(text, greatest(1, strpos(text, 'and') - 180), 1280) AS excerpt, sha256(text) AS content_hash FROM documents WHERE strpos(text, 'and') > 0")
def _(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where(F.instr("text", "and") > 0)
    return d.select("doc_id", T.excerpt(F.col("text"), "and").alias("excerpt"), F.sha2("text", 256).alias("content_hash"))


@_register("distinct_on_first", "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def _(spark, sf_dir):
    return dataflow.distinct_on(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@_register("window_count_over", "SELECT s_suppkey, s_name, count(*) OVER () AS population FROM supplier WHERE s_acctbal > 0")
def _(spark, sf_dir):
    return dataflow.with_total(_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name"))


@_register("hash_sample", "SELECT c_custkey, c_name FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100")
def _(spark, sf_dir):
    return dataflow.hash_sample(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


@_register("unpivot_eav", "SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def _(spark, sf_dir):
    return dataflow.unpivot(_table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_brand", "p_type"])


@_register("posexplode_list", "SELECT p_partkey, CAST(i AS BIGINT) AS ordinal, item FROM (SELECT p_partkey, unnest(range(len(w))) AS i, unnest(w) AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def _(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return dataflow.explode_ordered(p, "w").select("p_partkey", F.col("ordinal").cast("long").alias("ordinal"), "item")


@_register("split_ordered_list", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_type || '|' || p_brand END || '|' || p_size AS items FROM part")
def _(spark, sf_dir):
    listed = F.concat(F.lit(" ,"), "p_type", F.lit(" , ,"), "p_brand", F.lit(","), "p_type", F.lit(", "), F.col("p_size").cast("string"), F.lit(" ,"), "p_brand")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_list(listed), "|").alias("items"))


@_register("dup_keys_having", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    return dataflow.duplicates(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@_register("key_conflicts", "SELECT l_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag || l_linestatus) > 1")
def _(spark, sf_dir):
    return dataflow.conflicts(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@_register("single_date_default", "SELECT CASE WHEN count(*) > 0 AND count(*) = count(d) AND min(d) = max(d) AND max(d) <= DATE '2100-01-01' THEN min(d) END AS as_of FROM (SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS d FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) FROM orders))")
def _(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.to_date(F.trunc("o_orderdate", "year")).alias("d"))
    first = o.agg(F.min("d").alias("y"))
    return dataflow.single_date(o.join(F.broadcast(first), F.col("d") == F.col("y")), "d", F.to_date(F.lit("2100-01-01")))


@_register("filter_aggregate", "SELECT n_nationkey, count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS in_debt, round(coalesce(sum(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 0), 4) AS building FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.round(F.coalesce(F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))), F.lit(0.0)), 4).alias("building"))


@_register("count_distinct_holders", "SELECT l_suppkey, count(DISTINCT l_partkey) AS products, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("products"), F.count("*").alias("n"))


@_register("set_difference", "SELECT n_nationkey AS nation, 'expected' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT s_nationkey, 'observed' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def _(spark, sf_dir):
    expected = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    return dataflow.difference(expected, _table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")).distinct())


@_register("audit_outer", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_source' WHEN a.k IS NULL THEN 'only_ledger' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'matched' ELSE 'differs' END AS verdict FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS v FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_size END AS v FROM part WHERE p_partkey % 4 <> 0) b ON a.k = b.k")
def _(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("value"))
    b = p.where("p_partkey % 4 != 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(F.col("p_size")).alias("value"))
    return dataflow.audit_values(a, b, ["k"]).select("k", "verdict")


_QUERY_VECTOR = [round(0.05 * ((i * 7) % 11 - 5), 2) for i in range(64)]
_VEC = "[" + ",".join(f"{x}" for x in _QUERY_VECTOR) + "]::DOUBLE[]"


def _vector(metric: str, sql: str) -> None:
    @_register(f"vector_topk_{metric}", f"SELECT vec_id, label, round({sql.format(e='CAST(embedding AS DOUBLE[])', q=_VEC)}, 6) AS distance FROM embeddings ORDER BY {sql.format(e='CAST(embedding AS DOUBLE[])', q=_VEC)}, vec_id LIMIT 20")
    def _(spark, sf_dir):
        return retrieval.vector_topk(_table(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 20, metric).select("vec_id", "label", F.round("distance", 6).alias("distance"))


_vector("cosine", "list_cosine_distance({e}, {q})")
_vector("inner_product", "-list_inner_product({e}, {q})")
_vector("l2", "list_distance({e}, {q})")

#: Padded word trigrams of a text in SQL.
_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_KEYWORD = "  The thing   Tionly "
_Q = " ".join(_KEYWORD.split()).casefold()


@_register("keyword_topk", f"WITH g AS (SELECT item_id, {_GRAMS.format('text')} AS a, {_GRAMS.format(chr(39) + _Q + chr(39))} AS b FROM benchmark), s AS (SELECT item_id, len(list_intersect(a, b)) AS n, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM g) SELECT item_id, round(n / u, 6) AS score FROM s WHERE n > 0 ORDER BY n / u DESC, item_id LIMIT 10")
def _(spark, sf_dir):
    return retrieval.keyword_topk(_table(spark, sf_dir, "benchmark"), _KEYWORD, 10, ties=("item_id",)).select("item_id", F.round("score", 6).alias("score"))


@_register("rrf_fusion", f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY list_cosine_distance(CAST(embedding AS DOUBLE[]), {_VEC}), vec_id) AS r FROM embeddings),
b AS (SELECT vec_id, row_number() OVER (ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_VEC}), vec_id) AS r FROM embeddings),
u AS (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50)
SELECT vec_id, round(sum(1.0 / (60 + r)), 6) AS score, count(*) AS n_lists FROM u GROUP BY vec_id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 12) DESC, vec_id LIMIT 10""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    lists = {}
    for m in ("cosine", "l2"):
        top = retrieval.vector_topk(_table(spark, sf_dir, "embeddings"), _QUERY_VECTOR, 50, m)
        lists[m] = top.select("vec_id", F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))  # fifty rows
    return retrieval.rank_fusion(lists, ("vec_id",), 10).select("vec_id", F.round("score", 6).alias("score"), "n_lists")


_INDEXES: dict[tuple[str, str], DataFrame] = {}
_MENTIONS = [(1, "Customer#000000001"), (2, "customer # 000000022"), (3, "Customer#00000012"), (4, "Supplier#000000003"), (5, "P-7")]
_MSQL = "m(mention_id, mention) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in _MENTIONS) + ")"


@_register("union_match_strategies", rf"""WITH {_MSQL}, names AS (SELECT 'C:' || c_custkey AS id, c_name AS name FROM customer), al AS (SELECT 'S:' || s_suppkey AS id, s_name AS name FROM supplier),
ids AS (SELECT 'P:' || p_partkey AS id, 'P-' || p_partkey AS v FROM part),
cand AS (SELECT mention_id, id, 1 AS p, 'identifier' AS strategy, 1000000 AS score FROM m JOIN ids ON upper(regexp_replace(mention, '\s', '', 'g')) = upper(v)
UNION ALL SELECT mention_id, id, 2, 'name', 1000000 FROM m JOIN names ON upper(regexp_replace(mention, '\s', '', 'g')) = upper(regexp_replace(name, '\s', '', 'g'))
UNION ALL SELECT mention_id, id, 3, 'alias', 1000000 FROM m JOIN al ON upper(regexp_replace(mention, '\s', '', 'g')) = upper(regexp_replace(name, '\s', '', 'g'))
UNION ALL SELECT mention_id, id, 4, 'trigram', CAST(floor(s * 1000000) AS INTEGER) FROM (SELECT mention_id, id, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS s FROM (SELECT mention_id, id, {_GRAMS.format('mention')} AS a, {_GRAMS.format('name')} AS b FROM m, (SELECT * FROM names UNION ALL SELECT * FROM al))) WHERE s >= 0.3),
best AS (SELECT *, row_number() OVER (PARTITION BY mention_id, id ORDER BY p, score DESC) AS k FROM cand)
SELECT CAST(mention_id AS BIGINT) AS mention_id, id AS entity_id, strategy, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY p, score DESC, id) AS INTEGER) AS rank FROM best WHERE k = 1) WHERE rank <= 5""")
def _(spark, sf_dir):
    mentions = spark.createDataFrame(_MENTIONS, "mention_id long, mention string")
    named = lambda t, letter, key, name: _table(spark, sf_dir, t).select(F.concat(F.lit(f"{letter}:"), F.col(key).cast("string")).alias("entity_id"), F.col(name).alias("name"))
    identifiers = _table(spark, sf_dir, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("identifier_value"))
    names, aliases = named("customer", "C", "c_custkey", "c_name"), named("supplier", "S", "s_suppkey", "s_name").withColumnRenamed("name", "alias")
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:  # stored once, as the ledger is
        _INDEXES[at] = search.store_index(search.trigram_index(names, aliases), L.shared_folder(spark))
    return search.match_entities(mentions, names, identifiers, aliases, index=_INDEXES[at], most=80)


@_register("surfaces_in_text", "SELECT DISTINCT n_name AS surface FROM nation WHERE length(n_name) >= 2 AND (contains('CHINAORUNITEDSTATES', upper(replace(n_name, ' ', ''))) OR contains('FRANCE', upper(replace(n_name, ' ', ''))) OR contains('NATION_7NATION_12', upper(replace(n_name, ' ', ''))))")
def _(spark, sf_dir):
    return search.surfaces_in_text(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("surface")), ["China or United States", "france", "nation_7 nation_12"])


# orders in rings of two and of 51, and a chain into each ring of two
@_register("cycle_check", "SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 60 < 2 OR (o_orderkey % 60 >= 9 AND o_orderkey // 60 * 60 + 59 <= (SELECT max(o_orderkey) FROM orders))")
def _(spark, sf_dir):
    k = F.col("child") % 60
    parent = F.when(k == 0, F.col("child") + 1).when((k == 1) | ((k > 1) & (k < 9)), F.col("child") - 1).when(k == 59, F.col("child") - 50).otherwise(F.col("child") + 1)
    return dataflow.in_cycles(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child")).withColumn("parent", parent))


# customers in rings of 100; the last ones make a chain that ends where their ring is not full
@_register("cycle_check_rings", "SELECT c_custkey AS node FROM customer WHERE (c_custkey // 100 + 1) * 100 <= (SELECT max(c_custkey) + 1 FROM customer)")
def _(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"))
    return dataflow.in_cycles(c.withColumn("parent", F.when(F.col("child") % 100 == 99, F.col("child") - 99).otherwise(F.col("child") + 1)))


@_register("entity_classes", f"WITH {_LEDGER} SELECT entity_id, CASE WHEN EXISTS (SELECT 1 FROM edge WHERE subject_id = entity_id) THEN list_aggregate(list_sort([fam, 'Supplied']), 'string_agg', ',') ELSE fam END AS classes FROM prod")
def _(spark, sf_dir):
    ledger = L.star(spark, sf_dir)
    return dataflow.entity_classes(ledger.products, ledger.relations).select("entity_id", F.array_join("classes", ",").alias("classes"))


@_register("graph_shapes", f"""WITH {_LEDGER}, e AS (SELECT relation_id, CASE WHEN CAST(substr(object_id, 3) AS BIGINT) % 9 = 0 THEN object_id ELSE subject_id END AS s, object_id AS o, CAST(substr(subject_id, 3) AS BIGINT) % 8 = 0 AND valid_to IS NOT NULL AS late, CAST(substr(subject_id, 3) AS BIGINT) % 7 = 0 AS twice FROM edge)
SELECT 'loop' AS shape, relation_id FROM e WHERE s = o UNION ALL SELECT 'loop', relation_id || 'x' FROM e WHERE s = o AND twice UNION ALL SELECT 'ends_before_start', relation_id FROM e WHERE late UNION ALL SELECT 'ends_before_start', relation_id || 'x' FROM e WHERE late AND twice
UNION ALL SELECT 'repeated', min(relation_id) FROM (SELECT * FROM e UNION ALL SELECT relation_id || 'x', s, o, late, twice FROM e WHERE twice) GROUP BY s, o HAVING count(*) > 1""")
def _(spark, sf_dir):
    # edges whose subject is their object, that end ten days before they begin, and that come twice
    r = L.star(spark, sf_dir).relations.where("predicate_id = 'suppliedBy'")
    key = lambda c: F.substring(c, 3, 20).cast("long")
    broken = r.withColumn("late", (key("subject_id") % 8 == 0) & F.col("valid_to").isNotNull()).withColumn("twice", key("subject_id") % 7 == 0)
    broken = broken.withColumn("valid_to", F.when(F.col("late"), F.date_sub("valid_from", 10)).otherwise(F.col("valid_to"))).withColumn("subject_id", F.when(key("object_id") % 9 == 0, F.col("object_id")).otherwise(F.col("subject_id")))
    return dataflow.graph_violations(broken.unionByName(broken.where("twice").withColumn("relation_id", F.concat("relation_id", F.lit("x")))))


@_register("nearest_rank_percentiles", "SELECT round(quantile_disc(o_totalprice, 0.5), 6) AS p50, round(quantile_disc(o_totalprice, 0.95), 6) AS p95 FROM orders")
def _(spark, sf_dir):
    return dataflow.nearest_rank(_table(spark, sf_dir, "orders").select(F.round("o_totalprice", 6).alias("v")), "v", [50, 95])


@_register("classification_metrics", "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn FROM labels) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(spark, sf_dir):
    flags = _table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("predicted"))
    return dataflow.classification(flags).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_register("json_elements", "SELECT o_orderkey, CAST(i AS BIGINT) AS ordinal, w AS element FROM (SELECT o_orderkey, unnest(range(1, 4)) AS i, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS w FROM orders)")
def _(spark, sf_dir):
    refs = F.to_json(F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.from_json(refs, "array<string>")).alias("ordinal", "element"))
    return o.withColumn("ordinal", F.col("ordinal").cast("long") + 1)


@_register("example_products_by_family", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def _(spark, sf_dir):
    return L.star(spark, sf_dir).products.groupBy(F.col("product_family").alias("p_type")).agg(F.count("*").alias("n"))


@_register("table_content_hash", "SELECT count(*) AS n, true AS same_in_any_order, false AS same_with_a_change, sha256(string_agg(h, '' ORDER BY l_orderkey, l_linenumber, l_returnflag)) AS ordered FROM (SELECT l_orderkey, l_linenumber, l_returnflag, sha256('{\"l_linenumber\":' || l_linenumber || ',\"l_orderkey\":' || l_orderkey || ',\"l_returnflag\":\"' || l_returnflag || '\"}') AS h FROM lineitem)")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    n, h = sinks.table_hash(rows)
    other = sinks.table_hash(rows.repartition(5, "l_returnflag"))[1] == h
    changed = sinks.table_hash(rows.withColumn("l_returnflag", F.when(F.col("l_orderkey") == 1, "Z").otherwise(F.col("l_returnflag"))))[1] == h
    return spark.createDataFrame([(n, other, changed, sinks.ordered_hash(rows, ["l_orderkey", "l_linenumber", "l_returnflag"]))], "n long, same_in_any_order boolean, same_with_a_change boolean, ordered string")


@_register("chunk_documents")  # SQL has no loop over what is left of a text; tests hold it against a plain version
def _(spark, sf_dir):
    return retrieval.chunk_documents(_table(spark, sf_dir, "documents")).drop("text")
