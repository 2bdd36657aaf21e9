"""Stored ledgers, populations with proof, results, literals, fixed plans."""

from __future__ import annotations

import datetime as dt
import json
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import literals as Lit
from ledgerloom.operators import fixed, retrieval, search
from ledgerloom.plans import compile as C
from ledgerloom.plans.compile import CEILING, compile_plan, edges_hash, lineage_rows
from ledgerloom.plans.errors import Refused
from ledgerloom.plans.model import Aggregate, Atom, Compare, Lookup, Qualifiers, Rank, RelationCondition, Scope, Screen
from ledgerloom.plans.registry import DEFAULT, Member, Proof, Registry
from ledgerloom.plans.results import exclusions, refuse_duplicates
from ledgerloom.sources import ledger as L

SCOPE = Scope("ECONOMY")
BINDINGS = tuple(DEFAULT._by.values())


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    return L.from_star_schema(spark, sf_dir), L.star(spark, sf_dir)


def content(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("plan", [
    Lookup(SCOPE, ("price", "promo_size")), Screen(SCOPE, ("price",), Atom("promo_size", "gt", (3,))), Screen(SCOPE, ("price",), Atom("price", "gt", (900,)), limit=7), Rank(SCOPE, (("size", "desc"),), limit=9),
    Compare(Scope("ECONOMY", ("P:1", "P:7", "P:13", "P:19")), ("price", "size")), Aggregate(SCOPE, "avg", "price", ("size",)), Aggregate(SCOPE, "count", groups=("brand",)),
    Screen(Scope("ECONOMY", conditions=(RelationCondition("suppliedBy", ("S:1", "S:2")),)), ("price",), Atom("price", "gt", (1,)), Qualifiers(as_of=dt.date(1998, 8, 2)))])
def test_a_stored_ledger_answers_alike(both, plan):
    plain, stored = (compile_plan(plan, x, DEFAULT) for x in both)
    assert plain.columns == stored.columns and content(plain) == content(stored) and stored.count() > 0


def test_only_the_metrics_asked_for_are_read(both):
    df = compile_plan(Lookup(SCOPE, ("price",)), both[1], DEFAULT)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    filters = " ".join(re.findall(r"PartitionFilters: \[.*\]", plan))
    assert "metric_id" in filters and "part.retail_price" in filters and "product_family" in filters and "ECONOMY" in filters
    assert plan.count("Scan parquet") <= 4 and "observation_evidence" not in plan  # lineage stands beside the values


def test_store_keeps_what_is_there(spark, both, tmp_path):
    path = f"file://{tmp_path}/ledger"
    L.store(both[0], path)
    first = L.stored(spark, path, both[0].pin)
    L.store(both[0], path)
    assert first.observations.count() == both[0].observations.count() and first.relations.where("predicate_id = 'variantOf'").count() > 0


def test_representatives_need_their_proof(spark, both):
    plan = Aggregate(SCOPE, "sum", "price", representative="variantOf")
    with_proof = lambda h, version="star": Registry(BINDINGS, proofs=(Proof("ECONOMY", "variantOf", version, h),))
    known = edges_hash(both[0], "variantOf")
    assert known == edges_hash(both[1], "variantOf")
    assert compile_plan(plan, both[1], with_proof(known)).first().value == compile_plan(plan, both[1], DEFAULT).first().value
    for registry in (with_proof("0:0:0"), with_proof(known, "other")):
        with pytest.raises(Refused, match="POPULATION_PROOF_REQUIRED"):
            compile_plan(plan, both[1], registry)
    # an edge that ended counts until its end; two that hold on one day are refused as the rows are read
    base = both[0]
    more = base.relations.where("relation_id = 'V:7'").withColumn("relation_id", F.lit("V:7x")).withColumn("object_id", F.lit("P:12"))
    proof = more.select("relation_id", F.lit("e").alias("evidence_id"), F.lit("s").alias("source_id"), F.lit(True).alias("eligible_for_claim"), F.lit("eligible").alias("cutoff_status"))
    twice = L.Ledger(base.pin, base.products, base.observations, base.observation_evidence, base.relations.unionByName(more), base.relation_evidence.unionByName(proof))
    family = base.products.where("entity_id = 'P:7'").first().product_family
    with pytest.raises(Exception, match="REPRESENTATIVE_AMBIGUOUS P:7"):
        compile_plan(Aggregate(Scope(family), "count", representative="variantOf"), twice, DEFAULT).collect()


def test_a_count_says_what_it_rests_on(both, monkeypatch):
    plan = Aggregate(SCOPE, "count", groups=("brand",))
    with pytest.raises(Refused, match="COUNT_LINEAGE_REQUIRED"):
        lineage_rows(plan, both[1], DEFAULT)
    rows = lineage_rows(plan, both[1], DEFAULT, concepts=("price", "size"))
    counts = {r.brand: r for r in compile_plan(plan, both[1], DEFAULT).collect()}
    for r in rows.groupBy("brand").agg(F.collect_set("entity_id").alias("who")).collect():
        assert set(r.who) <= set(counts[r.brand].entity_ids)
    assert all(r.value == len(r.entity_ids) for r in counts.values()) and CEILING == 10_000
    monkeypatch.setattr(C, "CEILING", 1)
    with pytest.raises(Exception, match="ROW_CEILING"):
        compile_plan(Aggregate(SCOPE, "count"), both[1], DEFAULT).collect()


def test_dated_predicates_are_refused_without_a_day(both):
    strict = Registry(BINDINGS, dated=("suppliedBy",))
    held = Scope("ECONOMY", ("P:1", "P:7"), conditions=(RelationCondition("suppliedBy"),))
    barred = Registry(BINDINGS, barred=(("ECONOMY", "suppliedBy"),))
    for plan, registry, code in (
        (Lookup(held, ("price",)), strict, "AS_OF_REQUIRED"), (Rank(held, (("price", "asc"),)), strict, "AS_OF_REQUIRED"), (Compare(held, ("price",)), DEFAULT, "RELATION_SCOPE_UNSUPPORTED"), (Aggregate(held, "count"), DEFAULT, "RELATION_SCOPE_UNSUPPORTED"),
        (Lookup(held, ("price",)), barred, "RELATION_NOT_ALLOWED"), (Aggregate(SCOPE, "count", qualifiers=Qualifiers(currency="USD")), DEFAULT, "QUALIFIER_NOT_CONSUMED"), (Aggregate(SCOPE, "count", qualifiers=Qualifiers(as_of=dt.date(1998, 8, 2))), DEFAULT, "QUALIFIER_NOT_CONSUMED")):
        with pytest.raises(Refused, match=code):
            compile_plan(plan, both[1], registry)
    assert Registry(BINDINGS).hash != strict.hash != Registry(BINDINGS, (Member("ECONOMY", "part.grade", "AAA"),)).hash


def test_two_observations_of_one_product_are_refused(both):
    base = both[0]
    twice = base.observations.unionByName(base.observations.where("observation_id = 'O:part.size:7'").withColumn("observation_id", F.lit("again")))
    proof = base.observation_evidence.unionByName(base.observation_evidence.where("observation_id = 'O:part.size:7'").withColumn("observation_id", F.lit("again")))
    ledger = L.Ledger(base.pin, base.products, twice, proof, base.relations, base.relation_evidence)
    scope = Scope(base.products.where("entity_id = 'P:7'").first().product_family)
    for plan in (Lookup(scope, ("size",)), Screen(scope, ("size",), Atom("size", "gte", (0,))), Rank(scope, (("size", "desc"),), limit=100)):
        with pytest.raises(Exception, match="RETURNED_DUPLICATE_ROW P:7"):
            compile_plan(plan, ledger, DEFAULT).collect()
    # sums run over observations: both count
    one, two = (compile_plan(Aggregate(scope, "avg", "size"), x, DEFAULT).first().n_observations for x in (base, ledger))
    assert two == one + 1
    bounded = compile_plan(Screen(Scope(scope.family, ("P:7",)), ("size",), Atom("size", "gte", (0,)), limit=5), ledger, DEFAULT).collect()
    assert len(bounded) <= 1


def test_results(spark):
    rows = spark.createDataFrame([("a", None, "missing", "late"), ("b", Decimal(0), "zero", None), ("c", None, "placeholder", None)], "entity_id string, x decimal(38,12), x_status string, x_reason string")
    assert [(r.subject_id, r.reason_code) for r in exclusions(rows, ("x",)).orderBy("subject_id").collect()] == [("a", "late"), ("c", "PLACEHOLDER")]
    assert refuse_duplicates(rows, ["entity_id"]).count() == 3
    with pytest.raises(Exception, match="RETURNED_DUPLICATE_ROW a"):
        refuse_duplicates(rows.unionByName(rows.limit(1)), ["entity_id"]).collect()


def test_literals(spark):
    t = F.col("t")
    say = lambda text, *c: spark.createDataFrame([(text,)], "t string").select(*c).first()
    assert [str(x) for x in say("1,234.5만원과 900원", F.transform(Lit.amounts(t), lambda x: x.cast("decimal(38,0)")))[0]] == ["12345000", "900"]
    assert say("0.50%, 12,000.10%", Lit.percentages(t))[0] == ["0.5", "12000.1"]
    assert say("2024-02-30 2024-02-29 2023년 1월 5일", Lit.days(t))[0] == [dt.date(2024, 2, 29), dt.date(2023, 1, 5)]
    assert say("3년, 6개월, 2023년 1월", Lit.periods(t))[0] == ["P3Y", "P6M"]
    assert say("10위 안의 5개, 세 종목, 두 상품군, 6개월", F.concat(Lit.ranks(t), Lit.limits(t)))[0] == [10, 5, 3]
    for text, want in (("이하", "lte"), ("이하가 아닌", "gt"), ("초과", "gt"), ("1부터 5까지", "between"), ("일본 제외", "not_in"), ("그냥", None)):
        assert say(text, Lit.comparison(t))[0] == want
    assert say("등급 AA 이상", Lit.credit_grade(t))[0] == "AA0" and say("AAAA", Lit.credit_grade(t))[0] is None
    with pytest.raises(Refused, match="CREDIT_THRESHOLD_UNKNOWN"):
        Lit.credit_at_least("grade", "BBB")


def test_tagged_values(spark):
    good = [{"type": "integer", "value": 0}, {"type": "integer", "value": -12}, {"type": "decimal", "value": "10"}, {"type": "decimal", "value": "0.5"}, {"type": "datetime", "value": "2024-01-02T03:04:05Z"}, {"type": "string", "value": ""}, {"type": "tuple", "items": []}, {"type": "null", "value": None}]
    bad = [{"type": "integer", "value": 1.5}, {"type": "integer", "value": True}, {"type": "decimal", "value": 1}, {"type": "decimal", "value": "01"}, {"type": "datetime", "value": "2024-01-02T03:04:05.000000Z"}, {"type": "string"}, {"value": "x"}, [], "x", {"type": "odd", "value": 1}, {"type": "tuple", "items": 3}, {"type": "string", "value": 5}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(good + bad)] + [(99, None), (100, "{")], "i int, t string")
    got = {r.i: r.ok for r in df.select("i", Lit.valid_tagged(F.col("t")).alias("ok")).collect()}
    assert [i for i in got if got[i]] == list(range(len(good)))


def test_fixed_plans_refuse(spark):
    for plan, word, n, code in (("other", "x", 1, "UNKNOWN_PLAN"), ("rank_return", " ", 1, "KEYWORD_INVALID"), ("rank_return", "a%", 1, "LITERAL_KEYWORD_REQUIRED"), ("document_risk", "x", 4, "LIMIT_INVALID")):
        with pytest.raises(Refused, match=code):
            fixed.check(plan, word, n)
    wrong = spark.createDataFrame([("some risk", "0")], "text string, content_hash string")
    with pytest.raises(Exception, match="DOCUMENT_HASH_MISMATCH"):
        wrong.select(fixed.checked_excerpt(F.col("text"), F.col("content_hash"), "risk")).collect()


def test_a_stored_index_finds_alike(spark, tmp_path):
    names = spark.createDataFrame([("a", "Alpha Fund"), ("b", "Alpha Growth Fund"), ("c", "Beta")], "entity_id string, name string")
    aliases = spark.createDataFrame([("c", "alpha found")], "entity_id string, alias string")
    idents = spark.createDataFrame([("b", "X 1")], "entity_id string, identifier_value string")
    mentions = spark.createDataFrame([(1, "alpha fund"), (2, "x1"), (3, "alpha fun")], "mention_id long, mention string")
    index = search.store_index(search.trigram_index(names, aliases), f"file://{tmp_path}/index")
    plain, stored = search.match_entities(mentions, names, idents, aliases), search.match_entities(mentions, names, idents, aliases, index=index)
    assert content(plain) == content(stored) and plain.count() > 4
    assert search.match_entities(mentions, names, idents, aliases, most=2).count() == 2


def plain_chunks(text, least=300, most=800, overlap=75):
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out, start = [], 0
    while len(words) - start > most:
        cut = None
        for rule in ("paragraph", "sentence"):
            for e in range(start + least, start + most + 1):
                gap = text[words[e - 1][1] : words[e][0]] if e < len(words) else ""
                if ("\n\n" in gap) if rule == "paragraph" else text[words[e - 1][1] - 1] in ".!?":
                    cut = e
            if cut:
                break
        cut = cut or start + most
        out.append((start, cut))
        start = max(cut - overlap, start + 1)
    if words:
        out.append((start, len(words)))
    return out


def test_chunks_against_a_plain_version(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + ["", "one", "a. " * 2000, "w " * 1700 + "\n\n" + "v " * 900]
    for t in texts:
        got, want = retrieval.chunk_text(t), plain_chunks(t)
        assert got[:-2] == want[:-2] and (not want or got[-1][1] == want[-1][1])
        assert all(b - a <= 800 for a, b in got) and all(x[1] >= y[0] for x, y in zip(got, got[1:], strict=False))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "same words " * 3)], "doc_id long, text string")
    assert [(r.doc_id, r.ordinal, r.end_word) for r in retrieval.chunk_documents(df).collect()] == [(3, 0, 6)]
