"""Feeds, integrity rules, claims, runs and documents against hand-made cases."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_with_origins
from ledgerloom.operators import claims as C
from ledgerloom.operators import graph, integrity, retrieval, runs
from ledgerloom.plans.errors import Refused
from ledgerloom.sources import feeds

DAY = dt.date(2026, 8, 21)


def rates(spark, *changes):
    rows = [["731Y001", f"I{i % 2}", f"won per {i % 2}", "원", f"2024010{i // 2 + 1}", "1300.5"] for i in range(4)] + [["731Y001", "other", "x", "y", "never", "none"]]
    for row, column, value in changes:
        rows[row][column] = value
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in feeds.RATE_COLUMNS))


@pytest.mark.parametrize("changes, code", [
    ([(0, 0, "x")], "RATES_SCHEMA"), ([(1, 3, "달러")], "RATES_SCHEMA"), ([(1, 4, "20240230")], "RATES_SCHEMA"), ([(2, 5, "0")], "RATES_VALUE"), ([(2, 5, "1,3")], "RATES_VALUE"), ([(2, 4, "20240101")], "RATES_DUPLICATE"), ([(1, 1, "other"), (3, 1, "other")], "RATES_COVERAGE"), ([(4, 2, "")], "RATES_SCHEMA")])
def test_rates_are_refused_whole(spark, changes, code):
    items = {"I0": "won per 0", "I1": "won per 1"}
    assert feeds.exchange_rates(rates(spark), items).count() == 4
    with pytest.raises(Refused, match=code):
        feeds.exchange_rates(rates(spark, *changes), items)
    with pytest.raises(Refused, match="RATES_SCHEMA"):
        feeds.exchange_rates(rates(spark).limit(0), items)


def test_market_feeds(spark):
    columns = ", ".join(f"{c} string" for c in feeds.MARKET_COLUMNS)
    good = [("20260821", "A00001", "one", "10.50", ""), ("20260821", "A00002", "two", "0", "-")]
    assert [r.nav for r in feeds.daily_market(spark.createDataFrame(good, columns)).collect()] == [None, None]
    for bad, code in ((("20260821", "a00001", "x", "1", ""), "MARKET_SCHEMA"), (("20260821", "A00003", "x", "-1", ""), "MARKET_VALUE"), (("20260821", "A00003", "x", "01", ""), "MARKET_VALUE"), (good[0], "MARKET_DUPLICATE")):
        with pytest.raises(Refused, match=code):
            feeds.daily_market(spark.createDataFrame([*good, bad], columns))
    basics = spark.createDataFrame([("KR7005930003", "005930", "One", "O", "One Inc")], ", ".join(f"{c} string" for c in feeds.BASIC_COLUMNS))
    assert feeds.security_basics(basics, "KOSPI").first().isin == "KR7005930003"
    for rows, market in ((basics, "NASDAQ"), (basics.withColumn("ISU_SRT_CD", F.lit("59")), "KOSPI"), (basics.limit(0), "KOSPI")):
        with pytest.raises(Refused, match="BASICS_SCHEMA"):
            feeds.security_basics(rows, market)
    days = spark.createDataFrame([(dt.date(2026, 8, 20),), (DAY,), (dt.date(2026, 9, 1),)], "day date")
    assert feeds.latest_eligible(days, dt.date(2026, 8, 24)) == DAY
    with pytest.raises(Refused, match="NO_ELIGIBLE_DATE"):
        feeds.latest_eligible(days, dt.date(2020, 1, 1))


def test_fund_classes(spark):
    columns = ["Reporting File Number", "CIK Number", "Series ID", "Series Name", "Class ID", "Class Name", "Class Ticker"]
    table = lambda *rows: spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in columns))
    good = ("1", "12", "S1", "s", "C1", "c", "")
    assert [r.class_id for r in feeds.series_classes(table(good, ("",) * 7, ("No filters applied", *[""] * 6)), columns).collect()] == ["C1"]
    with pytest.raises(Refused, match="SERIES_SCHEMA"):
        feeds.series_classes(table(good, ("1", "12", "", "s", "C1", "c", "")), columns)


def test_publishers_weights(spark):
    forms = feeds.weight_formats(DAY, "005930", "KR7005930003", "One", "KR7", "ETFG")
    body = {
        "samsung": {"pdf": {"gijunYMD": "20260821", "totalCnt": 2, "list": [{"itmNo": "1", "ratio": "9"}, {"itmNo": "005930", "secNm": "One", "ratio": "20.11"}]}},
        "tiger": {"rtnData": [{"ksdFund": "KR7", "wkdate": "20260821", "memItemcode": " 005930 ", "code": "KR7005930003", "stockRate": 20.11}]},
        "plus": {"last": True, "totalElements": 1, "content": [{"wkdate": "20260821", "jmCd": "005930", "krJmCd": "KR7005930003", "ratio": "20.11"}]},
        "won": {"data": {"PDFList": [{"LAST_DATE": "2026.08.21", "FUND_CODE": "ETFG", "GUSEONG_CODE": "005930", "GUSEONG_NAME": "One", "BIJUNG": "20.11"}]}},
    }
    html = "<table><tr><th>1</th></tr><tr><td>1</td><td>KR7005930003</td><td> One </td><td>5</td><td>6</td><td><b>20.11</b></td></tr></table>"
    ask = lambda text, form: feeds.holder_weight(spark.createDataFrame([(1, text)], "response_id long, body string"), form).first()
    for name, form in forms.items():
        r = ask(html if name == "hanaro" else json.dumps(body[name]), form)
        assert (str(r.weight_pct).rstrip("0"), r.code) == ("20.11", None), name
    assert ask(json.dumps(body["samsung"]).replace('"totalCnt": 2', '"totalCnt": 3'), forms["samsung"]).code == "WEIGHTS_INCOMPLETE"
    assert ask(json.dumps(body["samsung"]).replace("20260821", "20260820"), forms["samsung"]).code == "WEIGHTS_RESPONSE"
    assert ask(json.dumps(body["tiger"]).replace("KR7\"", "KR8\""), forms["tiger"]).code == "WEIGHTS_IDENTITY"
    assert ask(json.dumps(body["won"]).replace("One", "Two"), forms["won"]).code == "WEIGHTS_SECURITY"
    assert ask(json.dumps(body["plus"]).replace("20.11", "101"), forms["plus"]).code == "WEIGHTS_VALUE"
    assert ask(None, forms["plus"]).code == ask("no json", forms["won"]).code == "WEIGHTS_RESPONSE"


def test_origins():
    for text in ("", "  a\t\nb ", "ＡＢＣ １２", "ﬁ½", "a　 b", "①위 " * 3):
        out, origins = normalize_with_origins(text)
        assert len(out) == len(origins) and all(0 <= a < b <= len(text) for a, b in origins)
        assert "  " not in out and all(x[0] <= y[0] for x, y in zip(origins, origins[1:], strict=False))
    assert normalize_with_origins(" ＡＢ \n c")[0] == " AB c" and normalize_with_origins("a \t b")[1] == [(0, 1), (1, 4), (4, 5)]


def test_claims(spark):
    rows = spark.createDataFrame([("t", "a", "x", "1", ["e1", "e9"]), ("t", "b", "x", None, ["e1"]), ("t", "c", "x", "2", ["e9"]), ("u", "a", "x", "1", ["e1"])], "task_id string, entity_id string, concept string, value string, evidence_ids array<string>")
    found = C.claims_of(rows, spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")).orderBy("task_id").collect()
    assert [(r.task_id, r.entity_id, r.evidence_ids) for r in found] == [("t", "a", ["e1"]), ("u", "a", ["e1"])] and found[0].claim_id != found[1].claim_id
    ledger = spark.createDataFrame([(r.claim_id, r.entity_id, r.concept, r.value, r.evidence_ids) for r in found], "claim_id string, entity_id string, concept string, value string, evidence_ids array<string>")
    a, b = (r.claim_id for r in found)
    verdicts = lambda *v: spark.createDataFrame([(a, v[0]), (b, v[1])], "claim_id string, verdict string")
    plan = lambda *ids: spark.createDataFrame(list(enumerate(ids, 1)), "position long, claim_id string")
    out = C.render(C.gate(plan(b, a), verdicts("VERIFIED", "VERIFIED"), ledger), spark.createDataFrame([("a", "Alpha")], "entity_id string, name string"))
    assert [r.line for r in out.collect()] == ["Alpha — x: 1 [e1]"] * 2
    for planned, v, known, code in ((plan(a, a), "VV", ledger, "DUPLICATE"), (plan(a, b), "VX", ledger, "NOT_RELEASEABLE"), (plan(a), "VV", ledger, "OMITTED"), (plan(a, b), "VV", ledger.limit(1), "NOT_IN_LEDGER")):
        with pytest.raises(Refused, match=code):
            C.gate(planned, verdicts(*[{"V": "VERIFIED", "X": "INELIGIBLE"}[x] for x in v]), known)


def test_runs(spark, tmp_path):
    log = runs.Runs(spark, f"file://{tmp_path}/runs", ("released_answer", "verification_report"))
    log.start("r1", "q", "v1")
    log.start("r1", "q", "v1")
    with pytest.raises(Refused, match="RUN_CONFLICT"):
        log.start("r1", "other", "v1")
    answer = {"text": "한", "n": 1}
    answer["response_hash"] = runs.digest(answer)
    name = log.append("r1", "released_answer", answer)
    assert log.append("r1", "released_answer", answer) == name and log.get("r1", "released_answer") == answer
    for call, code in (
        (lambda: log.append("r1", "released_answer", {"text": "x"}), "ARTIFACT_CONFLICT"), (lambda: log.append("r1", "odd", {}), "ARTIFACT_TYPE_UNKNOWN"), (lambda: log.append("r2", "released_answer", {}), "RUN_UNKNOWN"),
        (lambda: log.append("r1", "verification_report", {"x": 0.5}), "BINARY_FLOAT"), (lambda: log.get("r1", "verification_report"), "ARTIFACT_NOT_FOUND"), (lambda: log.finish("r9", "completed"), "RUN_UNKNOWN"), (lambda: log.finish("r1", "odd"), "RUN_STATE")):
        with pytest.raises(Refused, match=code):
            call()
    log.append("r1", "verification_report", {"status": "PASS"})
    assert log.cached("q", "v1", "s1") is None
    log.cache("r1", "q", "v1", "s1")
    log.cache("r1", "q", "v1", "s1")
    assert log.cached("q", "v1", "s1") == answer and log.artifacts().count() == 2
    log.finish("r1", "completed")
    with pytest.raises(Refused, match="RUN_FINISHED"):
        log.finish("r1", "failed")
    log.start("r2", "q", "v1")
    other = {"text": "another"}
    log.append("r2", "released_answer", other | {"response_hash": runs.digest(other)})
    log.append("r2", "verification_report", {"status": "FAIL"})
    with pytest.raises(Refused, match="RELEASE_NOT_VERIFIED"):
        log.cache("r2", "q", "v1", "s2")
    runs.write_report(spark, f"file://{tmp_path}/report", {"b": 1, "a": [1]})
    assert spark.read.text(f"file://{tmp_path}/report").first()[0] == '{"a":[1],"b":1}'
    with pytest.raises(Refused, match="REPORT_EXISTS"):
        runs.write_report(spark, f"file://{tmp_path}/report", {})


def test_contracts(spark):
    rows = spark.createDataFrame([("v1", 1)], "dataset_version string, n int")
    assert integrity.check_contract(rows, {"dataset_version": "string", "n": "int"}, {"dataset_version": "v1"}).count() == 1
    for columns, pins, code in (({"n": "int"}, {}, "COLUMN_SET"), ({"dataset_version": "string", "n": "bigint"}, {}, "COLUMN_SET"), ({"dataset_version": "string", "n": "int"}, {"dataset_version": "v2"}, "PIN_MISMATCH")):
        with pytest.raises(Refused, match=code):
            integrity.check_contract(rows, columns, pins)


def test_quads_escape(spark):
    row = spark.createDataFrame([('a "b"\\\n',)], "t string").select(graph.literal(F.col("t")).alias("t"), graph.literal(F.lit(1.5), "decimal").alias("n"), graph.node("urn:x/", F.lit("a b/ü")).alias("i")).first()
    assert row.t == '"a \\"b\\"\\\\\\n"' and row.n == '"1.5"^^<http://www.w3.org/2001/XMLSchema#decimal>' and row.i == "<urn:x/a%20b%2F%C3%BC>"


def test_documents(spark):
    chunks = spark.createDataFrame([(1, 1, "risk_factor", "위험 요인"), (1, 2, "fee", "위험 요인 투자위험"), (2, 3, "risk_factor", "주요 투자위험 위험 요인")], "doc_id long, chunk_id long, section_type string, text string")
    assert [r.chunk_id for r in retrieval.explain(chunks, "risk_factor").collect()] == [3, 1]
    with pytest.raises(Refused, match="TOPIC_UNKNOWN"):
        retrieval.explain(chunks, "weather")
    hits = lambda v: spark.createDataFrame([(1, 1, v)], "doc_id long, rank int, version string")
    retrieval.check_same_metadata({"a": hits("1"), "b": hits("1")}, ("doc_id",), ("version",))
    with pytest.raises(Refused, match="HIT_METADATA_DRIFT"):
        retrieval.check_same_metadata({"a": hits("1"), "b": hits("2")}, ("doc_id",), ("version",))


def test_lifecycle(spark, tmp_path):
    from ledgerloom.sources.sinks import COMPONENTS, Lifecycle

    d = Lifecycle(spark, f"file://{tmp_path}/d")
    d.create("v1", "h1", "2026-01-01")
    d.create("v2", "h2", "2026-01-02")
    assert d.state("v1") == "building"
    none = spark.range(0)
    for call, code in (
        (lambda: d.activate("v1"), "DATASET_NOT_VALIDATED"), (lambda: d.record_readiness("v1", "graph", "x"), "SUCCESSFUL_VALIDATION_REQUIRED"), (lambda: d.finish_validation("v1", "h2", [none]), "DATASET_MANIFEST_MISMATCH"), (lambda: d.state("v9"), "DATASET_NOT_FOUND")):
        with pytest.raises(Refused, match=code):
            call()
    assert d.finish_validation("v2", "h2", [none, spark.range(1)]) == d.state("v2") == "failed"
    assert d.finish_validation("v1", "h1", [none]) == "validated"
    for call, code in ((lambda: d.finish_validation("v1", "h1", [none]), "DATASET_NOT_BUILDING"), (lambda: d.activate("v1"), "READINESS_INCOMPLETE"), (lambda: d.record_readiness("v1", "odd", "x"), "COMPONENT_UNKNOWN"), (lambda: d.remove_building("v1"), "DATASET_NOT_BUILDING")):
        with pytest.raises(Refused, match=code):
            call()
    for c in COMPONENTS:
        d.record_readiness("v1", c, c)
    with pytest.raises(Refused, match="READINESS_CONFLICT"):
        d.record_readiness("v1", "graph", "other")
    d.activate("v1")
    d.activate("v1")
    assert (d.state("v1"), d.active()) == ("active", "v1")
    d.create("v3", "h3", "2026-01-03")
    d.require_building("v3")
    d.finish_validation("v3", "h3", [])
    for c in COMPONENTS:
        d.record_readiness("v3", c, c)
    d.activate("v3")
    assert (d.state("v1"), d.state("v3")) == ("retired", "active")
    with pytest.raises(Refused, match="DATASET_NOT_VALIDATED"):
        d.activate("v1")


def test_supplements_and_backups(spark, tmp_path):
    from ledgerloom.sources import files, sinks

    idents = spark.createDataFrame([("x", "e1"), ("y", "e2"), ("y", "e3"), ("x", "e1")], "identifier_value string, entity_id string")
    rows = lambda *v: spark.createDataFrame(list(v), "identifier_value string, day string, weight int")
    path = f"file://{tmp_path}/s"
    assert sinks.import_supplement(rows(("x", "a", 1)), idents, path, ["entity_id", "day"]) == 1
    assert sinks.import_supplement(rows(("x", "a", 1), ("x", "b", 2)), idents, path, ["entity_id", "day"]) == 1
    for bad, code in ((("z", "a", 1), "UNMATCHED"), (("y", "a", 1), "AMBIGUOUS"), (("x", "a", 9), "STORED_ROW_DRIFT")):
        with pytest.raises(Refused, match=code):
            sinks.import_supplement(rows(bad), idents, path, ["entity_id", "day"])
    assert spark.read.parquet(path).count() == 2
    assert files.restore(spark, f"file://{tmp_path}", {"s": (["day", "weight", "entity_id"], 2)})["s"].count() == 2
    with pytest.raises(Refused, match="RESTORE_MISMATCH"):
        files.restore(spark, f"file://{tmp_path}", {"s": (["day"], 2)})
    files.check_schema_sheet([files.SCHEMA_HEADER, [1, "a", "x"], [None, None], [2, "b", "x"]], ["a", "b"])
    with pytest.raises(Refused, match="SOURCE_SCHEMA_MISMATCH"):
        files.check_schema_sheet([files.SCHEMA_HEADER, [1, "b", "x"]], ["a", "b"])
