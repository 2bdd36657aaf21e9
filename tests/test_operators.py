"""Functions, sources, sinks, retrieval and dataflow operators on small inputs."""

from __future__ import annotations

import uuid
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import dataflow, retrieval
from ledgerloom.plans.errors import Refused
from ledgerloom.sources import files, sinks


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, " Ａ　 b ", T.normalize_name) == "A b"
    assert one(spark, "a b\tc", T.compact_upper) == "ABC"
    assert sorted(one(spark, "Cat!", T.padded_trigrams)) == sorted(["  c", " ca", "cat", "at "])
    assert one(spark, "abcd", T.code_point_trigrams) == ["abc", "bcd"] and one(spark, "ab", T.code_point_trigrams) == ["ab"]
    assert one(spark, " a, b ,,a", T.split_list) == ["a", "b"]
    assert one(spark, " 12.50 ", T.parse_decimal) == Decimal("12.5") and one(spark, "1e5", T.parse_decimal) is None and one(spark, "1e5", T.bad_decimal) and not one(spark, " ", T.bad_decimal)
    assert str(one(spark, "20260131", T.parse_yyyymmdd)) == "2026-01-31" and one(spark, "00000000", T.parse_yyyymmdd) is None and one(spark, "2026131", T.parse_yyyymmdd) is None
    assert one(spark, "y", T.parse_tristate) is True and one(spark, "?", T.parse_tristate) is None
    assert [one(spark, x, lambda c: T.classify_value(c, T.parse_decimal(c))) for x in ("", "N/A", "0", "3", None)] == ["missing", "placeholder", "zero", "present", "missing"]
    assert one(spark, "0", lambda c: T.classify_value(c, T.parse_decimal(c), zero_is_value=False)) == "unknown"
    assert [one(spark, Decimal(x), T.canonical_decimal, "decimal(38,12)") for x in ("1.500", "0.000", "-20")] == ["1.5", "0", "-20"]


def test_identifiers(spark):
    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    assert one(spark, "kind:source:키", lambda c: T.uuid5(ns.hex, c)) == str(uuid.uuid5(ns, "kind:source:키"))
    assert one(spark, "US0378331005", T.isin_valid) and not one(spark, "US0378331006", T.isin_valid)
    assert one(spark, "037833100", T.cusip_valid) and not one(spark, "037833101", T.cusip_valid)
    assert one(spark, "5493001KJTIIGC8Y1R12", T.lei_valid) and not one(spark, "5493001KJTIIGC8Y1R13", T.lei_valid)


def test_delimited_and_zip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("코드,이름\n1,가\n".encode("cp949"))
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.csv"), ["코드", "이름"], encoding="cp949").collect()] == [("1", "가")]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "b.csv"), ["a", "b"]).collect()] == [("1", "2")]
    with pytest.raises(Refused, match="HEADER_MISMATCH"):
        files.read_delimited(spark, str(tmp_path / "b.csv"), ["x"])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("T.tsv", "A\tB\n1\t2\n3\t4\n")
    assert files.read_zip_members(spark, str(tmp_path / "a.zip"), "T.tsv", ["A", "B"]).count() == 2
    (tmp_path / "a.json").write_text('{"Body": {"row": [{"D": "1"}, {"D": null}]}}')
    assert [r.D for r in files.read_json_rows(spark, str(tmp_path / "a.json"), "Body.row", ["D"]).collect()] == ["1", None]
    assert [tuple(r) for r in files.workbook_rows(spark, [["a", "b"], ["1"], ["2", "3"]], ["a", "b"], 2).collect()] == [("1", None), ("2", "3")]
    with pytest.raises(Refused, match="ROW_TOO_WIDE"):
        files.workbook_rows(spark, [["a"], ["1", "2"]], ["a"])


def test_quads_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("<g>", "<s>", "<p>", '"a b"@en')], "graph string, s string, p string, o string")
    files.write_quads(q, str(tmp_path / "q"))
    assert [tuple(r) for r in files.read_quads(spark, str(tmp_path / "q")).collect()] == [("<g>", "<s>", "<p>", '"a b"@en')]


def test_exact_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k int, v string")
    assert sinks.write_exact(rows((1, "a"), (1, "a"), (2, None)), path, ["k"]) == 2
    assert sinks.write_exact(rows((2, None), (3, "c")), path, ["k"]) == 1
    with pytest.raises(Refused, match="STORED_ROW_DRIFT"):
        sinks.write_exact(rows((3, "d")), path, ["k"])
    with pytest.raises(Refused, match="KEY_CONFLICT"):
        sinks.write_exact(rows((4, "a"), (4, "b")), path, ["k"])
    t = spark.read.parquet(path)
    assert sinks.table_hash(t) == sinks.table_hash(t.orderBy(F.desc("k"))) and sinks.ordered_hash(t, ["k"]) == sinks.ordered_hash(t.repartition(3), ["k"])


def test_datasets(spark, tmp_path):
    d = sinks.Datasets(spark, str(tmp_path / "d"))
    d.create("v1", "h", "2026-01-01")
    d.create("v1", "h", "2026-01-01")
    with pytest.raises(Refused, match="DATASET_DRIFT"):
        d.create("v1", "other", "2026-01-01")
    with pytest.raises(Refused, match="DATASET_INVALID"):
        d.activate("v1", [spark.range(1)])
    d.activate("v1", [spark.range(0)])
    assert d.active() == "v1"
    with pytest.raises(Refused, match="DATASET_ACTIVE"):
        d.remove_building("v1")


def test_rank_fusion_refuses_repeats(spark):
    hits = spark.createDataFrame([(1, 1), (1, 2)], "id int, rank int")
    with pytest.raises(Refused, match="DUPLICATE_HIT"):
        retrieval.rank_fusion({"a": hits}, ("id",))
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int"), spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert [r.id for r in retrieval.rank_fusion({"a": a, "b": b}, ("id",)).collect()] == [2, 1, 3]


def test_chunks_cover_the_text(spark):
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(250)) + "." for i in range(9))
    spans = retrieval.chunk_text(text)
    assert spans[0][0] == 0 and spans[-1][1] == 2250
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)) and all(b - a <= 800 for a, b in spans)
    assert retrieval.chunk_text("") == [] and retrieval.chunk_text("a b") == [(0, 2)]


def test_reconcile(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "chunk_id int, content_hash string")
    emb = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "a", [1.0]), (2, "x", [1.0, 2.0]), (9, "z", [1.0, 2.0])], "chunk_id int, content_hash string, embedding array<double>")
    assert tuple(retrieval.reconcile_embeddings(chunks, emb, 2).first()) == (1, 1, 1, 1, 1)


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 120) for i in range(120)]
    # a ring of 120, a chain of 70 from it to a pair, a node that is its own parent, a chain without a cycle
    edges = spark.createDataFrame([*ring, (119, 200), *[(i, i + 1) for i in range(200, 270)], (270, 269), (300, 300), (301, 300), (400, 401), (401, None)], "child int, parent int")
    assert sorted(r.node for r in dataflow.in_cycles(edges).collect()) == [*range(120), 269, 270, 300]
    assert dataflow.in_cycles(edges.limit(0)).count() == 0


def test_cycles_and_identities(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "child int, parent int")
    assert sorted(r.node for r in dataflow.in_cycles(edges).collect()) == [1, 2, 3]
    records = spark.createDataFrame([("a", "DomesticETF", "isin", "1"), ("b", "FundShareClass", "isin", "1"), ("c", "DomesticETF", "isin", "2"), ("d", "DomesticETF", "isin", "2"), ("e", "Bond", "isin", "3")], "record_id string, kind string, scheme string, value string")
    got = {r.record_id: (r.entity_id, r.resolution) for r in dataflow.resolve_identities(records).collect()}
    assert got == {"a": ("a", "MERGED"), "b": ("a", "MERGED"), "c": ("c", "AMBIGUOUS"), "d": ("d", "AMBIGUOUS"), "e": ("e", "SINGLE")}


def test_ceiling_weights_and_ends(spark):
    assert len(dataflow.ceiling(spark.range(5), 5)) == 5
    with pytest.raises(Refused, match="ROW_CEILING"):
        dataflow.ceiling(spark.range(6), 5)
    rel = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "relation_id string")
    w = spark.createDataFrame([("b", None), ("c", 50.0), ("c", None), ("d", 101.0)], "relation_id string, weight double")
    assert sorted(r[0] for r in dataflow.known_weight_relations(rel, w).collect()) == ["a", "c"]
    ends = spark.createDataFrame([("20200101",), ("",), ("soon",), (None,), ("20990101",)], "end string")
    assert dataflow.not_ended(ends, "end", F.to_date(F.lit("2026-01-01"))).count() == 4


def test_cycles_against_plain_search(spark):
    """Random graphs with chains, rings and crossings, loops, null ends and repeated edges."""
    import random

    r = random.Random(4)
    for n, m in ((5, 6), (30, 35), (40, 60), (60, 50)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + i, 1000 + (i + 1) % 37) for i in range(37)] + [(2000 + i, 2001 + i) for i in range(20)] + [(3000, 3000), (None, 1), (2, None), (1000, 1001)]
        after = {}
        for a, b in pairs:
            if a is not None and b is not None:
                after.setdefault(a, set()).add(b)
        want = set()
        for a in after:
            seen, todo = set(), list(after[a])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            want |= {a} & seen
        got = [x.node for x in dataflow.in_cycles(spark.createDataFrame(pairs, "child long, parent long")).collect()]
        assert sorted(got) == sorted(want)
    assert dataflow.in_cycles(spark.createDataFrame([], "child long, parent long")).count() == 0
