"""Published feeds: rows of a response checked as a whole, one violation refusing all of it with the feed's code."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import Refused

_DECIMAL = r"^(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"


def refuse(rows: DataFrame, rules: list[tuple[str, Column]], keys: tuple[str, list[str]] | None = None) -> DataFrame:
    """The rows, if none breaks a rule; the first rule broken names the refusal.  A feed without rows breaks the first.

    rules: code and what must hold (unknown counts as broken); keys: code and the columns that no two rows may share.
    One pass sums the broken rows; keys are summed on their own.
    """
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(holds, F.lit(False))).alias(f"r{i}") for i, (_, holds) in enumerate(rules)]).first()
    if not counts.n:
        raise Refused(rules[0][0], "no rows")
    for i, (code, _) in enumerate(rules):
        if counts[f"r{i}"]:
            raise Refused(code, f"{counts[f'r{i}']} rows")
    if keys is not None and not rows.groupBy(*keys[1]).count().where("count > 1").isEmpty():
        raise Refused(keys[0], ",".join(keys[1]))
    return rows


def _filled(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c) != "")
    return out


def _day(c: str) -> Column:
    return F.col(c).rlike(r"^\d{8}$") & F.expr(f"try_to_date(`{c}`, 'yyyyMMdd')").isNotNull()


#: Columns of the feeds.
RATE_COLUMNS = ["STAT_CODE", "ITEM_CODE1", "ITEM_NAME1", "UNIT_NAME", "TIME", "DATA_VALUE"]
MARKET_COLUMNS = ["BAS_DD", "ISU_CD", "ISU_NM", "TDD_CLSPRC", "NAV"]
BASIC_COLUMNS = ["ISU_CD", "ISU_SRT_CD", "ISU_NM", "ISU_ABBRV", "ISU_ENG_NM"]
MARKETS = ("KOSPI", "KOSDAQ")


def exchange_rates(rows: DataFrame, items: dict[str, str], table: str = "731Y001", unit: str = "원") -> DataFrame:
    """item_code, day, rate of the approved items (code to name); other items' rows are left out, once they are well formed."""
    names = F.create_map(*[F.lit(x) for pair in items.items() for x in pair])
    known = F.col("ITEM_CODE1").isin(*items)
    refuse(rows, [("RATES_SCHEMA", _filled(RATE_COLUMNS) & (F.col("STAT_CODE") == table))])
    own = refuse(
        rows.where(known),
        [("RATES_SCHEMA", (F.col("ITEM_NAME1") == names[F.col("ITEM_CODE1")]) & (F.col("UNIT_NAME") == unit) & _day("TIME")), ("RATES_VALUE", F.col("DATA_VALUE").rlike(_DECIMAL) & (F.col("DATA_VALUE").try_cast("decimal(38,12)") > 0))],
        ("RATES_DUPLICATE", ["ITEM_CODE1", "TIME"]))
    if own.select("ITEM_CODE1").distinct().count() != len(items):
        raise Refused("RATES_COVERAGE")
    return own.select(F.col("ITEM_CODE1").alias("item_code"), F.to_date("TIME", "yyyyMMdd").alias("day"), F.col("DATA_VALUE").cast("decimal(38,12)").alias("rate"))


def daily_market(rows: DataFrame) -> DataFrame:
    """code, name, day, close, nav (null where it is blank or a dash) of each product and day."""
    blank = F.trim("NAV").isin("", "-")
    fine = lambda c: F.col(c).rlike(_DECIMAL)
    checked = refuse(rows, [("MARKET_SCHEMA", F.col("ISU_CD").rlike("^[A-Z0-9]{6}$") & (F.trim("ISU_NM") != "") & _day("BAS_DD")), ("MARKET_VALUE", fine("TDD_CLSPRC") & (blank | fine("NAV")))], ("MARKET_DUPLICATE", ["ISU_CD", "BAS_DD"]))
    return checked.select(F.col("ISU_CD").alias("code"), F.col("ISU_NM").alias("name"), F.to_date("BAS_DD", "yyyyMMdd").alias("day"), F.col("TDD_CLSPRC").cast("decimal(38,12)").alias("close"), F.when(~blank, F.col("NAV").try_cast("decimal(38,12)")).alias("nav"))


def security_basics(rows: DataFrame, market: str) -> DataFrame:
    """isin, code, name of a market's securities; only the two markets, twelve signs and six."""
    if market not in MARKETS:
        raise Refused("BASICS_SCHEMA", market)
    checked = refuse(rows, [("BASICS_SCHEMA", _filled(BASIC_COLUMNS) & F.col("ISU_CD").rlike("^[A-Z0-9]{12}$") & F.col("ISU_SRT_CD").rlike("^[A-Z0-9]{6}$"))])
    return checked.select(F.col("ISU_CD").alias("isin"), F.col("ISU_SRT_CD").alias("code"), F.col("ISU_NM").alias("name"), F.lit(market).alias("market"))


def series_classes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """cik, series_id, class_id, names and ticker of fund classes; blank rows and the report's line about filters are left out.

    columns: the report's columns in order, the first of which carries that line.
    """
    blank = F.coalesce(*[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", F.lit(False)) for c in columns], F.lit(True))
    note = (F.col(f"`{columns[0]}`") == "No filters applied") & F.coalesce(*[F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", F.lit(False)) for c in columns[1:]], F.lit(True))
    named = rows.where(~blank & ~F.coalesce(note, F.lit(False))).select(
        F.col("`CIK Number`").alias("cik"), F.col("`Series ID`").alias("series_id"), F.col("`Series Name`").alias("series_name"), F.col("`Class ID`").alias("class_id"), F.col("`Class Name`").alias("class_name"), F.col("`Class Ticker`").alias("ticker"))
    return refuse(named, [("SERIES_SCHEMA", _filled(["cik", "series_id", "class_id"]))])


def latest_eligible(dates: DataFrame, cutoff: dt.date, column: str = "day") -> dt.date:
    """The latest day up to the cutoff; refused where there is none."""
    found = dates.where(F.col(column) <= F.lit(cutoff)).agg(F.max(column)).first()[0]
    if found is None:
        raise Refused("NO_ELIGIBLE_DATE", str(cutoff))
    return found


@dataclass(frozen=True)
class WeightFormat:
    """Where a publisher's response has its rows, and what each must say: all of it as one JSON text, or as table rows."""

    publisher: str
    rows: str | None  # path of the array; None for HTML tables
    security: tuple[tuple[str, str], ...]  # fields that name the security, and their values
    weight: str
    every: tuple[tuple[str, str], ...] = ()  # fields that every row must hold, and their values
    whole: tuple[tuple[str, str], ...] = ()  # fields of the response itself, and their values
    count: str | None = None  # where the response says how many rows it has
    cells: int = 0


def holder_weight(responses: DataFrame, form: WeightFormat, text: str = "body", key: str = "response_id") -> DataFrame:
    """key, weight_pct, place and code of each response: the one security's reported weight, or why there is none.

    code: WEIGHTS_RESPONSE (not what the publisher sends), WEIGHTS_INCOMPLETE (another number of rows), WEIGHTS_IDENTITY
    (a row of another day or fund), WEIGHTS_SECURITY (not exactly one row), WEIGHTS_VALUE (no number from 0 to 100), else
    null.  Weights of different publishers are never compared: their denominators differ.
    """
    body = F.col(f"`{text}`")
    if form.rows is None:
        lines = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
        cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
        rows = F.transform(F.filter(F.transform(lines, cells), lambda c: F.size(c) == form.cells), lambda c: F.map_from_arrays(F.array(*[F.lit(str(i)) for i in range(form.cells)]), c))
    else:
        rows = F.from_json(F.get_json_object(body, f"$.{form.rows}"), "array<map<string,string>>")
    holds = lambda r, pairs: F.aggregate(F.array(*[F.coalesce(F.trim(r[n]) == v, F.lit(False)) for n, v in pairs] or [F.lit(True)]), F.lit(True), lambda a, b: a & b)
    own = F.filter(F.transform(F.col("rows"), lambda r, i: F.struct(r.alias("r"), i.alias("i"))), lambda x: holds(x["r"], form.security))
    whole = F.lit(True)
    for name, value in form.whole:
        whole = whole & F.coalesce(F.get_json_object(body, f"$.{name}") == value, F.lit(False))
    said = F.get_json_object(body, f"$.{form.count}").try_cast("int") if form.count else F.size("rows")
    weight = F.when(F.get(F.col("own"), F.lit(0))["r"][form.weight].rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), F.trim(F.get(F.col("own"), F.lit(0))["r"][form.weight]).try_cast("decimal(38,12)"))
    code = (
        F.when(F.col("rows").isNull() | (F.size("rows") == 0) | ~whole, "WEIGHTS_RESPONSE").when(~F.coalesce(said == F.size("rows"), F.lit(False)), "WEIGHTS_INCOMPLETE")
        .when(F.exists("rows", lambda r: ~holds(r, form.every)), "WEIGHTS_IDENTITY").when(F.size("own") != 1, "WEIGHTS_SECURITY").when(~F.coalesce(weight.between(0, 100), F.lit(False)), "WEIGHTS_VALUE"))
    found = responses.withColumn("rows", rows).withColumn("own", own).select(F.col(f"`{key}`").alias(key), code.alias("code"), weight.alias("w"), F.get(F.col("own"), F.lit(0))["i"].alias("i"))
    return found.select(key, F.when(F.col("code").isNull(), F.col("w")).alias("weight_pct"), F.when(F.col("code").isNull(), F.col("i")).alias("place"), "code")


def weight_formats(day: dt.date, code: str, isin: str, name: str, fund_isin: str, fund_code: str) -> dict[str, WeightFormat]:
    """The five publishers' formats for one security and day; field names are fixed values of their responses."""
    plain, dotted = day.strftime("%Y%m%d"), day.strftime("%Y.%m.%d")
    return {
        "samsung": WeightFormat("samsung", "pdf.list", (("itmNo", code), ("secNm", name)), "ratio", whole=(("pdf.gijunYMD", plain),), count="pdf.totalCnt"),
        "tiger": WeightFormat("tiger", "rtnData", (("memItemcode", code), ("code", isin)), "stockRate", every=(("ksdFund", fund_isin), ("wkdate", plain))),
        "plus": WeightFormat("plus", "content", (("jmCd", code), ("krJmCd", isin)), "ratio", every=(("wkdate", plain),), whole=(("last", "true"),), count="totalElements"),
        "hanaro": WeightFormat("hanaro", None, (("1", isin), ("2", name)), "5", cells=6),
        "won": WeightFormat("won", "data.PDFList", (("GUSEONG_CODE", code), ("GUSEONG_NAME", name)), "BIJUNG", every=(("LAST_DATE", dotted), ("FUND_CODE", fund_code))),
    }
