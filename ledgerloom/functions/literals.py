"""Literals and cues of requests, as Column expressions over text: amounts, shares, days, periods, ranks, limits, comparisons."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import Refused
from ..plans.model import AllOf, Atom

_NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
#: Counting words of a request and what they stand for.
NATIVE = {"한": 1, "하나": 1, "두": 2, "둘": 2, "세": 3, "셋": 3, "네": 4, "넷": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}
#: Comparison words, the operator of each, and that of its denial.
CUES = {"이하": ("lte", "gt"), "미만": ("lt", "gte"), "이상": ("gte", "lt"), "초과": ("gt", "lte")}
#: Credit grades at or above the one threshold that is known.
AT_LEAST = {"AA-": ("AAA", "AA+", "AA0", "AA-")}


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _plain(number: Column) -> Column:
    """Exact decimal text without grouping, exponent or trailing zeros."""
    t = F.regexp_replace(F.regexp_replace(number, ",", ""), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\.$", ""), r"^0+(?=\d)", "")


def amounts(text: Column) -> Column:
    """Won amounts in order, as exact decimals; those in 만원 count ten thousand each."""
    found = _all(text, rf"(?<![\d,.])(?:{_NUMBER})(?:만원|원)")
    number = lambda x: F.regexp_replace(x, "[^0-9.]", "").cast("decimal(30,8)")
    return F.transform(found, lambda x: F.when(x.endswith("만원"), number(x) * 10000).otherwise(number(x)).cast("decimal(38,8)"))


def percentages(text: Column) -> Column:
    """Shares in percent, as plain decimal text."""
    return F.transform(_all(text, rf"(?<![\d,.])({_NUMBER})%", 1), _plain)


def days(text: Column) -> Column:
    """Days written 2024-01-31 or 2024년 1월 31일, those of no calendar left out."""
    iso = F.transform(_all(text, r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"), lambda x: x.try_cast("date"))
    spelt = _all(text, r"(?<!\d)\d{4}년\s*\d{1,2}월\s*\d{1,2}일")
    parts = lambda x: F.regexp_replace(F.regexp_replace(x, r"[년월]\s*", "-"), "일", "")
    return F.filter(F.concat(iso, F.transform(spelt, lambda x: parts(x).try_cast("date"))), lambda x: x.isNotNull())


def periods(text: Column) -> Column:
    """Periods in years or months: P3Y, P6M."""
    return F.transform(_all(text, r"(?<!\d)\d+(?:개월|년(?!\s*\d{1,2}월))"), lambda x: F.concat(F.lit("P"), F.regexp_extract(x, r"\d+", 0), F.when(x.endswith("년"), "Y").otherwise("M")))


def ranks(text: Column) -> Column:
    return F.transform(_all(text, r"(?<!\d)(\d+)위", 1), lambda x: x.cast("int"))


def limits(text: Column) -> Column:
    """How many are asked for, in figures or in words."""
    figures = F.transform(_all(text, r"(?<!\d)(\d+)개(?!월)", 1), lambda x: x.cast("int"))
    words = "|".join(sorted(NATIVE, key=len, reverse=True))
    value = F.create_map(*[F.lit(y) for x in NATIVE.items() for y in x])
    spelt = F.transform(_all(text, rf"(?<![가-힣])({words})\s*(?:개|종목|상품(?!군)|자리)", 1), lambda x: value[x])
    return F.concat(figures, spelt)


def comparison(text: Column) -> Column:
    """Operator of the first comparison word, turned around where it is denied (이하가 아닌); between for 사이 and 부터 .. 까지; not_in for 제외."""
    word = F.regexp_extract(text, "(이하|미만|이상|초과)", 1)
    denied = text.rlike(r"(이하|미만|이상|초과)\s*(?:이|가)?\s*아닌")
    out = F.when(text.rlike(r"사이|부터\s*.*?까지"), "between")
    for cue, (plain, turned) in CUES.items():
        out = out.when((word == cue) & denied, turned).when(word == cue, plain)
    return out.when(text.rlike("제외"), "not_in")


def credit_grade(text: Column) -> Column:
    """The first credit grade; AA alone is AA0."""
    found = F.regexp_extract(text, r"(?<![A-Za-z0-9])(AAA|AA[+0-]?)(?![A-Za-z0-9+-])", 1)
    return F.when(found == "AA", "AA0").when(found != "", found)


def credit_at_least(concept: str, grade: str) -> Atom:
    """A threshold on grades as a set of them; thresholds that are not known are refused."""
    if grade not in AT_LEAST:
        raise Refused("CREDIT_THRESHOLD_UNKNOWN", grade)
    return Atom(concept, "in", AT_LEAST[grade])


def saleable(cutoff: dt.date, maturity: str = "maturity", remaining: str = "remaining_days") -> AllOf:
    """What can still be bought on the cutoff: it matures later, and days remain."""
    return AllOf((Atom(maturity, "gt", (cutoff,)), Atom(remaining, "gt", (Decimal(0),))))


def iri(base: str, *parts: Column) -> Column:
    """base and the parts, each percent-encoded with all but letters, digits and -._~, joined by slashes."""
    safe = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(base), F.concat_ws("/", *[safe(p) for p in parts]))


def valid_tagged(json: Column) -> Column:
    """Whether JSON text is a tagged value: {"type", "value"} of a scalar that its type can be, or a tuple of such {"type", "items"}.

    Integers are numbers without sign of plus, fraction or leading zeros; decimals are text without trailing zeros.
    """
    def scalar(v: Column) -> Column:
        keys = F.json_object_keys(v)
        raw = F.get_json_object(v, "$.value")
        typed = F.schema_of_variant(F.try_parse_json(v))
        has = lambda kind: F.contains(typed, F.lit(f"value: {kind}"))
        kind = F.get_json_object(v, "$.type")
        text = has("STRING")
        return (F.size(keys) == 2) & F.array_contains(keys, "value") & F.array_contains(keys, "type") & (
            F.when(kind == "null", has("VOID")).when(kind == "string", text).when(kind == "boolean", has("BOOLEAN"))
            .when(kind == "integer", ~text & ~has("BOOLEAN") & raw.rlike(r"^(0|-?[1-9][0-9]*)$"))
            .when(kind == "decimal", text & raw.rlike(r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\.[0-9]*[1-9])$"))
            .when(kind == "date", text & raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & raw.try_cast("date").isNotNull())
            .when(kind == "datetime", text & raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{6})?Z$") & ~raw.rlike(r"\.000000Z$") & raw.try_cast("timestamp").isNotNull())
            .otherwise(False))

    items = F.transform(F.from_json(F.get_json_object(json, "$.items"), "array<string>"), lambda x: scalar(x))
    keys = F.json_object_keys(json)
    several = (F.size(keys) == 2) & F.array_contains(keys, "items") & F.coalesce(F.forall(items, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return F.coalesce(F.when(F.get_json_object(json, "$.type") == "tuple", several).otherwise(scalar(json)), F.lit(False))
