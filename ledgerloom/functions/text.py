"""Text and value functions, JVM-side but for Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _nfkc(c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()))

    return F.pandas_udf(run, "string")(c)


def normalize_name(c: Column, ascii_only: bool = False) -> Column:
    """NFKC with runs of white space as one space; ascii_only text needs no Python."""
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if ascii_only else _nfkc(c)


def compact_upper(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def same_but_spaces(a: Column, b: Column) -> Column:
    return F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))


def padded_trigrams(c: Column) -> Column:
    """Distinct trigrams of each lower-cased alphanumeric word, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    each = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(each, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def code_point_trigrams(c: Column) -> Column:
    """Distinct trigrams of the text as it is; shorter texts are their own only gram."""
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, 3))))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def millionths(similarity: Column) -> Column:
    return F.floor(similarity * 1_000_000).cast("int")


def excerpt(text: Column, keyword: str, before: int = 180, length: int = 1280) -> Column:
    """Text from `before` characters ahead of the first hit; null without one."""
    at = F.instr(text, keyword)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, text.substr(start, F.lit(length)))


def split_list(c: Column) -> Column:
    """Trimmed parts of a comma list, blanks dropped, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def parse_decimal(c: Column) -> Column:
    """Plain decimal text to decimal(38,12); blank is null; other text is null too (see bad_decimal)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.expr(f"try_cast(trim({_name(c)}) as decimal(38,12))"))


def bad_decimal(c: Column) -> Column:
    """Text that is neither blank nor a plain decimal: to be counted and refused."""
    t = F.trim(c)
    return F.coalesce((t != "") & ~t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), F.lit(False))


def parse_yyyymmdd(c: Column, sentinels: tuple[str, ...] = ("", "00000000", "99991231")) -> Column:
    t = F.trim(c)
    return F.when(~t.isin(*sentinels) & t.rlike(r"^\d{8}$"), F.expr(f"try_to_date(trim({_name(c)}), 'yyyyMMdd')"))


def parse_tristate(c: Column, true: tuple[str, ...] = ("Y",), false: tuple[str, ...] = ("N",)) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin(*true), True).when(t.isin(*false), False)


def classify_value(raw: Column, number: Column | None, missing: tuple[str, ...] = ("", "-"), placeholder: tuple[str, ...] = ("N/A",), zero_is_value: bool = True) -> Column:
    """Status of a raw cell: missing and placeholder markers first, then zero, then present."""
    t = F.trim(raw)
    out = F.when(raw.isNull() | t.isin(*missing), "missing").when(t.isin(*placeholder), "placeholder")
    if number is not None:
        out = out.when((number == 0) & F.lit("0" in placeholder), "placeholder").when(number == 0, "zero" if zero_is_value else "unknown")
    return out.otherwise("present")


def _name(c: Column) -> str:
    """The text of a plain column reference."""
    return c._jc.toString() if hasattr(c, "_jc") else str(c)  # noqa: SLF001


def local_date(ts: Column, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def canonical_decimal(c: Column) -> Column:
    """No exponent, no trailing zeros, 0 for zero."""
    t = c.cast("decimal(38,12)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c.cast("decimal(38,12)") == 0, "0").otherwise(F.when(t.rlike("E"), F.format_string("%.12f", c.cast("double"))).otherwise(plain))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def _digits(c: Column) -> Column:
    """Letters as 10 to 35, digits as they are, one after another."""
    each = F.transform(F.split(F.upper(c), ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x))
    return F.array_join(each, "")


def isin_valid(c: Column) -> Column:
    """Twelve characters whose Luhn sum over letters as numbers is a multiple of ten."""
    d = F.reverse(F.split(_digits(c), ""))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") >= 5, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return F.coalesce(c.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & (total % 10 == 0), F.lit(False))


def cusip_valid(c: Column) -> Column:
    """Nine characters; every second value doubles, values' digits are summed, the last is the check digit."""
    v = F.transform(F.split(F.substring(c, 1, 8), ""), lambda x, i: F.when(x.rlike("[0-9]"), x.cast("int")).when(x.rlike("[A-Z]"), F.ascii(x) - 55).when(x == "*", 36).when(x == "@", 37).otherwise(38) * (1 + i % 2))
    total = F.aggregate(v, F.lit(0), lambda a, b: a + F.floor(b / 10).cast("int") + (b % 10).cast("int"))
    return F.coalesce(c.rlike(r"^[A-Z0-9*@#]{8}[0-9]$") & ((10 - total % 10) % 10 == F.substring(c, 9, 1).cast("int")), F.lit(False))


def lei_valid(c: Column) -> Column:
    """Twenty characters whose number, letters as 10 to 35, leaves 1 modulo 97."""
    rest = F.aggregate(F.transform(F.split(_digits(c), ""), lambda x: x.cast("int")), F.lit(0), lambda a, b: (a * 10 + F.coalesce(b, F.lit(0))) % 97)
    return F.coalesce(c.rlike(r"^[A-Z0-9]{18}[0-9]{2}$") & (rest == 1), F.lit(False))


def normalize_with_origins(text: str) -> tuple[str, list[tuple[int, int]]]:
    """A question's text under NFKC sign by sign, runs of white space as one space; and where each sign stood."""
    signs: list[str] = []
    origins: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        for n in unicodedata.normalize("NFKC", c):
            if not n.isspace():
                signs.append(n)
                origins.append((i, i + 1))
            elif signs and signs[-1] == " " and origins[-1][1] >= i:
                origins[-1] = (origins[-1][0], i + 1)
            else:
                signs.append(" ")
                origins.append((i, i + 1))
    return "".join(signs), origins


def applicable_date(*candidates: Column) -> Column:
    """The first of a column group's days that is there and a day: yyyyMMdd text, the markers of no day left out."""
    return F.coalesce(*[F.when(~F.trim(c).isin("", "00000000", "99991231") & F.trim(c).rlike(r"^\d{8}$"), F.call_function("try_to_date", F.trim(c), F.lit("yyyyMMdd"))) for c in candidates])


def cutoff_status(ts: Column, cutoff: Column, zone: str = "UTC") -> Column:
    """eligible up to the end of the cutoff day in `zone`, then late; unknown without a time.

    Evidence is dated in UTC, documents and claims in Asia/Seoul: in the nine hours before midnight UTC they disagree.
    """
    day = local_date(ts, zone)
    return F.when(day.isNull(), "unknown").when(day <= cutoff, "eligible").otherwise("late")
