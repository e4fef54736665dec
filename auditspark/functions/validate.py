"""Validation, coercion and scores of extracted vouchers, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "N/A"
# Chinese numerals and units of amounts.
DIGITS = {"零": 0, "壹": 1, "贰": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "柒": 7, "捌": 8, "玖": 9, "貳": 2, "參": 3, "陸": 6}
UNITS = {"拾": 10, "佰": 100, "仟": 1000, "万": 10**4, "亿": 10**8, "萬": 10**4, "億": 10**8}


def missing(c: Column) -> Column:
    return c.isNull() | (c == MISSING)


def na_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(MISSING))


def safe(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def to_bool(c: Column) -> Column:
    """true, 1 and yes in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def valid_date(c: Column, as_of: Column) -> Column:
    """Missing, or a calendar date year-month-day that is not after as_of."""
    shaped = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return missing(c) | F.coalesce(F.when(shaped, F.try_to_date(c, "yyyy-M-d") <= as_of), F.lit(False))


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def chinese_amount(c: Column, mode: str = "correct") -> Column:
    """An amount as a double, from figures with at most two decimals or Chinese numerals; null if neither or not above zero.

    mode "correct" reads numerals by place value; "compat" multiplies all that was read so far by every unit.
    """
    s = F.trim(c)
    digits, units = _map(DIGITS), _map(UNITS)
    whole = F.regexp_extract(s, "^([^元圆圓]*)", 1)
    rest = F.regexp_extract(s, "[元圆圓](.*)$", 1)
    if mode != "compat":  # an amount below one yuan
        below = ~s.rlike("[元圆圓]") & s.rlike("[角分]")
        whole, rest = F.when(below, "").otherwise(whole), F.when(below, s).otherwise(rest)
    chars = F.regexp_extract_all(whole, F.lit("(?s)."), 0)
    if mode == "compat":
        step = lambda t, ch: F.when(F.try_element_at(digits, ch).isNotNull(), t + F.try_element_at(digits, ch)).when(F.try_element_at(units, ch).isNotNull(), F.greatest(t, F.lit(1)) * F.try_element_at(units, ch)).otherwise(t)
        yuan = F.aggregate(chars, F.lit(0).cast("long"), lambda t, ch: step(t, ch).cast("long"))
    else:
        # total of closed sections, the open section below ten thousand, and the digit in hand
        def place(t: Column, ch: Column) -> Column:
            d, u = F.try_element_at(digits, ch).cast("long"), F.try_element_at(units, ch).cast("long")
            small, large = u < 10**4, u >= 10**4
            section = t["section"] + t["digit"]
            total = F.when(u == 10**8, (t["total"] + section) * u).when(large, t["total"] + section * u).otherwise(t["total"])
            opened = F.when(large, F.lit(0)).when(small, t["section"] + F.greatest(t["digit"], F.lit(1)) * u).otherwise(t["section"])
            in_hand = F.when(d.isNotNull(), d).when(u.isNotNull(), F.lit(0)).otherwise(t["digit"])
            return F.struct(total.cast("long").alias("total"), opened.cast("long").alias("section"), in_hand.cast("long").alias("digit"))

        zero = F.lit(0).cast("long")
        yuan = F.aggregate(chars, F.struct(zero.alias("total"), zero.alias("section"), zero.alias("digit")), place, lambda t: t["total"] + t["section"] + t["digit"])
    part = lambda unit: F.coalesce(F.try_element_at(digits, F.nullif(F.regexp_extract(rest, f"(.){unit}", 1), F.lit(""))), F.lit(0))
    cents = yuan * 100 + part("角") * 10 + part("分")
    worded = F.when(cents > 0, cents / 100.0)
    return F.when(missing(c), None).when(s.rlike(r"^\d+(\.\d{1,2})?$"), F.round(s.try_cast("double"), 2)).otherwise(worded)


def valid_amount(c: Column) -> Column:
    """Missing, a figure from zero on with at most two decimals, or an amount in Chinese numerals."""
    s = F.trim(c)
    figure = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    fine = (~s.startswith("-") | (s.try_cast("double") == 0)) & s.rlike(r"^[+-]?\d*\.?\d{0,2}0*$")
    return missing(c) | F.when(figure, fine).otherwise(chinese_amount(c).isNotNull())


def valid_credit_code(c: Column) -> Column:
    return missing(c) | F.trim(c).rlike("^[0-9A-Z]{18}$")


def confidence(topic: Column, summary: Column, content: Column, n_sources: Column, category: Column) -> Column:
    """0.3, and more for each part that is there and long enough; between 0.15 and 0.95."""
    longer = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    points = ((longer(topic, 5), 0.2), (longer(summary, 10), 0.15), (longer(content, 150), 0.2), (F.coalesce(n_sources > 0, F.lit(False)), 0.1), (longer(category, 0), 0.05))
    total = reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0.0), points, F.lit(0.3))
    return F.least(F.lit(0.95), F.greatest(F.lit(0.15), F.round(total, 2)))


def quality_score(amount: Column, code: Column, date: Column, kind: Column, party: Column) -> Column:
    """Up to 100 points for the fields that are filled in."""
    filled = lambda c, *blank: F.coalesce(~c.isin(MISSING, "", "无", *blank), F.lit(False))
    points = ((filled(amount), 40), (filled(code), 20), (filled(date), 15), (filled(kind, "其他"), 15), (filled(party), 10))
    return reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), points, F.lit(0)).cast("double")


def count_filled(columns: list[Column]) -> Column:
    """How many of the columns are neither null nor missing."""
    return reduce(lambda a, c: a + F.when(missing(c), 0).otherwise(1), columns, F.lit(0))


def risk_label(c: Column) -> Column:
    return F.when(c == "高风险", "高").when(c == "中风险", "中").when(c == "低风险", "低").when(c.isNull() | (c == ""), "未知").otherwise(c)


def conclusion_label(c: Column) -> Column:
    return F.when(c.isin("人工复核", "需人工复核", "需人工"), "需人工").when(c.isNull() | (c == ""), "未知").otherwise(c)
