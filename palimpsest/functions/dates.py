"""Civil dates on a day axis that knows no year limits: day 1 is 0001-01-01, years are astronomical."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Precisions, finest first.  Fixed order.
PRECISIONS = ["day", "month", "year", "decade", "century", "millennium"]


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("long")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once instead of wherever ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def civil(day: Column) -> Column:
    """struct<y, m, d> of a day number, by the 400-year cycle that starts in March."""

    def of_cycle(e):
        doe = e["z"] - e["era"] * 146097
        yoe = _div(doe - _div(doe, 1460) + _div(doe, 36524) - _div(doe, 146096), 365)
        return F.struct(e["era"].alias("era"), doe.alias("doe"), yoe.alias("yoe"))

    def of_year(e):
        doy = e["doe"] - (e["yoe"] * 365 + _div(e["yoe"], 4) - _div(e["yoe"], 100))
        return F.struct((e["yoe"] + e["era"] * 400).alias("y"), doy.alias("doy"), _div(doy * 5 + 2, 153).alias("mp"))

    def of_month(e):
        month = F.when(e["mp"] < 10, e["mp"] + 3).otherwise(e["mp"] - 9)
        return F.struct((e["y"] + (e["mp"] >= 10).cast("long")).alias("y"), month.alias("m"), (e["doy"] - _div(e["mp"] * 153 + 2, 5) + 1).alias("d"))

    z = day.cast("long") + 305
    return _let(_let(_let(F.struct(z.alias("z"), _div(z, 146097).alias("era")), of_cycle), of_year), of_month)


def day_number(year: Column, month: Column, dom: Column) -> Column:
    """Day number of a civil date; months outside 1 to 12 aren't accepted."""

    def count(e):
        yoe = e["y"] - _div(e["y"], 400) * 400
        doy = _div(F.when(e["m"] > 2, e["m"] - 3).otherwise(e["m"] + 9) * 153 + 2, 5) + e["d"] - 1
        return _div(e["y"], 400) * 146097 + yoe * 365 + _div(yoe, 4) - _div(yoe, 100) + doy - 305

    def shift(e):
        return F.struct((e["y"] - (e["m"] <= 2).cast("long")).alias("y"), e["m"].alias("m"), e["d"].alias("d"))

    return _let(_let(F.struct(year.cast("long").alias("y"), month.alias("m"), dom.alias("d")), shift), count)


def _first_year(year: Column, precision: Column) -> Column:
    return F.when(precision <= 2, year).when(precision == 3, _div(year, 10) * 10).when(precision == 4, _div(year - 1, 100) * 100 + 1).otherwise(_div(year - 1, 1000) * 1000 + 1)


def snap_date(day: Column, precision: Column) -> Column:
    """First day of the period of ``precision`` (0 day to 5 millennium) that holds ``day``; centuries begin in year 1."""
    first = _let(civil(day), lambda c: day_number(F.when(precision == 1, c["y"]).otherwise(_first_year(c["y"], precision)), F.when(precision == 1, c["m"]).otherwise(1), F.lit(1)))
    return F.when(precision == 0, day.cast("long")).otherwise(first)


def period_end(day: Column, precision: Column) -> Column:
    """Last day of that period."""
    years = F.when(precision == 2, 1).when(precision == 3, 10).when(precision == 4, 100).otherwise(1000)
    in_year = lambda c: (precision == 1) & (c["m"] < 12)
    after = _let(civil(day), lambda c: day_number(F.when(precision == 1, c["y"] + (c["m"] == 12).cast("long")).otherwise(_first_year(c["y"], precision) + years), F.when(in_year(c), c["m"] + 1).otherwise(1), F.lit(1)))
    return F.when(precision == 0, day.cast("long")).otherwise(after - 1)


def _low(x: Column) -> Column:
    return F.coalesce(x, F.lit(-(1 << 40)))


def _high(x: Column) -> Column:
    return F.coalesce(x, F.lit(1 << 40))


def date_overlaps(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """Whether two intervals share a day; null is an open end."""
    return (_low(alo) <= _high(bhi)) & (_low(blo) <= _high(ahi))


def date_meet(a: Column, b: Column) -> Column:
    """Intersections of two arrays of struct<lo, hi> (null: open), in order; an empty array is no date at all."""
    pair = lambda x, y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi"))
    all_pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: pair(x, y))))
    return F.array_sort(F.filter(all_pairs, lambda p: _low(p["lo"]) <= _high(p["hi"])), lambda p, q: F.when(_low(p["lo"]) < _low(q["lo"]), -1).when(_low(p["lo"]) > _low(q["lo"]), 1).otherwise(0))


def date_join(a: Column, b: Column) -> Column:
    """Union of two arrays of struct<lo: bigint, hi: bigint> with overlapping or adjacent intervals merged."""
    ordered = F.array_sort(F.concat(a, b), lambda p, q: F.when(_low(p["lo"]) < _low(q["lo"]), -1).when(_low(p["lo"]) > _low(q["lo"]), 1).otherwise(0))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def step(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["lo"].alias("lo"), F.when(last["hi"].isNull() | x["hi"].isNull(), F.lit(None).cast("long")).otherwise(F.greatest(last["hi"], x["hi"])).alias("hi"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        new = F.struct(x["lo"].cast("long").alias("lo"), x["hi"].cast("long").alias("hi"))
        return F.when(F.size(acc) == 0, F.array(new)).when(_low(x["lo"]) <= _high(last["hi"]) + 1, joined).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(ordered, none, step)


def parse_item_time(text: Column, precision: Column) -> Column:
    """struct<day, precision> of a dump time such as +1889-03-31T00:00:00Z with precision 6 to 11; else null.

    Year 0, dates that don't exist and other spellings give null.  Precision 6 is a millennium, 11 a day;
    months and days of zero count as one.
    """
    part = lambda k: F.regexp_extract(text, r"^([+-]\d{1,16})-(\d{2})-(\d{2})T00:00:00Z$", k)
    year = F.when(part(1) != "", part(1).cast("long"))
    month, dom = (F.greatest(part(k).cast("int"), F.lit(1)) for k in (2, 3))
    ours = F.lit(11) - precision
    # A historical year -n is the astronomical year 1 - n.
    astronomical = F.when(year < 0, year + 1).otherwise(year)
    leap = (F.pmod(astronomical, F.lit(4)) == 0) & ((F.pmod(astronomical, F.lit(100)) != 0) | (F.pmod(astronomical, F.lit(400)) == 0))
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    good = year.isNotNull() & (year != 0) & precision.between(6, 11) & (month <= 12) & (dom <= length)
    return F.when(good, F.struct(snap_date(day_number(astronomical, month, dom), ours).alias("day"), ours.cast("byte").alias("precision")))
