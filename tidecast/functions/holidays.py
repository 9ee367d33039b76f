"""Public holiday calendars generated from rules for any range of years."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.sources.files import literal_table

RULES = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("holiday", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("arg", T.IntegerType()),
        T.StructField("since", T.IntegerType()),
        T.StructField("until", T.IntegerType()),
    ]
)
ALWAYS = (1900, 2199)

# Country, holiday, kind of rule, month, day, argument, first and last year.
# fixed: that month and day. on_or_after: first weekday ``arg`` (0 = Monday) from that day on.
# easter: ``arg`` days after Easter Sunday. qingming: the solar term at the start of April.
# not_sunday: that day, or the Saturday before if it is a Sunday. friday_or_monday: that day if it is a Friday, else
# the first Monday from it on. Observed days, one rule per holiday: nearest gives a Friday for a Saturday and a Monday
# for a Sunday; monday gives the Monday after either; two_later, for Christmas Day and Boxing Day, gives Monday for a
# Saturday and Tuesday for a Sunday, as the other of the two has the Monday.
CALENDAR = (
    ("US", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("US", "Martin Luther King Jr. Day", "on_or_after", 1, 15, 0, 1986, 2199),
    ("US", "Washington's Birthday", "on_or_after", 2, 15, 0, *ALWAYS),
    ("US", "Memorial Day", "on_or_after", 5, 25, 0, *ALWAYS),
    ("US", "Juneteenth", "fixed", 6, 19, 0, 2021, 2199),
    ("US", "Independence Day", "fixed", 7, 4, 0, *ALWAYS),
    ("US", "Labor Day", "on_or_after", 9, 1, 0, *ALWAYS),
    ("US", "Columbus Day", "on_or_after", 10, 8, 0, *ALWAYS),
    ("US", "Veterans Day", "fixed", 11, 11, 0, *ALWAYS),
    ("US", "Thanksgiving", "on_or_after", 11, 22, 3, *ALWAYS),
    ("US", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("UK", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("UK", "Good Friday", "easter", 0, 0, -2, *ALWAYS),
    ("UK", "Easter Monday", "easter", 0, 0, 1, *ALWAYS),
    ("UK", "May Day", "on_or_after", 5, 1, 0, 1978, 1994),
    ("UK", "May Day", "fixed", 5, 8, 0, 1995, 1995),
    ("UK", "May Day", "on_or_after", 5, 1, 0, 1996, 2019),
    ("UK", "May Day", "fixed", 5, 8, 0, 2020, 2020),
    ("UK", "May Day", "on_or_after", 5, 1, 0, 2021, 2199),
    ("UK", "Spring Bank Holiday", "on_or_after", 5, 25, 0, 1971, 2001),
    ("UK", "Spring Bank Holiday", "fixed", 6, 4, 0, 2002, 2002),
    ("UK", "Spring Bank Holiday", "on_or_after", 5, 25, 0, 2003, 2011),
    ("UK", "Spring Bank Holiday", "fixed", 6, 4, 0, 2012, 2012),
    ("UK", "Spring Bank Holiday", "on_or_after", 5, 25, 0, 2013, 2021),
    ("UK", "Spring Bank Holiday", "fixed", 6, 2, 0, 2022, 2022),
    ("UK", "Spring Bank Holiday", "on_or_after", 5, 25, 0, 2023, 2199),
    ("UK", "Single Bank Holiday", "fixed", 12, 31, 0, 1999, 1999),
    ("UK", "Single Bank Holiday", "fixed", 6, 3, 0, 2002, 2002),
    ("UK", "Single Bank Holiday", "fixed", 4, 29, 0, 2011, 2011),
    ("UK", "Single Bank Holiday", "fixed", 6, 5, 0, 2012, 2012),
    ("UK", "Single Bank Holiday", "fixed", 6, 3, 0, 2022, 2022),
    ("UK", "Single Bank Holiday", "fixed", 9, 19, 0, 2022, 2022),
    ("UK", "Single Bank Holiday", "fixed", 5, 8, 0, 2023, 2023),
    ("UK", "Late Summer Bank Holiday", "on_or_after", 8, 25, 0, 1971, 2199),
    ("UK", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("UK", "Boxing Day", "fixed", 12, 26, 0, *ALWAYS),
    ("CA", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("CA", "Good Friday", "easter", 0, 0, -2, *ALWAYS),
    ("CA", "Victoria Day", "on_or_after", 5, 18, 0, *ALWAYS),
    ("CA", "Canada Day", "fixed", 7, 1, 0, *ALWAYS),
    ("CA", "Labour Day", "on_or_after", 9, 1, 0, *ALWAYS),
    ("CA", "Truth and Reconciliation Day", "fixed", 9, 30, 0, 2021, 2199),
    ("CA", "Thanksgiving", "on_or_after", 10, 8, 0, *ALWAYS),
    ("CA", "Remembrance Day", "fixed", 11, 11, 0, *ALWAYS),
    ("CA", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("CA", "Boxing Day", "fixed", 12, 26, 0, *ALWAYS),
    ("NL", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("NL", "Good Friday", "easter", 0, 0, -2, *ALWAYS),
    ("NL", "Easter Sunday", "easter", 0, 0, 0, *ALWAYS),
    ("NL", "Easter Monday", "easter", 0, 0, 1, *ALWAYS),
    ("NL", "Queen's Day", "not_sunday", 4, 30, 0, 1980, 2013),
    ("NL", "King's Day", "not_sunday", 4, 27, 0, 2014, 2199),
    ("NL", "Liberation Day", "fixed", 5, 5, 0, 1945, 2199),
    ("NL", "Ascension Day", "easter", 0, 0, 39, *ALWAYS),
    ("NL", "Whit Sunday", "easter", 0, 0, 49, *ALWAYS),
    ("NL", "Whit Monday", "easter", 0, 0, 50, *ALWAYS),
    ("NL", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("NL", "Second Day of Christmas", "fixed", 12, 26, 0, *ALWAYS),
    ("IE", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("IE", "Saint Brigid's Day", "friday_or_monday", 2, 1, 0, 2023, 2199),
    ("IE", "Saint Patrick's Day", "fixed", 3, 17, 0, *ALWAYS),
    ("IE", "Easter Monday", "easter", 0, 0, 1, *ALWAYS),
    ("IE", "May Day", "on_or_after", 5, 1, 0, 1994, 2199),
    ("IE", "June Bank Holiday", "on_or_after", 6, 1, 0, *ALWAYS),
    ("IE", "August Bank Holiday", "on_or_after", 8, 1, 0, *ALWAYS),
    ("IE", "October Bank Holiday", "on_or_after", 10, 25, 0, 1977, 2199),
    ("IE", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("IE", "Saint Stephen's Day", "fixed", 12, 26, 0, *ALWAYS),
    ("BR", "Universal Fraternization Day", "fixed", 1, 1, 0, *ALWAYS),
    ("BR", "Good Friday", "easter", 0, 0, -2, *ALWAYS),
    ("BR", "Tiradentes' Day", "fixed", 4, 21, 0, *ALWAYS),
    ("BR", "Workers' Day", "fixed", 5, 1, 0, *ALWAYS),
    ("BR", "Independence Day", "fixed", 9, 7, 0, *ALWAYS),
    ("BR", "Our Lady of Aparecida", "fixed", 10, 12, 0, 1980, 2199),
    ("BR", "All Souls' Day", "fixed", 11, 2, 0, *ALWAYS),
    ("BR", "Republic Proclamation Day", "fixed", 11, 15, 0, *ALWAYS),
    ("BR", "Black Consciousness Day", "fixed", 11, 20, 0, 2024, 2199),
    ("BR", "Christmas Day", "fixed", 12, 25, 0, *ALWAYS),
    ("CN", "New Year's Day", "fixed", 1, 1, 0, *ALWAYS),
    ("CN", "Tomb-Sweeping Day", "qingming", 4, 0, 0, 2008, 2099),
    ("CN", "Labor Day", "fixed", 5, 1, 0, *ALWAYS),
    ("CN", "Labor Day", "fixed", 5, 2, 0, 2000, 2007),
    ("CN", "Labor Day", "fixed", 5, 3, 0, 2000, 2007),
    ("CN", "National Day", "fixed", 10, 1, 0, *ALWAYS),
    ("CN", "National Day", "fixed", 10, 2, 0, 1999, 2199),
    ("CN", "National Day", "fixed", 10, 3, 0, 1999, 2199),
    ("US", "Day Observed", "nearest", 1, 1, 0, *ALWAYS),
    ("US", "Day Observed", "nearest", 6, 19, 0, 2021, 2199),
    ("US", "Day Observed", "nearest", 7, 4, 0, *ALWAYS),
    ("US", "Day Observed", "nearest", 11, 11, 0, 1978, 2199),
    ("US", "Day Observed", "nearest", 12, 25, 0, *ALWAYS),
    ("UK", "Day Observed", "monday", 1, 1, 0, *ALWAYS),
    ("UK", "Day Observed", "two_later", 12, 25, 0, *ALWAYS),
    ("UK", "Day Observed", "two_later", 12, 26, 0, *ALWAYS),
    ("CA", "Day Observed", "monday", 1, 1, 0, *ALWAYS),
    ("CA", "Day Observed", "monday", 7, 1, 0, *ALWAYS),
    ("CA", "Day Observed", "two_later", 12, 25, 0, *ALWAYS),
    ("CA", "Day Observed", "two_later", 12, 26, 0, *ALWAYS),
    ("IE", "Day Observed", "monday", 1, 1, 0, *ALWAYS),
    ("IE", "Day Observed", "monday", 3, 17, 0, *ALWAYS),
    ("IE", "Day Observed", "two_later", 12, 25, 0, *ALWAYS),
    ("IE", "Day Observed", "two_later", 12, 26, 0, *ALWAYS),
)

# First day of the Spring Festival, 1995 to 2050.
SPRING_FESTIVAL = (
    "1995-01-31 1996-02-19 1997-02-07 1998-01-28 1999-02-16 2000-02-05 2001-01-24 2002-02-12 2003-02-01 "
    "2004-01-22 2005-02-09 2006-01-29 2007-02-18 2008-02-07 2009-01-26 2010-02-14 2011-02-03 2012-01-23 "
    "2013-02-10 2014-01-31 2015-02-19 2016-02-08 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 "
    "2022-02-01 2023-01-22 2024-02-10 2025-01-29 2026-02-17 2027-02-06 2028-01-26 2029-02-13 2030-02-03 "
    "2031-01-23 2032-02-11 2033-01-31 2034-02-19 2035-02-08 2036-01-28 2037-02-15 2038-02-04 2039-01-24 "
    "2040-02-12 2041-02-01 2042-01-22 2043-02-10 2044-01-30 2045-02-17 2046-02-06 2047-01-26 2048-02-14 "
    "2049-02-02 2050-01-23"
)
# Dragon Boat and Mid-Autumn festivals, public holidays since 2008, to 2050.
DRAGON_BOAT = (
    "2008-06-08 2009-05-28 2010-06-16 2011-06-06 2012-06-23 2013-06-12 2014-06-02 2015-06-20 2016-06-09 "
    "2017-05-30 2018-06-18 2019-06-07 2020-06-25 2021-06-14 2022-06-03 2023-06-22 2024-06-10 2025-05-31 "
    "2026-06-19 2027-06-09 2028-05-28 2029-06-16 2030-06-05 "
    "2031-06-24 2032-06-12 2033-06-01 2034-06-20 2035-06-10 2036-05-30 2037-06-18 2038-06-07 2039-05-27 "
    "2040-06-14 2041-06-03 2042-06-22 2043-06-11 2044-05-31 2045-06-19 2046-06-08 2047-05-29 2048-06-15 "
    "2049-06-04 2050-06-23"
)
MID_AUTUMN = (
    "2008-09-14 2009-10-03 2010-09-22 2011-09-12 2012-09-30 2013-09-19 2014-09-08 2015-09-27 2016-09-15 "
    "2017-10-04 2018-09-24 2019-09-13 2020-10-01 2021-09-21 2022-09-10 2023-09-29 2024-09-17 2025-10-06 "
    "2026-09-25 2027-09-15 2028-10-03 2029-09-22 2030-09-12 "
    "2031-10-01 2032-09-19 2033-09-08 2034-09-27 2035-09-16 2036-10-04 2037-09-24 2038-09-13 2039-10-02 "
    "2040-09-20 2041-09-10 2042-09-28 2043-09-17 2044-10-05 2045-09-25 2046-09-15 2047-10-04 2048-09-22 "
    "2049-09-11 2050-09-30"
)


def lunar_rules() -> list[tuple]:
    """The listed festival days as one-year rules; the Spring Festival lasts three days."""
    rules = []
    for name, days, length in (
        ("Spring Festival", SPRING_FESTIVAL, 3),
        ("Dragon Boat Festival", DRAGON_BOAT, 1),
        ("Mid-Autumn Festival", MID_AUTUMN, 1),
    ):
        for text in days.split():
            for shift in range(length):
                day = dt.date.fromisoformat(text) + dt.timedelta(days=shift)
                rules.append(("CN", name, "fixed", day.month, day.day, 0, day.year, day.year))
    return rules


def all_rules() -> list[tuple]:
    return list(CALENDAR) + lunar_rules()


def holiday_names(country: str) -> list[str]:
    """Names of a country's holidays in A-Z order: the order of its model columns."""
    return sorted({rule[1] for rule in all_rules() if rule[0] == country})


COUNTRIES = tuple(sorted({rule[0] for rule in CALENDAR}))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter from the golden number, the solar and the lunar correction (Lilius and Clavius)."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / F.lit(b))

    golden = year % 19 + 1
    century = div(year, 100) + 1
    leap_fix = div(century * 3, 4) - 12
    moon_fix = div(century * 8 + 5, 25) - 5
    sunday = div(year * 5, 4) - leap_fix - 10
    raw_epact = F.pmod(golden * 11 + 20 + moon_fix - leap_fix, F.lit(30))
    late = ((raw_epact == 25) & (golden > 11)) | (raw_epact == 24)
    epact = raw_epact + F.when(late, 1).otherwise(0)
    full_moon = F.lit(44) - epact
    full_moon = full_moon + F.when(full_moon < 21, 30).otherwise(0)
    day_of_march = full_moon + 7 - (sunday + full_moon) % 7
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (day_of_march - 1).cast("int"))


#: Years in which all lunar festivals are listed.
LUNAR_YEARS = (1995, 2050)


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int, lunar: bool = True) -> DataFrame:
    """``country, ds, holiday`` for the given years: rules x years, a few hundred rows per decade.

    Years beyond the lists of lunar festivals are an error, as those days would be missing in silence;
    with ``lunar=False`` the caller says that no series needs them.
    """
    if lunar and (first_year < LUNAR_YEARS[0] or last_year > LUNAR_YEARS[1]):
        raise ValueError(f"lunar festivals are listed for {LUNAR_YEARS[0]} to {LUNAR_YEARS[1]} only, not {first_year} to {last_year}")
    rules = literal_table(spark, all_rules(), RULES)
    year = F.explode(F.sequence(F.greatest("since", F.lit(first_year)), F.least("until", F.lit(last_year))))
    live = rules.filter((F.col("since") <= last_year) & (F.col("until") >= first_year)).withColumn("year", year)
    anchor = F.make_date("year", "month", "day")
    to_weekday = F.pmod(F.col("arg") - F.weekday(anchor), F.lit(7))
    # Century constant and length of the solar year in the solar-term rule.
    solar_day = F.floor((F.col("year") % 100) * 0.2422 + 4.81) - F.floor((F.col("year") % 100) / 4)
    place = F.weekday(anchor)
    saturday, sunday = place == 5, place == 6
    nearest = F.when(saturday, F.date_sub(anchor, 1)).when(sunday, F.date_add(anchor, 1))
    monday = F.when(saturday, F.date_add(anchor, 2)).when(sunday, F.date_add(anchor, 1))
    two_later = F.when(saturday | sunday, F.date_add(anchor, 2))
    ds = (
        F.when(F.col("kind") == "fixed", anchor)
        .when(F.col("kind") == "nearest", nearest)
        .when(F.col("kind") == "monday", monday)
        .when(F.col("kind") == "two_later", two_later)
        .when(F.col("kind") == "not_sunday", F.when(sunday, F.date_sub(anchor, 1)).otherwise(anchor))
        .when(F.col("kind") == "friday_or_monday", F.when(place == 4, anchor).otherwise(F.date_add(anchor, to_weekday)))
        .when(F.col("kind") == "on_or_after", F.date_add(anchor, to_weekday))
        .when(F.col("kind") == "easter", F.date_add(easter_sunday(F.col("year")), F.col("arg")))
        .otherwise(F.make_date("year", "month", solar_day.cast("int")))
    )
    # an observed day exists only in the years in which the holiday falls on a weekend
    return live.select("country", ds.alias("ds"), "holiday").where("ds IS NOT NULL")


def holidays_by_day(calendar: DataFrame) -> DataFrame:
    """One row per country and holiday date with the names of that date."""
    return calendar.groupBy("country", "ds").agg(F.array_sort(F.collect_set("holiday")).alias("names"))


def holiday_columns(names: Column, country: Column) -> Column:
    """0/1 array with one place per holiday of the country, in the order of ``holiday_names``."""
    lists = F.create_map(
        *[part for c in COUNTRIES for part in (F.lit(c), F.array(*[F.lit(n) for n in holiday_names(c)]))]
    )
    day = F.coalesce(names, F.array().cast("array<string>"))
    return F.transform(
        F.element_at(lists, country), lambda name: F.array_contains(day, name).cast("int").cast("double")
    )
