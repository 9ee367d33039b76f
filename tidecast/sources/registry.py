"""What distinguishes the segments: filter, model settings, holiday calendar, stages, dates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Labels:
    """How a data set spells the regions, countries and organisations the segments refer to."""

    apac: str
    china: str
    north_america: str
    united_states: str
    canada: str
    emea: str
    united_kingdom: str
    netherlands: str
    latam: str
    brazil: str
    unspecified: str
    org_a: str
    org_b: str

    def spell(self, field: str | None) -> str | None:
        return None if field is None else getattr(self, field)


@dataclass(frozen=True)
class Dates:
    """Literal dates of a data set: history bounds, last scored day, fixed back-test cutoffs."""

    since: dt.date
    until: dt.date
    scored_to: dt.date
    cutoffs: tuple[dt.date, ...]
    years: tuple[int, ...]


def export_labels(org_a: str, org_b: str) -> Labels:
    """Spelling of the ticket exports. The two organisations are the caller's to name."""
    # Must equal the labels in the exported data.
    return Labels(
        apac="APAC (Geographic)",
        china="China (Geographic)",
        north_america="North America (Geographic)",
        united_states="United States of America (Geographic)",
        canada="Canada (Geographic)",
        emea="EMEA (Geographic)",
        united_kingdom="United Kingdom (Geographic)",
        netherlands="Netherlands (Geographic)",
        latam="LATAM (Geographic)",
        brazil="Brazil (Geographic)",
        unspecified="Unspecified",
        org_a=org_a,
        org_b=org_b,
    )


# Date bounds of the ticket exports.
EXPORT_DATES = Dates(
    since=dt.date(2022, 1, 1),
    until=dt.date(2024, 6, 1),
    scored_to=dt.date(2024, 5, 31),
    cutoffs=(dt.date(2024, 3, 1), dt.date(2024, 1, 1), dt.date(2023, 10, 1)),
    years=(2022, 2023, 2024),
)

# Stand-ins for the labels and dates in the star-schema test tables.
STAR_LABELS = Labels(
    apac="ASIA",
    china="NATION_2",
    north_america="AMERICA",
    united_states="NATION_1",
    canada="NATION_6",
    emea="EUROPE",
    united_kingdom="NATION_3",
    netherlands="NATION_8",
    latam="AFRICA",
    brazil="NATION_0",
    unspecified="MIDDLE EAST",
    org_a="BUILDING",
    org_b="MACHINERY",
)
STAR_DATES = Dates(
    since=dt.date(1995, 1, 1),
    until=dt.date(2001, 6, 1),
    scored_to=dt.date(2001, 5, 31),
    cutoffs=(dt.date(2001, 3, 1), dt.date(2001, 1, 1), dt.date(2000, 10, 1)),
    years=(1995, 1996, 1997, 1998, 1999, 2000, 2001),
)


@dataclass(frozen=True)
class Segment:
    name: str
    level1: str | None
    level2: str | None
    not_level2: str | None
    org: str | None
    by_ds: bool
    cps: float
    sps: float
    mode: str
    country: str
    tuner_country: str
    exported: bool
    cv_initial: bool
    cv_30_days: bool
    grid: bool
    trials: int


# One row per segment. Columns: name, region, country, excluded country, organisation,
# one row per date, changepoint scale, seasonality scale, mode, holiday calendar, the tuner's, exported,
# generated cutoffs, 30-day RMSE grid, MAPE grid, search trials.
SEGMENTS = (
    Segment("emea_uk", None, "united_kingdom", None, None, True, 0.01, 8.0, "multiplicative", "UK", "US", True, True, False, True, 500),
    Segment("north_us", None, "united_states", None, None, True, 1.0, 6.0, "multiplicative", "US", "US", True, True, False, True, 500),
    Segment("north_no_us", None, "canada", None, None, True, 0.59, 3.0, "multiplicative", "CA", "CA", True, True, False, False, 100),
    Segment("apac_china", None, "china", None, None, True, 0.065, 5.0, "multiplicative", "CN", "US", True, True, True, True, 500),
    Segment("apac_no_china", "apac", None, "china", None, True, 0.935, 1.5, "multiplicative", "CN", "US", True, False, False, False, 100),
    Segment("emea_no_uk", "emea", None, "united_kingdom", None, True, 0.95, 6.5, "multiplicative", "CN", "US", True, False, False, False, 100),
    Segment("brazil", None, "brazil", None, None, True, 1.0, 1.5, "multiplicative", "IE", "US", True, True, False, True, 500),
    Segment("latam_no_brazil", "latam", None, "brazil", None, True, 0.95, 6.5, "multiplicative", "CN", "US", True, True, True, False, 100),
    Segment("netherlands", None, "netherlands", None, None, True, 0.5, 9.0, "multiplicative", "NL", "US", True, True, False, True, 500),
    Segment("org_a", None, None, None, "org_a", True, 0.05, 10.0, "additive", "US", "US", False, False, False, False, 0),
    Segment("org_a_apac", "apac", None, None, None, False, 0.08, 9.0, "multiplicative", "CN", "US", False, False, False, False, 500),
    Segment("org_a_emea", "emea", None, None, "org_a", False, 0.01, 4.5, "additive", "UK", "US", False, False, False, False, 500),
    Segment("org_a_latam", "latam", None, None, None, False, 0.98, 6.5, "multiplicative", "BR", "US", False, False, False, False, 100),
    Segment("org_a_north", "north_america", None, None, "org_a", False, 1.0, 8.0, "multiplicative", "US", "US", False, False, False, False, 500),
    Segment("org_b", None, None, None, "org_b", True, 0.05, 10.0, "additive", "US", "US", False, False, False, False, 0),
    Segment("org_b_emea", "emea", None, None, "org_b", False, 0.325, 9.5, "multiplicative", "UK", "US", False, False, False, False, 500),
    Segment("org_b_north", "north_america", None, None, "org_b", False, 0.5, 2.5, "multiplicative", "US", "US", False, False, False, False, 500),
)

# Tuning grid and search space.
GRID_CPS = (0.001, 0.01, 0.1, 0.5)
GRID_SPS = (0.01, 0.1, 1.0, 10.0)
SEARCH_CPS = (0.01, 1.0, 0.005)
SEARCH_SPS = (0.5, 10.0, 0.5)
SEARCH_MODES = ("multiplicative", "additive")

# Outlier corrections (series, day, corrected volume), on the test data's calendar.
STAR_OVERRIDES = (
    ("BUILDING", dt.date(2000, 9, 11), 1269.0),
    ("MACHINERY", dt.date(2001, 2, 2), 200.0),
)


def exported_names() -> list[str]:
    return [s.name for s in SEGMENTS if s.exported]


def membership(segment: Segment, labels: Labels) -> Column:
    """Row predicate of a segment. The exclusion keeps rows without a country."""
    tests = []
    if segment.level1:
        tests.append(F.col("level1") == F.lit(labels.spell(segment.level1)))
    if segment.level2:
        tests.append(F.col("level2") == F.lit(labels.spell(segment.level2)))
    if segment.not_level2:
        tests.append(~F.col("level2").eqNullSafe(F.lit(labels.spell(segment.not_level2))))
    if segment.org:
        tests.append(F.col("organization_flag") == F.lit(labels.spell(segment.org)))
    return reduce(lambda a, b: a & b, tests)


def setting_of(column: str, segments=SEGMENTS, key: str = "segment") -> Column:
    """Registry column as an expression on the segment name: no join for a handful of rows."""
    if column not in {f.name for f in fields(Segment)}:
        raise KeyError(column)
    pairs = [F.lit(v) for s in segments for v in (s.name, getattr(s, column))]
    return F.element_at(F.create_map(*pairs), F.col(key))
