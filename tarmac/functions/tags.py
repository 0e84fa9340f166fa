"""Scalar rules: tag parsing, code tables, dates, rates, priority fills."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code tables and word lists that results depend on.
SEVERITY = {4: "K", 1: "A", 2: "B", 3: "C", 5: "O", 0: "UNK"}
LAND_USE = {
    "Single-Family Residential": "Residential",
    "Multi-Family Residential": "Residential",
    "Commercial": "Commercial",
    "Office": "Commercial",
    "Industrial": "Industrial",
    "Public & Institutional": "Institutional",
    "Park & Open Spaces": "Parks/Open",
    "Undeveloped": "Undeveloped",
    "Transportation & Utility": "Other",
    "Agriculture Production": "Other",
}
ROAD_CLASS = {"primary": "Major arterial", "secondary": "Arterial", "tertiary": "Collector", "residential": "Local street", "unclassified": "Minor street"}
LIMITED_ACCESS_NAME = "SOUTHWEST|NORTHWEST|NORTH FWY|FREEWAY|FWY|EASTEX|GULF|KATY|HARDY|US 59|US 290| 59 | 290 |IH|LOOP|610|HOV|TOLL|SAM HOUSTON|SER "
STREET_SUFFIXES = (" ROAD", " RD", " STREET", " ST", " DRIVE", " DR", " BOULEVARD", " BLVD", " AVENUE", " AVE", " LANE", " LN", " PARKWAY", " PKWY")
INCOME_EDGES = (50_000, 100_000, 150_000)
ECONOMIC_COST = {"k": 1_606_644, "a": 172_179, "b": 44_490, "c": 25_933, "o": 6_269}
COMPREHENSIVE_COST = {"k": 11_258_495, "a": 1_089_524, "b": 224_597, "c": 111_281, "o": 10_196}
FEET_A_METRE = 3.28084
SQUARE_METRES_A_SQUARE_MILE = 2_589_988
LIFE_YEARS = 75


def first_value(tags: Column) -> Column:
    """The first value of a list tag; null for an empty or null list."""
    return F.get(tags, 0)


def all_values(tags: Column) -> Column:
    """All values of a list tag, joined by |; null for a null list."""
    return F.when(tags.isNotNull(), F.array_join(tags, "|"))


def text_code(code: Column) -> Column:
    """A text code without the spaces around it; null stays null."""
    return F.trim(code)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def lanes(text: Column) -> Column:
    """The first of values separated by ;."""
    return _number(F.split(text, ";")[0])


def speed_mph(text: Column) -> Column:
    return _number(F.split(F.trim(F.replace(F.lower(text), F.lit("mph"), F.lit(""))), ";")[0])


def width_feet(text: Column) -> Column:
    """Feet if marked ft or ', else metres (marked m, or bare)."""
    t = F.lower(F.trim(text))
    feet = t.endswith("ft") | t.endswith("'")
    return F.when(feet, _number(F.trim(F.rtrim(t, F.lit("ft'"))))).when(t.endswith("m"), _number(F.trim(F.rtrim(t, F.lit("m")))) * FEET_A_METRE).otherwise(_number(t) * FEET_A_METRE)


def sidewalk_status(main: Column, both: Column, left: Column, right: Column) -> Column:
    """none, one_side, both, or null where nothing is tagged; earlier rules win."""
    no, yes = ["no", "none"], ["yes", "both", "left", "right", "separate"]
    is_in = lambda c, values: F.coalesce(c.isin(values), F.lit(False))
    return (
        F.when(is_in(main, ["both", "separate"]) | is_in(both, ["yes"]), "both")
        .when(is_in(main, ["left", "right"]), "one_side")
        .when(is_in(main, no) | is_in(both, ["no"]), "none")
        .when(is_in(left, yes) & is_in(right, yes), "both")
        .when(is_in(left, yes) | is_in(right, yes), "one_side")
        .when(is_in(left, no) & is_in(right, no), "none")
        .when(is_in(main, ["yes"]), "one_side")
    )


def _tagged(values: Iterable[Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def cycleway_status(*values: Column) -> Column:
    """none if all tags are negative, else the others sorted and joined by |; null where nothing is tagged."""
    tags = _tagged(values)
    others = F.array_except(tags, F.array(F.lit("no"), F.lit("none")))
    return F.when(F.size(tags) == 0, None).when(F.size(others) == 0, "none").otherwise(F.array_join(F.array_sort(others), "|"))


def parking_status(*values: Column) -> Column:
    tags = _tagged(values)
    others = F.array_except(tags, F.array(*map(F.lit, ("no", "no_parking", "no_stopping", "none"))))
    return F.when(F.size(tags) == 0, None).when(F.size(others) == 0, "none").otherwise("present")


def flag(text: Column, true: Sequence[str] = ("yes", "true", "1")) -> Column:
    """Null stays null."""
    return F.lower(text).isin(list(true))


def yes_no(value: Column) -> Column:
    return F.when(value, "yes").when(~value, "no")


def street_key(name: Column) -> Column:
    """Upper case, without street suffixes wherever they stand, trimmed; null gives the empty text."""
    out = F.upper(F.coalesce(name, F.lit("")))
    for suffix in STREET_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.trim(out)


def names_agree(a: Column, b: Column) -> Column:
    """Whether one street key holds the other; false if either name is null or empty."""
    x, y = street_key(a), street_key(b)
    named = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return named & (x.contains(y) | y.contains(x))


def padded_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}-%05d", number)


def geoid(state: Column, county: Column, tract: Column, group: Column) -> Column:
    return F.concat(state, county, tract, group)


def clock_hour(text: Column) -> Column:
    """Hour 0-23 of a time such as 07:45 PM; null where it is none."""
    return F.hour(F.try_to_timestamp(F.upper(F.trim(text)), F.lit("h:mm a")))


def day(text: Column) -> Column:
    return text.try_cast("date")


def year_of_millis(ms: Column) -> Column:
    return F.year(F.timestamp_millis(ms))


def coded(code: Column, table: Mapping, default: str | None) -> Column:
    """The text of a code by a literal table."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def severity_letter(code: Column) -> Column:
    return coded(code.cast("int"), SEVERITY, "UNK")


def land_use(group: Column) -> Column:
    return coded(group, LAND_USE, "Unknown")


def road_class(highway: Column) -> Column:
    """Friendly class; links and unknown classes are minor streets."""
    return F.when(highway.endswith("_link"), F.lit("Minor street")).otherwise(coded(highway, ROAD_CLASS, "Minor street"))


def travel_mode(ped: Column, bike: Column) -> Column:
    return F.when(ped, "pedestrian").when(bike, "bicycle").otherwise("motor vehicle")


def income_tier(income: Column, edges: Sequence[float] = INCOME_EDGES) -> Column:
    """0 below the first edge, and so on; an edge belongs to the tier above it; null stays null."""
    out = F.when(income.isNull(), None)
    for i, e in enumerate(edges):
        out = out.when(income < e, i)
    return out.otherwise(len(edges))


def years_lost(age: Column, until: int = LIFE_YEARS) -> Column:
    return F.greatest(F.lit(until) - age, F.lit(0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Null unless the whole is positive."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, digits))


def no_sentinel(value: Column) -> Column:
    """Negative codes for missing values as null."""
    return F.when(value >= 0, value)


def density_per_square_mile(people: Column, square_metres: Column) -> Column:
    return F.when(square_metres > 0, F.bround(people / (square_metres / SQUARE_METRES_A_SQUARE_MILE), 0))


def clamp(value: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def sidewalk_tolerance(width: Column) -> Column:
    """Half the roadway width and a setback, within bounds; 24 ft where the width is unknown."""
    return clamp(F.coalesce(width, F.lit(24.0)) / 2 + 25.0, 30.0, 60.0)


def side_class(left: Column, right: Column, share: float = 0.5) -> Column:
    hits = (left >= share).cast("int") + (right >= share).cast("int")
    return F.when(hits == 2, "both").when(hits == 1, "one_side").when(left + right == 0, "none").otherwise("partial")


def crash_cost(counts: Mapping[str, Column], costs: Mapping[str, int]) -> Column:
    """Persons hurt at each severity times the cost of one, added up."""
    terms = [F.coalesce(counts[k], F.lit(0)).cast("long") * F.lit(costs[k]).cast("long") for k in costs]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def fill_in_order(choices: Sequence[tuple[Column, Column, str]], default_source: str) -> tuple[Column, Column]:
    """The value of the first choice (condition, value, source) that holds and is not null, and its source."""
    value, source = F, F
    for condition, candidate, name in choices:
        holds = condition & candidate.isNotNull()
        value, source = value.when(holds, candidate), source.when(holds, F.lit(name))
    return value, source.otherwise(F.lit(default_source))


def agree_within(a: Column, b: Column, most: float = 1.0) -> Column:
    """True or false where both are known, else null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= most)


def on_limited_access(road_class_id: Column, part_id: Column, street: Column) -> Column:
    """Freeways and their parts: classes 1, 6, 8, 9; parts 2 to 5; class 2 where the street's name is a freeway's."""
    return (
        F.coalesce(road_class_id.isin(1, 6, 8, 9), F.lit(False))
        | F.coalesce(part_id.isin(2, 3, 4, 5), F.lit(False))
        | F.coalesce((road_class_id == 2) & F.coalesce(street, F.lit("")).rlike(f"(?i){LIMITED_ACCESS_NAME}"), F.lit(False))
    )


def class_break(value: Column, breaks: Sequence[float]) -> Column:
    """How many breaks a value reaches."""
    out = F.lit(0)
    for b in breaks:
        out = out + (value >= b).cast("int")
    return out
