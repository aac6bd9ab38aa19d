"""Column functions over rule values, severities, zones and request fields.

A rule value is dynamically typed. It is carried as ``struct<num double, bool boolean,
json string>`` with at most one member set; ``json`` holds conditional objects and text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions.text import lookup

FEET_PER_METER = 1.0 / 0.3048
METERS_PER_FOOT = 0.3048
SQFT_PER_SQM = FEET_PER_METER**2
SQM_PER_SQFT = METERS_PER_FOOT**2
SQFT_PER_SQM_BULK = 10.7639104167  # fixed value of the bulk parcel load
SQFT_PER_SQM_ONDEMAND = 10.76391  # fixed value of the on-demand parcel load


def feet_to_meters(c: Column) -> Column:
    return c * METERS_PER_FOOT


def meters_to_feet(c: Column) -> Column:
    return c * FEET_PER_METER


def sqm_to_sqft(c: Column) -> Column:
    return c * SQFT_PER_SQM


def sqft_to_sqm(c: Column) -> Column:
    return c * SQM_PER_SQFT


def uniform_inset_ft(side: Column, rear: Column, front: Column) -> Column:
    """Largest known setback, 4 ft where none is known."""
    return F.coalesce(F.greatest(side, rear, front), F.lit(4.0))


def value(num: Column | None = None, bool_: Column | None = None, json: Column | None = None) -> Column:
    """Tagged rule value."""
    null = F.lit(None)
    return F.struct(
        (null if num is None else num).cast("double").alias("num"),
        (null if bool_ is None else bool_).cast("boolean").alias("bool"),
        (null if json is None else json).cast("string").alias("json"),
    )


def value_is_null(v: Column) -> Column:
    return v["num"].isNull() & v["bool"].isNull() & v["json"].isNull()


def value_text(v: Column) -> Column:
    """JSON text of a value."""
    return F.coalesce(v["num"].cast("string"), v["bool"].cast("string"), v["json"])


def parse_value(json: Column) -> Column:
    """Tagged value of a JSON scalar or object."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    is_num = kind.startswith("BIGINT") | kind.startswith("DOUBLE") | kind.startswith("DECIMAL")
    is_bool = kind == "BOOLEAN"
    return value(
        F.when(is_num, F.try_variant_get(v, "$", "double")),
        F.when(is_bool, F.try_variant_get(v, "$", "boolean")),
        F.when(~is_num & ~is_bool & (kind != "VOID"), json),
    )


def strict_number(v: Column) -> Column:
    """A number as it is; booleans and objects give null."""
    return v["num"]


def strict_bool(v: Column) -> Column:
    return v["bool"]


def lenient_number(v: Column) -> Column:
    """First numeric token of a number or text such as ``1,200 sq ft``."""
    plain = F.when(~F.ltrim(v["json"]).rlike(r"^[\[{]"), v["json"])  # objects and lists are not text
    text = F.replace(F.trim(F.trim(plain), F.lit('"')), F.lit(","), F.lit(""))
    token = F.regexp_extract(text, r"(?U)[\d.\-]+", 0)
    return F.coalesce(v["num"], F.nullif(token, F.lit("")).try_cast("double"))


def lenient_bool(v: Column) -> Column:
    """Boolean of a boolean, 0/1 or a yes/no word."""
    word = F.lower(F.trim(F.trim(F.trim(v["json"]), F.lit('"'))))
    return (
        F.when(v["bool"].isNotNull(), v["bool"])
        .when(v["num"].isin(0.0, 1.0), v["num"] == 1.0)
        .when(word.isin("true", "yes", "y", "required", "1"), True)
        .when(word.isin("false", "no", "n", "not required", "0"), False)
    )


def _first_present(raw: Column, keys: list[str]) -> list[Column]:
    return [F.nullif(F.try_element_at(raw, F.lit(k)), F.lit("")) for k in keys]


def flood_severity(raw: Column, description: Column) -> Column:
    """``warning`` inside a special flood hazard area, else ``info``."""
    zone = F.coalesce(*_first_present(raw, ["FLD_ZONE", "fld_zone", "designation", "zone"]), description)
    words = F.split(F.trim(F.regexp_replace(F.upper(zone), r"(?U)[()\s]+", " ")), " ")
    return F.when(F.get(words, F.lit(0)).isin(C.SFHA_ZONES), "warning").otherwise("info")


def fire_severity(raw: Column, description: Column) -> Column:
    """Very high is critical, moderate is info, anything else (or unknown) is a warning."""
    keys = ["FHSZ_Description", "fhsz_description", "HAZ_CLASS", "designation", "FHSZ"]
    token = F.lower(F.trim(F.coalesce(*_first_present(raw, keys), description)))
    return (
        F.when(F.contains(token, F.lit("very high")), "critical")
        .when(F.contains(token, F.lit("high")), "warning")
        .when(F.contains(token, F.lit("moderate")), "info")
        .otherwise("warning")
    )


def hit_severity(overlay_type: Column, status: Column, raw: Column, description: Column) -> Column:
    """Severity of an overlay result; null unless it is a hit."""
    return F.when(
        status == "hit",
        F.when(overlay_type == "flood", flood_severity(raw, description))
        .when(overlay_type == "fire", fire_severity(raw, description))
        .when(overlay_type.isin(C.HAZARD_TYPES), "warning")
        .otherwise("info"),
    )


def is_hazard(overlay_type: Column, severity: Column) -> Column:
    """True for a hit that constrains the project."""
    return F.coalesce(overlay_type.isin(C.HAZARD_TYPES) & (severity != "info"), F.lit(False))


def with_severity(raw: Column, severity: Column) -> Column:
    """Add the severity to the raw attributes, never over an existing one."""
    empty = F.create_map().cast("map<string,string>")
    have = F.coalesce(raw, empty)
    extra = F.when(F.map_contains_key(have, "severity"), empty).otherwise(F.create_map(F.lit("severity"), severity))
    return F.when(severity.isNull(), raw).otherwise(F.map_concat(have, extra))


def is_single_family(zone_code: Column) -> Column:
    """True, false or unknown (null). Single-family prefixes are tried first, so ``RAS..``
    counts as single-family through ``RA``."""
    z = F.upper(F.trim(zone_code))
    starts = lambda ps: reduce(lambda a, b: a | b, [F.startswith(z, F.lit(p)) for p in ps])
    return (
        F.when(F.coalesce(zone_code, F.lit("")) == "", None)
        .when(starts(C.SINGLE_FAMILY_PREFIXES), True)
        .when(starts(["C", "M", *C.MULTI_FAMILY_PREFIXES]), False)
    )


def public_flag(flag: Column) -> Column:
    """Compliance flag shown to readers; null where no comparison was made."""
    return lookup(flag, {C.MATCHES: "compliant", C.RESTRICTIVE: C.RESTRICTIVE, C.REVIEW: C.REVIEW})


def height_field(project_type: Column, near_transit: Column) -> Column:
    return (
        F.when(project_type == "attached_adu", "max_height_attached_ft")
        .when(F.coalesce(near_transit, F.lit(False)), "max_height_near_transit_ft")
        .otherwise("max_height_detached_standard_ft")
    )


def size_field(bedrooms: Column) -> Column:
    return F.when(bedrooms >= 2, "max_size_sqft_2br").otherwise("max_size_sqft_1br")


def confidence_rank(c: Column) -> Column:
    return F.coalesce(lookup(c, {"low": 0, "medium": 1, "high": 2}), F.lit(0))


def confidence_name(rank: Column) -> Column:
    return F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), rank)


def cap_confidence(confidences: Column) -> Column:
    """Lowest confidence of an array, never above medium."""
    lowest = F.array_min(F.transform(confidences, confidence_rank))
    return confidence_name(F.least(F.coalesce(lowest, F.lit(0)), F.lit(1)))


def existing_structure_flag(structure_type: Column) -> Column:
    """True where a structure is known to exist, else unknown."""
    return F.when(~structure_type.isin("none", "unknown"), F.lit(True))


def changelog_type(entry_type: Column) -> Column:
    return F.coalesce(lookup(entry_type, C.CHANGELOG_TYPES), F.lit("correction"))


def geocode_confidence(
    provider: Column, matches: Column, location_type: Column, partial: Column,
    relevance: Column, place_rank: Column, address_type: Column,
) -> Column:
    """Confidence of one landed geocoder response; each provider has its own signal."""
    single = F.when(matches == 1, "high").otherwise("medium")
    by_rank = (
        F.when((place_rank >= 30) | F.lower(address_type).isin("building", "house", "address"), "high")
        .when(place_rank >= 26, "medium")
        .otherwise("low")
    )
    by_type = (
        F.when(F.coalesce(partial, F.lit(False)), "low")
        .when(location_type == "ROOFTOP", single)
        .when(location_type == "RANGE_INTERPOLATED", "medium")
        .otherwise("low")
    )
    by_relevance = F.when(relevance >= 0.9, "high").when(relevance >= 0.6, "medium").otherwise("low")
    return (
        F.when(F.coalesce(matches, F.lit(0)) == 0, "low")
        .when(provider == "census", single)
        .when(provider == "google", by_type)
        .when(provider == "mapbox", by_relevance)
        .when(provider == "nominatim", by_rank)
        .otherwise("low")
    )
