"""Landed GeoJSON feature pages to rows: reading, field mapping, layer choice, layer loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import geometry as G
from parcelspark.operators.validity import review

FEATURE_T = "struct<geometry:string,properties:map<string,string>>"
PAGE_T = "features array<struct<geometry:string,properties:map<string,string>>>"


def read_features(spark: SparkSession, path: str, *, stream: bool = False, multi_line: bool = True, max_features: int | None = None, order_by: str | None = None) -> DataFrame:
    """Rows ``geometry`` (GeoJSON text), ``geom``, ``props`` from landed FeatureCollection files.

    A file is one collection, or with ``multi_line=False`` one collection per line. An empty or
    missing folder is an error: an outage must never look like a layer without
    features. ``max_features`` keeps the first by an attribute, in numeric order where it is one.
    """
    src = (spark.readStream if stream else spark.read).schema(PAGE_T).option("multiLine", multi_line)
    pages = src.json(path)
    if not stream and not pages.inputFiles():
        raise FileNotFoundError(f"no landed feature pages under {path}")
    rows = pages.select(F.explode("features").alias("f")).select("f.geometry", F.col("f.properties").alias("props"))
    rows = rows.withColumn("geom", F.expr(G.from_geojson("geometry")))
    if max_features is None:
        return rows
    key = pick(F.col("props"), [order_by or "OBJECTID"])
    return limit_features(rows, [key.try_cast("double"), key, F.col("geometry")], max_features)


def limit_features(features: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """First ``n`` features in a stable order."""
    return features.orderBy(*order).limit(n)


def lower_keys(props: Column) -> Column:
    """Attributes by lower-cased name; of two names differing in case the later wins."""
    entries = F.map_entries(props)
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def pick(props: Column, candidates: Sequence[str] | Column, strip: bool = True) -> Column:
    """First present, non-empty attribute among candidate names, in any case.

    ``strip`` also passes over blank values, as the bulk loads do.
    """
    low = lower_keys(props)
    names = candidates if isinstance(candidates, Column) else F.array(*[F.lit(c) for c in candidates]) if candidates else F.array().cast("array<string>")
    found = F.transform(names, lambda n: F.try_element_at(low, F.lower(n)))
    full = lambda v: v.isNotNull() & ((F.trim(v) if strip else v) != "")
    return F.get(F.filter(found, full), F.lit(0))


def schema_profile(features: DataFrame, layer: Sequence[str] = ()) -> DataFrame:
    """Attribute names of each layer, lower-cased, with the number of rows that have them."""
    names = features.select(*layer, F.explode(F.array_distinct(F.transform(F.map_keys("props"), F.lower))).alias("field"))
    return names.groupBy(*layer, "field").agg(F.count("*").alias("present"))


def resolve_fields(features: DataFrame, wanted: dict[str, Sequence[str]], layer: Sequence[str] = (), advertised: DataFrame | None = None) -> DataFrame:
    """Add a column for each wanted field: the value of the first candidate that the *layer* has.

    The choice is made once for a layer (``layer`` columns; none: all rows are one), from the names that its service
    advertises (``advertised``: the layer columns and ``fields``) or else from those its rows have. A row in which the
    chosen attribute is missing or blank has no value, whatever its other attributes hold.
    """
    if advertised is None:
        known = schema_profile(features, layer).groupBy(*layer).agg(F.collect_set("field").alias("_have"))  # as wide as the layer
    else:
        known = advertised.select(*layer, F.transform("fields", F.lower).alias("_have"))
    first = lambda names: F.get(F.filter(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.array_contains("_have", n)), F.lit(0))
    chosen = known.select(*layer, F.struct(*[first(v).alias(k) for k, v in wanted.items()]).alias("_chosen"))
    rows = features.join(chosen, [*layer], "left") if layer else features.withColumn("_chosen", chosen.select("_chosen").scalar())
    value = lambda k: pick(F.col("props"), F.array(F.col(f"_chosen.{k}")))
    return rows.withColumns({k: value(k) for k in wanted}).drop("_chosen")


def map_fields(features: DataFrame, mapping: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Map every layer's attributes in one job: features (``slug``, ``kind``, ``props``) against a
    table of candidate names. City rows win over shared ``*`` rows."""
    cand = mapping.groupBy("slug", "kind").agg(F.map_from_entries(F.collect_list(F.struct("field", "candidates"))).alias("_m"))
    own, shared = cand.alias("o"), cand.where("slug = '*'").alias("a")
    f = features.alias("f")
    j = f.join(own, (F.col("f.slug") == F.col("o.slug")) & (F.col("f.kind") == F.col("o.kind")), "left").join(
        shared, F.col("f.kind") == F.col("a.kind"), "left"
    )
    m = F.coalesce("o._m", "a._m")
    return j.select("f.*", *[pick(F.col("f.props"), F.try_element_at(m, F.lit(n)), strip=False).alias(n) for n in fields])


def override_mapping(base: DataFrame, override: DataFrame) -> DataFrame:
    """Field mapping with later rows winning per (slug, kind, field)."""
    both = base.withColumn("_r", F.lit(0)).unionByName(override.withColumn("_r", F.lit(1)))
    return both.groupBy("slug", "kind", "field").agg(F.max_by(F.struct("layer", "candidates"), "_r").alias("_x")).select(
        "slug", "kind", "field", "_x.*"
    )


def choose_layer(
    layers: DataFrame, required: Sequence[str] = (), any_of: Sequence[str] = (), geometry_types: Sequence[str] = (),
    name_terms: Sequence[str] = (), preferred_ids: Sequence[int] = (),
) -> DataFrame:
    """One layer per service: preferred ids first, then the advertised order, among the layers
    with all required fields, any optional one, a geometry type and a name term.

    ``layers``: service, layer_id, position, name, geometry_type, fields.
    """
    arr = lambda xs: F.array(*[F.lit(x.lower()) for x in xs])
    low = F.transform("fields", F.lower)
    ok = F.lit(True)
    if required:
        ok = ok & F.forall(arr(required), lambda r: F.array_contains(low, r))
    if any_of:
        ok = ok & F.arrays_overlap(low, arr(any_of))
    if geometry_types:
        ok = ok & F.lower("geometry_type").isin([g.lower() for g in geometry_types])
    if name_terms:
        ok = ok & F.exists(arr(name_terms), lambda t: F.contains(F.lower("name"), t))
    rank = F.coalesce(*[F.when(F.col("layer_id") == i, n) for n, i in enumerate(preferred_ids)], F.lit(len(preferred_ids)))
    return layers.where(ok).groupBy("service").agg(F.min_by("layer_id", F.struct(rank, "position", "layer_id")).alias("layer_id"))


def feature_key(geometry: Column, *extra: Column) -> Column:
    """Content key: SHA-1 of geometry and discriminators, 24 hex digits."""
    blob = F.to_json(F.struct(geometry.alias("g"), F.array(*[F.coalesce(e, F.lit("None")) for e in extra]).alias("x")), {"ignoreNullFields": "false"})
    return F.substring(F.sha1(blob), 1, 24)


def canonical_geometry(geometry: Column) -> Column:
    """GeoJSON text with its members in one order and without white space, so equal geometries have equal keys."""
    parts = [F.get_json_object(geometry, f"$.{name}").alias(name) for name in ("bbox", "coordinates", "crs", "geometries", "type")]
    return F.when(geometry.isNotNull(), F.to_json(F.struct(*parts)))


def with_designation(main: Column, detail: Column) -> Column:
    """``MAIN (DETAIL)``, or just the main part."""
    return F.when(F.nullif(main, F.lit("")).isNotNull() & F.nullif(detail, F.lit("")).isNotNull(), F.concat(main, F.lit(" ("), detail, F.lit(")"))).otherwise(main)


def _bulk(*names: str, prefix: str = "") -> dict[str, Sequence[str]]:
    return {f"_{n}": C.BULK_FIELDS[prefix + n] for n in names}


def load_flood(features: DataFrame, bbox: Sequence[float | Column] | None = None, layer: Sequence[str] = ()) -> DataFrame:
    """Flood overlays, where given those that meet an envelope (numbers or columns), designation ``ZONE (SUBTYPE)``."""
    features = resolve_fields(features, _bulk("zone", "subtype", "id", prefix="flood_"), layer)
    p, b = F.col("props"), F.col("_b")
    boxed = features.withColumn("_b", F.expr(G.bbox(G.edges("geom"))))
    inside = features if bbox is None else boxed.where((b["xmax"] >= bbox[0]) & (b["xmin"] <= bbox[2]) & (b["ymax"] >= bbox[1]) & (b["ymin"] <= bbox[3]))
    return review(inside.select(
        F.lit("flood").alias("overlay_type"), F.lit("FEMA Flood Hazard Zone").alias("name"),
        with_designation(F.col("_zone"), F.col("_subtype")).alias("designation"),
        F.col("_id").alias("raw_feature_id"), p.alias("raw_value"), "geom",
        F.lit(None).cast("long").alias("jurisdiction_id"), F.lit("high").alias("confidence"), F.lit("current").alias("data_status"),
    ))


def load_fire(features: DataFrame) -> DataFrame:
    """Fire overlays of several layers (``layer``), designation ``CLASS (AREA)``."""
    return review(resolve_fields(features, _bulk("class", "area", "id", prefix="fire_"), ["layer"]).select(
        F.lit("fire").alias("overlay_type"), F.concat(F.lit("CAL FIRE FHSZ - "), F.col("layer")).alias("name"), "layer",
        with_designation(F.col("_class"), F.col("_area")).alias("designation"),
        F.col("_id").alias("raw_feature_id"), F.col("props").alias("raw_value"), "geom",
        F.lit(None).cast("long").alias("jurisdiction_id"), F.lit("high").alias("confidence"), F.lit("current").alias("data_status"),
    ))


def load_zoning(features: DataFrame, layer: Sequence[str] = ()) -> DataFrame:
    """City zoning; ``outcome`` is ``failed`` for rows without a code, which carry no district."""
    code = F.col("_zone_code")
    return review(resolve_fields(features, _bulk("zone_code", "zone_name", "zone_category"), layer).select(
        F.when(code.isNull(), "failed").otherwise("inserted").alias("outcome"), code.alias("zone_code"), F.col("_zone_name").alias("zone_name"),
        F.col("_zone_category").alias("zone_category"), F.col("props").alias("raw_attributes"), "geom",
        F.lit("high").alias("confidence"), F.lit("current").alias("data_status"),
    ))


def load_parcels(features: DataFrame, layer: Sequence[str] = ()) -> DataFrame:
    """City parcels; the stored address is the upper-cased situs, nothing more."""
    apn, situs = F.col("_apn"), F.col("_situs")
    return review(resolve_fields(features, _bulk("apn", "situs"), layer).select(
        F.when(apn.isNull(), "failed").otherwise("ok").alias("outcome"), apn.alias("apn"), situs.alias("situs_address"), F.upper(situs).alias("normalized_address"),
        F.col("props").alias("raw_attributes"), "geom", F.expr(G.centroid("geom")).alias("centroid"), (F.expr(G.area_m2("geom")) * 10.7639104167).alias("area_sqft"),
    ))


def load_bootstrap_zoning(features: DataFrame, jurisdictions: DataFrame, layer: Sequence[str] = ()) -> DataFrame:
    """Statewide zoning for jurisdictions that are not in production; low authority, to review.

    Production jurisdictions have adopted zoning and are refused.
    """
    p, code = F.col("props"), F.col("_code")
    allowed = resolve_fields(features, _bulk("code", "name", prefix="bootstrap_"), layer).join(jurisdictions.where("coverage_status = 'production'").select("jurisdiction_id"), "jurisdiction_id", "left_anti")
    marks = F.create_map(F.lit("_is_bootstrap"), F.lit("true"), F.lit("_authority_rank"), F.lit("5"))
    return allowed.select(
        "jurisdiction_id", F.when(code.isNull(), "failed").otherwise("inserted").alias("outcome"), code.alias("zone_code"), F.col("_name").alias("zone_name"),
        F.lit("statewide_bootstrap").alias("zone_category"), F.map_concat(p, marks).alias("raw_attributes"), "geom",
        F.lit("low").alias("confidence"), F.lit("needs_review").alias("data_status"), F.lit(5).alias("authority_rank"),
    )


def prefer_authority(candidates: DataFrame, keys: Sequence[str], rank: str = "authority_rank", tie: Sequence[str] = ()) -> DataFrame:
    """Row of the strongest authority (lowest rank) per key."""
    rest = [c for c in candidates.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(rank, *tie)).alias("_b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_b.*")


def ondemand_overlays(features: DataFrame) -> DataFrame:
    """Overlay rows of the on-demand cache with their content key; they belong to no jurisdiction."""
    p = F.col("props")
    des = pick(p, F.col("designation_fields"), strip=False)
    return features.select(
        F.lit(None).cast("long").alias("jurisdiction_id"), F.col("overlay_type"), des.alias("name"), des.alias("designation"),
        pick(p, ["OBJECTID", "FLD_AR_ID"], strip=False).alias("raw_feature_id"),
        feature_key(canonical_geometry(F.col("geometry")), F.col("overlay_type"), des).alias("ondemand_key"), p.alias("raw_value"), "geometry",
    )
