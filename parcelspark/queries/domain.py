"""Domain tables derived from the given tables, in Spark and in SQL.

One grid unit is 2**-10 degree and every offset is dyadic, so coordinates are exact doubles in
both engines. Each function reads its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import geometry as G
from parcelspark.functions import values as V
from parcelspark.functions.text import normalize_address
from parcelspark.operators import layers, spatial
from parcelspark.operators.skew import latest_by, spread
from parcelspark.plans.feasibility import Refs
from parcelspark.session import cut

AS_OF = "2024-01-31 00:00:00"
ZONE_CODES = ["R1", "RS", "RD1.5", "R3", "C2", "RAS4", "PF", "RE9"]
FLOOD = ["A", "AE", "X", "D", "X (unshaded)", "AREA OF MINIMAL FLOOD HAZARD", "VE", None]
FIRE = ["Very High", "High", "Moderate", None]
TYPES = ["flood", "fire", "historic", "coastal", "hillside"]
REVIEW = ["pending", "verified", "verified"]
COVER = ["production", "production", "ingesting", "production"]
STRUCTURES = ["single_family", "multifamily", "none", "unknown"]
ENTRY = {"F": "rule_update", "O": "coverage", "P": "source_update"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def choose(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def rows_of_grid(spark: SparkSession, sf: str) -> Column:
    """Number of grid rows, as a scalar subquery over the part table."""
    return table(spark, sf, "part").agg((F.floor(F.max("p_partkey") / 64) + 1).cast("long").alias("n")).scalar()


def lon(u: Column) -> Column:
    return u / 1024.0 - 124.0


def lat(v: Column) -> Column:
    return v / 1024.0 + 32.5


def grid_point(u: str, v: str) -> str:
    return G.point(f"({u}) / 1024D - 124D", f"({v}) / 1024D + 32.5D")


def grid_box(x1: str, y1: str, x2: str, y2: str) -> str:
    return G.polygon(grid_point(x1, y1), grid_point(x2, y1), grid_point(x2, y2), grid_point(x1, y2), grid_point(x1, y1))


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("parcel_id"), (F.col("p_partkey") % 64).alias("gx"),
        F.floor(F.col("p_partkey") / 64).alias("gy"), "p_size",
    )
    top = "gx + IF(parcel_id % 5 = 0, 0.75D, 0.875D)"
    ring = [("gx", "gy"), ("gx + 0.875D", "gy"), (top, "gy + 0.875D"), ("gx", "gy + 0.875D"), ("gx", "gy")]
    return p.selectExpr(
        "parcel_id", "CAST(parcel_id AS string) AS apn", "gx div 8 AS jurisdiction_id", "gx", "gy",
        f"{G.polygon(*[grid_point(u, v) for u, v in ring])} AS geom", "'urn:gis:parcels' AS source_url",
        "concat('parcels/', gx div 8) AS source_layer", "IF(p_size <= 2, 'low', 'high') AS confidence",
        "TIMESTAMP'2023-12-01' + make_interval(0, 0, 0, p_size) AS last_verified_at",
    ).withColumn("area_sqft", F.expr(G.area_m2("geom")) * V.SQFT_PER_SQM_BULK)


def odd_lots(spark: SparkSession, sf: str) -> DataFrame:
    """The grid's lots as an L, a box with a hole, or two boxes apart, by key; in grid units times ``scale``.

    ``geom`` lies on the grid in degrees, ``planar`` is the same in metres at a size of 40 + p_size metres a unit.
    """
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("parcel_id"), (F.col("p_partkey") % 64).alias("gx"), F.floor(F.col("p_partkey") / 64).alias("gy"), "p_size"
    )
    shapes = {  # polygons of rings, in eighths of a unit
        0: [[[(0, 0), (7, 0), (7, 4), (4, 4), (4, 7), (0, 7)]]],
        1: [[[(0, 0), (7, 0), (7, 7), (0, 7)], [(2, 2), (2, 4), (4, 4), (4, 2)]]],
        2: [[[(0, 0), (2, 0), (2, 7), (0, 7)]], [[(4, 0), (7, 0), (7, 7), (4, 7)]]],
    }

    def shape(polygons: list, corner: Callable[[int, int], str]) -> str:
        ring = lambda r: f"array({', '.join(corner(*c) for c in [*r, r[0]])})"
        return f"CAST(array({', '.join('array(' + ', '.join(map(ring, g)) + ')' for g in polygons)}) AS {G.GEOM_T})"

    on_grid = lambda i, j: grid_point(f"gx + {i / 8}D", f"gy + {j / 8}D")
    in_metres = lambda i, j: G.point(f"{i / 8}D * (40 + p_size)", f"{j / 8}D * (40 + p_size)")
    of_kind = lambda corner: "CASE parcel_id % 3 " + " ".join(f"WHEN {k} THEN {shape(v, corner)}" for k, v in shapes.items()) + " END"
    return p.selectExpr("parcel_id", "gx div 8 AS jurisdiction_id", "p_size", f"{of_kind(on_grid)} AS geom", f"{of_kind(in_metres)} AS planar")


def requests(spark: SparkSession, sf: str, customers: DataFrame | None = None) -> DataFrame:
    """Requests with the coordinates their address geocodes to in ``u, v, lon, lat``."""
    c, k = table(spark, sf, "customer") if customers is None else customers, F.col("c_custkey")
    u = (k * 7919 % 65536) / 1024.0
    v = (k * 104729 % ((rows_of_grid(spark, sf) + 1) * 1024)) / 1024.0
    nation = F.col("c_nationkey")
    return c.select(
        k.alias("request_id"), F.concat(F.lit("cust-"), nation.cast("string")).alias("consumer_id"),
        F.concat((k + 1).cast("string"), F.lit(" North "), F.initcap("c_mktsegment"), F.lit(" Street., Unit  "), nation.cast("string")).alias("address"),
        choose(C.PROJECT_TYPES, k % 6).alias("project_type"), F.round(F.abs("c_acctbal")).alias("target_sqft"),
        F.nullif(nation % 4, F.lit(0)).alias("bedrooms"), (nation % 10 + 10).cast("double").alias("proposed_height_ft"),
        choose(STRUCTURES, nation % 4).alias("existing_structure_type"), (F.col("c_mktsegment") == "BUILDING").alias("near_transit"),
        F.col("c_mktsegment").isin("MACHINERY", "FURNITURE").alias("include_envelope"),
        "c_acctbal", u.alias("u"), v.alias("v"), lon(u).alias("lon"), lat(v).alias("lat"),
    )


def geocodes(spark: SparkSession, sf: str) -> DataFrame:
    """Reference points by address; overdrawn customers have no usable point."""
    conf = F.when(F.col("c_acctbal") < -800, "low").when(F.col("bedrooms") == 1, "medium").otherwise("high")
    return requests(spark, sf).where("c_acctbal >= -900").select(
        normalize_address(F.col("address")).alias("normalized_address"), "lon", "lat", conf.alias("confidence")
    )


def ask(spark: SparkSession, sf: str, customers: DataFrame | None = None) -> DataFrame:
    """Requests as a caller sends them, without coordinates."""
    return requests(spark, sf, customers).drop("u", "v", "lon", "lat", "c_acctbal")


def located(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select("request_id", "lon", "lat", "u", "v", "project_type")


def jurisdictions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    city, county = grid_box("n_nationkey * 8", "0", "n_nationkey * 8 + 8", "n"), grid_box("-1", "-1", "65", "n + 2")
    return table(spark, sf, "nation").withColumn("n", rows_of_grid(spark, sf)).select(
        k.cast("long").alias("jurisdiction_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"),
        F.when(k == 8, "county").otherwise("city").alias("jurisdiction_type"),
        F.when(k == 8, "planned").otherwise(choose(COVER, k % 4)).alias("coverage_status"),
        F.expr("TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, n_nationkey)").alias("last_source_refresh_at"),
        F.expr(f"CASE WHEN n_nationkey <= 7 THEN {city} WHEN n_nationkey = 8 THEN {county} END").alias("geom"),
        F.col("n_regionkey").cast("long").alias("region"),
    )


def envelope(spark: SparkSession, sf: str) -> tuple[Column, Column, Column, Column]:
    """Box of the county around the grid; the grid outgrows any fixed box as lots are added."""
    return lon(F.lit(-1)), lat(F.lit(-1)), lon(F.lit(65)), lat(rows_of_grid(spark, sf) + 2)


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """One district per 4 x 4 block of parcels, shifted half a unit to the left."""
    t = table(spark, sf, "part").groupBy(
        F.floor(F.col("p_partkey") % 64 / 4).alias("tx"), F.floor(F.col("p_partkey") / 256).alias("ty")
    ).agg(F.count("*").alias("n_parcels"))
    code = choose(ZONE_CODES, (F.col("tx") + F.col("ty") * 3) % 8)
    zid = F.col("tx") + F.col("ty") * 16
    return t.select(
        zid.alias("zone_id"), F.floor(F.col("tx") / 2).alias("jurisdiction_id"), code.alias("zone_code"),
        F.concat(F.lit("Block "), zid.cast("string")).alias("zone_name"), F.substring(code, 1, 1).alias("zone_category"),
        F.when(zid % 3 != 0, F.concat(F.lit("Plan "), zid.cast("string"))).alias("general_plan"),
        F.expr(grid_box("tx * 4 - 0.5D", "ty * 4", "tx * 4 + 3.5D", "ty * 4 + 4")).alias("geom"), "n_parcels", F.lit("urn:gis:zoning").alias("source_url"), F.lit("zoning/0").alias("source_layer"),
        F.lit("high").alias("confidence"), F.lit("2024-01-15").cast("timestamp").alias("last_verified_at"),
    )


def overlays(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    square = grid_box("s_suppkey * 37 % 64", "s_suppkey * 53 % n", "s_suppkey * 37 % 64 + 3", "s_suppkey * 53 % n + 3")
    kind, fifth = choose(TYPES, s % 5), F.floor(s / 5)
    des = F.when(s % 5 == 0, choose(FLOOD, fifth % 8)).when(s % 5 == 1, choose(FIRE, fifth % 4)).otherwise(F.concat(F.lit("H"), (s % 7).cast("string")))
    raw = F.when((s % 5 == 0) & (fifth % 2 == 0) & des.isNotNull(), F.create_map(F.lit("FLD_ZONE"), des))
    return table(spark, sf, "supplier").withColumn("n", rows_of_grid(spark, sf)).select(
        s.alias("overlay_id"), kind.alias("overlay_type"), F.concat(kind, F.lit(" "), s.cast("string")).alias("name"), des.alias("designation"),
        s.cast("string").alias("raw_feature_id"), raw.alias("raw_value"), F.expr(square).alias("geom"),
        F.lit("urn:gis:overlays").alias("source_url"), F.concat(F.lit("overlays/"), kind).alias("source_layer"), F.lit("high").alias("confidence"),
    )


def zoning_rules(spark: SparkSession, sf: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        s.alias("rule_id"), (s % 8).alias("jurisdiction_id"), choose(ZONE_CODES, F.floor(s / 8) % 8).alias("zone_code"),
        choose(C.PROJECT_TYPES, s % 6).alias("project_type"), (F.floor(s / 64) + 1).alias("version"), (n % 5 != 0).alias("is_current"),
        choose(REVIEW, n % 3).alias("review_status"), choose(C.FLAGS, s % 4).alias("compliance_flag"),
    )


def _pick_catalog(position: int, index: Column) -> Column:
    return choose([f[position] for f in C.FIELD_CATALOG], index)


def rule_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Latest line item per (supplier, field) read as a rule attribute."""
    li = table(spark, sf, "lineitem").withColumn("idx", F.col("l_partkey") % len(C.FIELD_CATALOG))
    last = latest_by(
        li.select("l_suppkey", "idx", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"),
        ["l_suppkey", "idx"], ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"],
    )
    unit, dtype, kind = (_pick_catalog(i, F.col("idx")) for i in (6, 1, 2))
    num = F.when(unit == "sqft", F.round(F.col("l_extendedprice") / 50)).when(unit == "ratio", F.col("l_discount") * 10).otherwise(F.col("l_quantity"))
    numeric = F.when(dtype == "numeric", num)
    return last.select(
        F.col("l_suppkey").alias("rule_id"), _pick_catalog(0, F.col("idx")).alias("field_name"),
        F.coalesce(numeric.cast("string"), (F.col("l_returnflag") == "R").cast("string")).alias("value_json"), numeric.alias("value_numeric"),
        F.lit(None).cast("string").alias("unit"),
        F.when(F.col("l_linenumber") < 7, F.when(kind == "conditional", "eq").when(kind != "informational", kind)).alias("operator"),
        F.concat(F.lit("urn:code:"), F.col("l_suppkey").cast("string")).alias("source_url"), F.lit(None).cast("string").alias("source_title"),
        F.concat(F.lit("Sec. "), F.col("l_linenumber").cast("string")).alias("source_section"), F.col("l_shipdate").alias("last_verified_at"),
        F.lit("high").alias("confidence"), F.lit("current").alias("data_status"),
    )


TILE_LEVEL = 4  # tiles of 64 parcels a side


def _build(spark: SparkSession, sf: str, name: str, folder: str) -> None:
    keep = {"jurisdictions": spatial.JURISDICTION_KEEP, "parcels": spatial.PARCEL_KEEP, "zones": spatial.ZONE_KEEP, "overlays": spatial.OVERLAY_KEEP}[name]
    # written first: dealing along the curve samples them, and parcels are filed by shape too
    features = cut({"jurisdictions": jurisdictions, "parcels": parcels, "zones": zones, "overlays": overlays}[name](spark, sf))
    if name == "parcels":
        layers.store(folder, features, keep, filed=spatial.parcel_shapes(features), tolerance_m=spatial.TOLERANCE_M, tile_level=TILE_LEVEL)
    else:
        layers.store(folder, features, keep, areas=name == "zones", tile_level=TILE_LEVEL)


def layer(spark: SparkSession, sf: str, name: str) -> layers.Layer:
    """A reference layer as stored; built where its input files have none yet."""
    inputs = {"jurisdictions": ["nation", "part"], "parcels": ["part"], "zones": ["part"], "overlays": ["supplier", "part"]}[name]
    key = layers.fingerprint(spark, *[f"{sf}/{t}.parquet" for t in inputs])
    return layers.open_layer(spark, layers.current(spark, f"layer-{name}-{key}", lambda folder: _build(spark, sf, name, folder)))


def refs(spark: SparkSession, sf: str) -> Refs:
    """Reference tables, with the four spatial ones as stored layers."""
    stored = {n: layer(spark, sf, n) for n in ("jurisdictions", "parcels", "zones", "overlays")}
    return Refs(
        *[stored[n].features for n in stored], zoning_rules(spark, sf), rule_attributes(spark, sf), C.state_baselines(spark), geocodes(spark, sf), stored,
    )


def usage_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind, user = F.col("event_type"), F.col("user_id")
    return (table(spark, sf, "events") if events is None else events).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), user.alias("consumer_id"), (user * 5 + k % 5).alias("fingerprint"),
        F.when(k < 20, k.cast("string")).alias("idempotency_key"), choose(["basic", "PRO", "ultra", "mega", "trial"], user % 5).alias("slug"),
        F.when(kind == "error", "error").when(kind == "view", "unsupported").when(kind == "click", "insufficient").otherwise("ok").alias("outcome"),
        F.when(kind == "error", 500).when(kind == "view", 422).otherwise(200).alias("status_code"), kind.alias("endpoint"),
        F.when(kind == "click", "insufficient_data").when(kind.isin("error", "view"), None).otherwise(choose(C.BILLABLE, k % 3)).alias("feasibility_status"),
        (k % 7 == 0).alias("cache_hit"), F.round(F.col("value") * 10).cast("int").alias("response_time_ms"), k.alias("k"),
    )


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captured payloads per source, in the order of their ids."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("registry_id"), F.col("doc_id").alias("captured_seq"), F.col("text").alias("payload")
    )


def section_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        (F.col("page_id") % 8).alias("jurisdiction_id"), F.col("page_id").alias("position"), F.col("url").alias("section_url"), "html"
    )


def changelog_entries(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    entry = F.when(F.col("o_orderpriority") == "1-URGENT", "release").otherwise(
        F.when(F.col("o_orderstatus") == "F", "rule_update").when(F.col("o_orderstatus") == "O", "coverage").otherwise("source_update")
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("entry_id"), F.col("c_nationkey").cast("long").alias("jurisdiction_id"), entry.alias("entry_type"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("summary"), F.col("o_orderdate").alias("published_at"),
    )


def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    day = F.lit(86400000000)
    return table(spark, sf, "supplier").select(
        s.alias("source_id"), F.col("s_name").alias("name"), F.when(s % 3 == 0, F.concat(F.lit("layer-"), s.cast("string"))).alias("layer_name"),
        F.when(s % 10 != 0, F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - s * day)).alias("last_retrieved_at"),
        (F.col("s_acctbal") >= 0).alias("active"), choose(list(C.AUTHORITY_RANK), s % 7).alias("kind"), (s % 8).alias("jurisdiction_id"),
    )


# --- the same tables in SQL ---------------------------------------------------------------
def _list(values: list) -> str:
    return "[" + ", ".join(C.sql_literal(v) for v in values) + "]"


_NAMES = _list([f[0] for f in C.FIELD_CATALOG])
_UNITS = _list([f[6] for f in C.FIELD_CATALOG])
_DTYPES = _list([f[1] for f in C.FIELD_CATALOG])
_KINDS = _list([f[2] for f in C.FIELD_CATALOG])


def _values(rows: list, names: str) -> str:
    def lit(v: object) -> str:
        return _list(list(v)) if isinstance(v, (list, tuple)) else C.sql_literal(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") t({names})"


CTE: dict[str, str] = {
    "dims": "SELECT max(p_partkey) // 64 + 1 AS nrows FROM part",
    "pc": """SELECT p_partkey AS parcel_id, CAST(p_partkey AS VARCHAR) AS apn, (p_partkey % 64) // 8 AS jurisdiction_id,
        CAST(p_partkey % 64 AS DOUBLE) AS gx, CAST(p_partkey // 64 AS DOUBLE) AS gy,
        CASE WHEN p_partkey % 5 = 0 THEN 0.75e0 ELSE 0.875e0 END AS wt, p_size,
        CASE WHEN p_size <= 2 THEN 'low' ELSE 'high' END AS confidence FROM part""",
    # odd lots as sums of boxes: an L is a box less its notch, a hole is taken away, two parts are added
    "ob": """SELECT p_partkey AS parcel_id, p_size, (p_partkey % 64) // 8 AS jurisdiction_id, b.s AS sign, p_partkey % 64 + b.a / 8e0 AS x1, p_partkey // 64 + b.b / 8e0 AS y1,
        p_partkey % 64 + b.c / 8e0 AS x2, p_partkey // 64 + b.d / 8e0 AS y2 FROM part, (VALUES (0, 1, 0, 0, 7, 7), (0, -1, 4, 4, 7, 7), (1, 1, 0, 0, 7, 7), (1, -1, 2, 2, 4, 4),
        (2, 1, 0, 0, 2, 7), (2, 1, 4, 0, 7, 7)) b(k, s, a, b, c, d) WHERE b.k = p_partkey % 3""",
    "rq": f"""SELECT c_custkey AS request_id, 'cust-' || c_nationkey AS consumer_id,
        (c_custkey * 7919 % 65536) / 1024e0 AS u, (c_custkey * 104729 % ((nrows + 1) * 1024)) / 1024e0 AS v,
        {_list(C.PROJECT_TYPES)}[c_custkey % 6 + 1] AS project_type, nullif(c_nationkey % 4, 0) AS bedrooms,
        round(abs(c_acctbal)) AS target_sqft, c_nationkey % 10 + 10e0 AS proposed_height_ft,
        {_list(STRUCTURES)}[c_nationkey % 4 + 1] AS existing_structure_type, c_nationkey, c_mktsegment, c_acctbal,
        c_mktsegment = 'BUILDING' AS near_transit, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS include_envelope,
        (c_custkey + 1) || ' North ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' Street., Unit  ' || c_nationkey AS address,
        (c_custkey + 1) || ' N ' || upper(c_mktsegment) || ' ST UNIT ' || c_nationkey AS normalized_address
        FROM customer, dims""",
    "pt": "SELECT *, u / 1024e0 - 124e0 AS lon, v / 1024e0 + 32.5e0 AS lat FROM rq",
    "jr": f"""SELECT CAST(n_nationkey AS BIGINT) AS jurisdiction_id, lower(n_name) AS slug, n_name AS name,
        CASE WHEN n_nationkey = 8 THEN 'county' ELSE 'city' END AS jurisdiction_type,
        CASE WHEN n_nationkey = 8 THEN 'planned' ELSE {_list(COVER)}[n_nationkey % 4 + 1] END AS coverage_status,
        CASE WHEN n_nationkey <= 7 THEN n_nationkey * 8e0 WHEN n_nationkey = 8 THEN -1e0 END AS x1,
        CASE WHEN n_nationkey <= 7 THEN 0e0 WHEN n_nationkey = 8 THEN -1e0 END AS y1,
        CASE WHEN n_nationkey <= 7 THEN n_nationkey * 8e0 + 8 WHEN n_nationkey = 8 THEN 65e0 END AS x2,
        CASE WHEN n_nationkey <= 7 THEN CAST(nrows AS DOUBLE) WHEN n_nationkey = 8 THEN nrows + 2e0 END AS y2
        FROM nation, dims""",
    "zn": f"""SELECT tx + 16 * ty AS zone_id, tx // 2 AS jurisdiction_id, {_list(ZONE_CODES)}[(tx + 3 * ty) % 8 + 1] AS zone_code,
        tx * 4 - 0.5e0 AS x1, ty * 4e0 AS y1, tx * 4 + 3.5e0 AS x2, ty * 4e0 + 4 AS y2, n_parcels
        FROM (SELECT (p_partkey % 64) // 4 AS tx, p_partkey // 256 AS ty, count(*) AS n_parcels FROM part GROUP BY 1, 2)""",
    "ov": f"""SELECT s_suppkey AS overlay_id, {_list(TYPES)}[s_suppkey % 5 + 1] AS overlay_type,
        CASE s_suppkey % 5 WHEN 0 THEN {_list(FLOOD)}[s_suppkey // 5 % 8 + 1] WHEN 1 THEN {_list(FIRE)}[s_suppkey // 5 % 4 + 1]
        ELSE 'H' || s_suppkey % 7 END AS designation, CAST(s_suppkey * 37 % 64 AS DOUBLE) AS x1,
        CAST(s_suppkey * 53 % nrows AS DOUBLE) AS y1, s_suppkey * 37 % 64 + 3e0 AS x2, s_suppkey * 53 % nrows + 3e0 AS y2
        FROM supplier, dims""",
    "ovs": f"""SELECT *, CASE WHEN overlay_type = 'flood' THEN CASE WHEN designation IN {tuple(C.SFHA_ZONES)} THEN 'warning' ELSE 'info' END
        WHEN overlay_type = 'fire' THEN CASE designation WHEN 'Very High' THEN 'critical' WHEN 'Moderate' THEN 'info' ELSE 'warning' END
        WHEN overlay_type IN ('coastal', 'hillside') THEN 'warning' ELSE 'info' END AS severity FROM ov""",
    "rl": f"""SELECT s_suppkey AS rule_id, s_suppkey % 8 AS jurisdiction_id, {_list(ZONE_CODES)}[s_suppkey // 8 % 8 + 1] AS zone_code,
        {_list(C.PROJECT_TYPES)}[s_suppkey % 6 + 1] AS project_type, s_suppkey // 64 + 1 AS version, s_nationkey % 5 <> 0 AS is_current,
        {_list(REVIEW)}[s_nationkey % 3 + 1] AS review_status, {_list(C.FLAGS)}[s_suppkey % 4 + 1] AS compliance_flag FROM supplier""",
    "at0": f"""SELECT *, l_partkey % {len(C.FIELD_CATALOG)} + 1 AS idx FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey,
        l_partkey % {len(C.FIELD_CATALOG)} ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
        l_returnflag DESC, l_shipdate DESC) = 1""",
    "atr": f"""SELECT l_suppkey AS rule_id, {_NAMES}[idx] AS field_name, CASE WHEN {_DTYPES}[idx] = 'numeric' THEN
        CASE {_UNITS}[idx] WHEN 'sqft' THEN round(l_extendedprice / 50) WHEN 'ratio' THEN l_discount * 10 ELSE l_quantity END END AS num,
        CASE WHEN {_DTYPES}[idx] = 'boolean' THEN l_returnflag = 'R' END AS bool,
        CASE WHEN l_linenumber < 7 AND {_KINDS}[idx] <> 'informational' THEN CASE {_KINDS}[idx] WHEN 'conditional' THEN 'eq' ELSE {_KINDS}[idx] END END AS operator,
        l_linenumber, l_shipdate AS last_verified_at FROM at0""",
    "bl": _values([(f, t, o, n, b, j, u, c) for f, t, o, n, b, j, u, c, _ in C.STATE_BASELINES], "field_name, applies_to, operator, num, bool, json, unit, citation"),
    "ct": _values(C.FIELD_CATALOG, "field_name, dtype, kind, num, bool, restrictive, unit, law, project_types"),
    "pl": _values([p[:4] for p in C.PLANS], "plan, slug, quota, rate"),
    "ev": f"""SELECT event_id, ts, user_id AS consumer_id, user_id * 5 + k % 5 AS fingerprint, CASE WHEN k < 20 THEN CAST(k AS VARCHAR) END AS idempotency_key,
        ['basic', 'PRO', 'ultra', 'mega', 'trial'][user_id % 5 + 1] AS slug, event_type AS endpoint, k, k % 7 = 0 AS cache_hit,
        CAST(round(value * 10) AS INTEGER) AS response_time_ms,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'unsupported' WHEN 'click' THEN 'insufficient' ELSE 'ok' END AS outcome,
        CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 422 ELSE 200 END AS status_code,
        CASE WHEN event_type = 'click' THEN 'insufficient_data' WHEN event_type IN ('error', 'view') THEN NULL ELSE {_list(C.BILLABLE)}[k % 3 + 1] END AS feasibility_status
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "evp": "SELECT ev.*, coalesce(pl.plan, 'BASIC') AS plan, coalesce(pl.quota, 3) AS quota, coalesce(pl.rate, 10) AS rate FROM ev LEFT JOIN pl ON lower(ev.slug) = pl.slug",
    "cap": "SELECT source AS registry_id, doc_id AS captured_seq, text AS payload FROM documents",
    "sec": "SELECT page_id % 8 AS jurisdiction_id, page_id AS position, url AS section_url, html FROM pages",
    "cl": """SELECT o_orderkey AS entry_id, CAST(c_nationkey AS BIGINT) AS jurisdiction_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'release'
        WHEN o_orderstatus = 'F' THEN 'rule_update' WHEN o_orderstatus = 'O' THEN 'coverage' ELSE 'source_update' END AS entry_type,
        'Order ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS summary, o_orderdate AS published_at
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "sr": f"""SELECT s_suppkey AS source_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'layer-' || s_suppkey END AS layer_name,
        CASE WHEN s_suppkey % 10 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(s_suppkey AS INTEGER)) END AS last_retrieved_at, s_acctbal >= 0 AS active,
        {_list(list(C.AUTHORITY_RANK))}[s_suppkey % 7 + 1] AS kind, s_suppkey % 8 AS jurisdiction_id FROM supplier""",
    # requests in jurisdictions, cities first
    "rj": """SELECT pt.*, jr.jurisdiction_id, jr.slug, jr.coverage_status FROM pt LEFT JOIN jr ON u > x1 AND u < x2 AND v > y1 AND v < y2
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY jr.jurisdiction_type IS DISTINCT FROM 'city', jr.slug) = 1""",
    # edges of parcels in degrees
    "pe": """SELECT parcel_id, jurisdiction_id, apn, unnest([
          {'a': gx, 'b': gy, 'c': gx + 0.875e0, 'd': gy}, {'a': gx + 0.875e0, 'b': gy, 'c': gx + wt, 'd': gy + 0.875e0},
          {'a': gx + wt, 'b': gy + 0.875e0, 'c': gx, 'd': gy + 0.875e0}, {'a': gx, 'b': gy + 0.875e0, 'c': gx, 'd': gy}]) AS e, gx, gy FROM pc""",
    "pd": """SELECT parcel_id, jurisdiction_id, apn, gx, gy, e.a / 1024e0 - 124e0 AS ax, e.b / 1024e0 + 32.5e0 AS ay, e.c / 1024e0 - 124e0 AS cx, e.d / 1024e0 + 32.5e0 AS cy FROM pe""",
    # request-parcel edges nearby, in the tangent scale of the point
    "near": """SELECT rj.request_id, pd.parcel_id, pd.apn, ax, ay, cx, cy, lon, lat,
          6378137e0 * (pi() / 180) * cos(radians(lat)) / sqrt(1 - 0.00669437999014e0 * power(sin(radians(lat)), 2)) AS kx,
          6378137e0 * (1 - 0.00669437999014e0) * (pi() / 180) / power(1 - 0.00669437999014e0 * power(sin(radians(lat)), 2), 1.5e0) AS ky
        FROM rj JOIN pd ON rj.jurisdiction_id = pd.jurisdiction_id AND u BETWEEN gx - 1 AND gx + 2 AND v BETWEEN gy - 1 AND gy + 2""",
    "gap": """SELECT request_id, parcel_id, any_value(apn) AS apn,
          sum(CASE WHEN (ay > lat) <> (cy > lat) AND lon < (cx - ax) * (lat - ay) / (cy - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd,
          sqrt(min(power((ax - lon) * kx + t * (cx - ax) * kx, 2) + power((ay - lat) * ky + t * (cy - ay) * ky, 2))) AS d
        FROM (SELECT *, least(1e0, greatest(0e0, -((ax - lon) * kx * (cx - ax) * kx + (ay - lat) * ky * (cy - ay) * ky)
              / (power((cx - ax) * kx, 2) + power((cy - ay) * ky, 2)))) AS t FROM near) GROUP BY 1, 2""",
    "pm": """SELECT request_id, parcel_id, odd AND d > 0 AS inside, CASE WHEN odd AND d > 0 THEN 0e0 ELSE d END AS dist FROM gap WHERE odd OR d <= 25
        QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY odd AND d > 0 DESC, CASE WHEN odd AND d > 0 THEN 0 ELSE d END, apn) = 1""",
    # parcel-zone pairs; the slanted side never reaches a district edge, so widths average exactly
    "pz": """SELECT parcel_id, zone_id, zone_code, greatest(0e0, least(gy + 0.875, y2) - greatest(gy, y1)) * 0.5 *
          (greatest(0e0, least(gx + 0.875, x2) - greatest(gx, x1)) + greatest(0e0, least(gx + wt, x2) - greatest(gx, x1))) AS units
        FROM pc JOIN zn USING (jurisdiction_id) WHERE gx <= x2 AND gx + 0.875 >= x1 AND gy <= y2 AND gy + 0.875 >= y1""",
    "po": "SELECT parcel_id, overlay_id, overlay_type, severity FROM pc JOIN ovs ON gx <= x2 AND gx + 0.875 >= x1 AND gy <= y2 AND gy + 0.875 >= y1",
    "cr": "SELECT * FROM rl WHERE is_current QUALIFY row_number() OVER (PARTITION BY jurisdiction_id, upper(zone_code), project_type ORDER BY version DESC, rule_id DESC) = 1",
}


def with_tables(body: str, recursive: bool = False, **extra: str) -> str:
    """Prefix SQL with the derived tables it mentions, in dependency order."""
    known = {**CTE, **extra}
    word = re.compile(r"(?:\b(?:FROM|JOIN)|,)\s+(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b", re.I)
    order: list[str] = []
    open_: list[str] = []

    def visit(text: str) -> None:
        for name in word.findall(text):
            if name in known and name not in order and name not in open_:
                open_.append(name)
                visit(known[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{n} AS ({known[n]})" for n in order) + " " + body
