"""Scalar functions over addresses, texts, pages and rule values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import text as T
from parcelspark.functions import values as V
from parcelspark.operators import geocode
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.ADDRESS_TOKENS.items()) + "}"


@query("s01_normalize_address", with_tables(f"""SELECT request_id, array_to_string(list_transform(string_split(trim(regexp_replace(upper(regexp_replace(address, '[.,]+', ' ', 'g')), '\\s+', ' ', 'g')), ' '),
    lambda t: coalesce({_MAP}[t], t)), ' ') AS normalized FROM rq"""))
def normalize_address(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests(spark, sf).select("request_id", T.normalize_address(F.col("address")).alias("normalized"))


@query("s02_request_fingerprint", with_tables("""SELECT request_id, sha256('{"bedrooms":' || coalesce(CAST(bedrooms AS VARCHAR), 'null') || ',"consumer_id":"' || consumer_id || '","existing_structure":"' || existing_structure_type ||
    '","normalized_address":"' || normalized_address || '","options":{"include_envelope":' || include_envelope || ',"near_transit":' || near_transit || '},"project_type":"' || project_type ||
    '","proposed_height_ft":' || printf('%.1f', proposed_height_ft) || ',"target_sqft":' || printf('%.1f', target_sqft) || '}') AS fingerprint FROM rq"""))
def request_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    fp = T.request_fingerprint(
        F.col("consumer_id"), T.normalize_address(F.col("address")), F.col("project_type"), F.col("target_sqft"), F.col("bedrooms"),
        F.col("proposed_height_ft"), F.col("existing_structure_type"), F.struct("include_envelope", "near_transit"),
    )
    return D.requests(spark, sf).select("request_id", fp.alias("fingerprint"))


_SPACE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query("s03_content_hash", f"SELECT doc_id, sha256(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("s04_payload_hash", """SELECT doc_id, sha256(text) AS raw_hash, sha256('{"layer":"' || source || '","query":{"f":"geojson","where":"1=1"}}') AS layer_hash FROM documents""")
def payload_hash(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.struct(F.lit("geojson").alias("f"), F.lit("1=1").alias("where"))
    return D.table(spark, sf, "documents").select(
        "doc_id", T.bytes_hash(F.col("text")).alias("raw_hash"), T.json_hash(query=asked, layer=F.col("source")).alias("layer_hash")
    )


@query("s05_consumer_hash", "SELECT c_custkey, 'c_' || left(sha256(c_name), 32) AS gateway_id, 'c_' || left(sha256(sha256(c_name)), 32) AS direct_id FROM customer")
def consumer_hash(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_name")
    return D.table(spark, sf, "customer").select("c_custkey", T.consumer_hash(n).alias("gateway_id"), T.direct_consumer_hash(n).alias("direct_id"))


@query("s06_units", f"""SELECT p_partkey, round(p_size * 0.3048e0, 9) AS m, round(p_size * CAST({V.FEET_PER_METER!r} AS DOUBLE), 9) AS ft, round(p_retailprice * CAST({V.SQFT_PER_SQM!r} AS DOUBLE), 6) AS sqft, round(p_retailprice * CAST({V.SQM_PER_SQFT!r} AS DOUBLE), 6) AS sqm FROM part""")
def units(spark: SparkSession, sf: str) -> DataFrame:
    a, s = F.col("p_retailprice"), F.col("p_size")
    return D.table(spark, sf, "part").select(
        "p_partkey", F.round(V.feet_to_meters(s), 9).alias("m"), F.round(V.meters_to_feet(s), 9).alias("ft"),
        F.round(V.sqm_to_sqft(a), 6).alias("sqft"), F.round(V.sqft_to_sqm(a), 6).alias("sqm"),
    )


@query("s07_uniform_inset", """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(greatest(CASE WHEN l_returnflag = 'A' THEN l_quantity END, CASE WHEN l_linestatus = 'O' THEN l_tax * 100 END, CASE WHEN l_discount > 0.05 THEN l_discount * 100 END), 4) AS inset_ft FROM lineitem""")
def uniform_inset(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))
    rear, front = F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 100), F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 100)
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.uniform_inset_ft(side, rear, front).alias("inset_ft"))


@query("s08_flood_severity", with_tables("SELECT overlay_id, severity FROM ovs WHERE overlay_type = 'flood'"))
def flood_severity(spark: SparkSession, sf: str) -> DataFrame:
    o = D.overlays(spark, sf).where("overlay_type = 'flood'")
    return o.select("overlay_id", V.flood_severity(F.col("raw_value"), F.coalesce("designation", "name")).alias("severity"))


@query("s09_fire_severity", with_tables("SELECT overlay_id, severity FROM ovs WHERE overlay_type = 'fire'"))
def fire_severity(spark: SparkSession, sf: str) -> DataFrame:
    o = D.overlays(spark, sf).where("overlay_type = 'fire'")
    return o.select("overlay_id", V.fire_severity(F.col("raw_value"), F.coalesce("designation", "name")).alias("severity"))


@query("s10_hit_severity", with_tables("""SELECT overlay_id, severity, overlay_type IN ('flood','fire','coastal','hillside') AND severity <> 'info' AS hazard, CASE WHEN overlay_id % 3 = 0 THEN 'given' ELSE severity END AS recorded FROM ovs"""))
def hit_severity(spark: SparkSession, sf: str) -> DataFrame:
    sev = V.hit_severity(F.col("overlay_type"), F.lit("hit"), F.col("raw_value"), F.coalesce("designation", "name"))
    raw = F.when(F.col("overlay_id") % 3 == 0, F.create_map(F.lit("severity"), F.lit("given"))).otherwise(F.col("raw_value"))
    return D.overlays(spark, sf).select(
        "overlay_id", sev.alias("severity"), V.is_hazard(F.col("overlay_type"), sev).alias("hazard"), F.element_at(V.with_severity(raw, sev), "severity").alias("recorded")
    )


@query("s11_single_family", with_tables("""SELECT zone_id, zone_code, CASE WHEN regexp_matches(zone_code, '^(R1|RS|RE|RA|RW1|RD)') THEN true WHEN regexp_matches(zone_code, '^(C|M|R2|R3|R4|R5|RAS)') THEN false END AS single_family FROM zn"""))
def single_family(spark: SparkSession, sf: str) -> DataFrame:
    return D.zones(spark, sf).select("zone_id", "zone_code", V.is_single_family(F.col("zone_code")).alias("single_family"))


@query("s12_public_flag", with_tables(f"SELECT rule_id, CASE compliance_flag WHEN '{C.MATCHES}' THEN 'compliant' WHEN 'not_applicable' THEN NULL ELSE compliance_flag END AS flag FROM rl"))
def public_flag(spark: SparkSession, sf: str) -> DataFrame:
    return D.zoning_rules(spark, sf).select("rule_id", V.public_flag(F.col("compliance_flag")).alias("flag"))


_JSON = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 1 THEN CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END
    WHEN 2 THEN '"1,' || CAST(CAST(l_quantity AS INT) + 100 AS VARCHAR) || ' sq ft"' WHEN 3 THEN '"' || l_returnflag || '-' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '"' WHEN 4 THEN '"Required"' WHEN 5 THEN '{"conditional": true}' ELSE '"5-10"' END AS j,
    l_linenumber % 7 AS k, CAST(l_quantity AS INT) AS q, l_returnflag FROM lineitem"""


def json_values(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_linenumber") % 7
    j = (
        F.when(k == 0, q).when(k == 1, F.when(F.col("l_returnflag") == "R", "true").otherwise("false"))
        .when(k == 2, F.concat(F.lit('"1,'), (F.col("l_quantity").cast("int") + 100).cast("string"), F.lit(' sq ft"')))
        .when(k == 3, F.concat(F.lit('"'), "l_returnflag", F.lit("-"), q, F.lit('"'))).when(k == 4, '"Required"').when(k == 5, '{"conditional": true}').otherwise('"5-10"')
    )
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.parse_value(j).alias("v"))


@query("s13_strict_values", with_tables("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 0 THEN CAST(q AS DOUBLE) END AS num, CASE WHEN k = 1 THEN l_returnflag = 'R' END AS bool FROM js", js=_JSON))
def strict_values(spark: SparkSession, sf: str) -> DataFrame:
    return json_values(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", V.strict_number(F.col("v")).alias("num"), V.strict_bool(F.col("v")).alias("bool"))


@query("s14_lenient_values", with_tables("""SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN CAST(q AS DOUBLE) WHEN 2 THEN 1000e0 + q + 100 WHEN 3 THEN CAST(-q AS DOUBLE) END AS num,
    CASE k WHEN 0 THEN CASE q WHEN 1 THEN true END WHEN 1 THEN l_returnflag = 'R' WHEN 4 THEN true END AS bool FROM js""", js=_JSON))
def lenient_values(spark: SparkSession, sf: str) -> DataFrame:
    return json_values(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", V.lenient_number(F.col("v")).alias("num"), V.lenient_bool(F.col("v")).alias("bool"))


@query("s15_field_choice", with_tables("""SELECT request_id, CASE WHEN project_type = 'attached_adu' THEN 'max_height_attached_ft' WHEN near_transit THEN 'max_height_near_transit_ft' ELSE 'max_height_detached_standard_ft' END AS height_field,
    CASE WHEN bedrooms >= 2 THEN 'max_size_sqft_2br' ELSE 'max_size_sqft_1br' END AS size_field FROM rq"""))
def field_choice(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests(spark, sf).select("request_id", V.height_field(F.col("project_type"), F.col("near_transit")).alias("height_field"), V.size_field(F.col("bedrooms")).alias("size_field"))


# a heading in one of several styles, from the page number
def headings(spark: SparkSession, sf: str) -> DataFrame:
    h = F.expr("""CASE page_id % 5 WHEN 0 THEN concat('Sec. ', page_id % 30 + 1, '.', page_id % 90 + 10, ' A.33 Units') WHEN 1 THEN concat('Title ', page_id % 20, 'A Chapter ', page_id % 40, '.')
        WHEN 2 THEN 'Section 17' WHEN 3 THEN 'chapter 9.2B of 20.30.460' ELSE 'General' END""")
    nurl = F.expr("concat('https://x.test/c?nodeId=TIT', page_id % 9 + 1, 'ZO_CH', page_id % 30, '.5_', page_id % 30, '.5.10')")
    p = D.table(spark, sf, "pages").select("page_id", "html", h.alias("h"), nurl.alias("nurl"))
    return p.withColumn("nums", T.numbering(F.col("h"), F.col("html")))


_T = "CASE page_id % 5 WHEN 0 THEN CAST(page_id % 30 + 1 AS VARCHAR) WHEN 1 THEN (page_id % 20) || 'A' WHEN 3 THEN '20' END"
_C = "CASE page_id % 5 WHEN 0 THEN (page_id % 30 + 1) || '.' || (page_id % 90 + 10) WHEN 1 THEN CAST(page_id % 40 AS VARCHAR) WHEN 3 THEN '9.2B' END"
_S = "CASE page_id % 5 WHEN 0 THEN (page_id % 30 + 1) || '.' || (page_id % 90 + 10) WHEN 2 THEN '17' WHEN 3 THEN '20.30.460' END"


@query("s16_numbering", f"SELECT page_id, {_T} AS title_number, {_C} AS chapter_number, {_S} AS section_number FROM pages")
def numbering(spark: SparkSession, sf: str) -> DataFrame:
    return headings(spark, sf).select("page_id", "nums.*")


_NODE = f"""SELECT page_id, coalesce({_T}, (page_id % 9 + 1) || 'Z') AS title_number, coalesce({_C}, (page_id % 30) || '.5') AS chapter_number,
    coalesce({_S}, (page_id % 30) || '.5.10') AS section_number FROM pages"""


@query("s17_node_numbering", _NODE)
def node_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return headings(spark, sf).select("page_id", T.with_node_id(F.col("nums"), F.col("nurl")).alias("n")).select("page_id", "n.*")


@query("s18_section_label", f"SELECT page_id, coalesce(nullif(concat_ws(' / ', {_T}, {_C}, {_S}), ''), 'General') AS label FROM pages")
def section_label(spark: SparkSession, sf: str) -> DataFrame:
    return headings(spark, sf).select("page_id", T.section_label(F.col("nums"), F.col("h")).alias("label"))


_CLEAN = """SELECT page_id, html, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '(<script\\b.*?</script\\s*>)|(<style\\b.*?</style\\s*>)', chr(10), 'gsi'), '<[^>]*>', chr(10), 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)),
    lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> ''), chr(10)) AS body FROM pages"""


@query("s19_clean_text", with_tables("SELECT page_id, length(body) AS chars, sha256(body) AS body_hash FROM cleaned", cleaned=_CLEAN))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    b = T.clean_text(F.col("html"))
    return D.table(spark, sf, "pages").select("page_id", b.alias("b")).select("page_id", F.length("b").cast("long").alias("chars"), F.sha2("b", 256).alias("body_hash"))


@query("s19_heading", """SELECT page_id, nullif(left(trim(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<h1\\b[^>]*>(.*?)</h1\\s*>', 1, 'si'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), 300), '') AS heading FROM pages""")
def heading(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages").select("page_id", T.heading(F.col("html"), ["h1"]).alias("heading"))


_KW = " OR ".join(f"contains(lower(text), '{k}')" for k in ["ine", "the ", *C.SECTION_KEYWORDS])


@query("s20_keyword_match", f"SELECT doc_id, {' OR '.join(f'contains(lower(text), {C.sql_literal(k)})' for k in C.SECTION_KEYWORDS)} AS relevant, {_KW} AS widened FROM documents")
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return D.table(spark, sf, "documents").select("doc_id", T.matches_keywords(t).alias("relevant"), T.matches_keywords(t, ["ine", "the ", *C.SECTION_KEYWORDS]).alias("widened"))


_HINT = " UNION ALL ".join(f"SELECT {C.sql_literal(s)} AS slug, {D._list(c)} AS chapters" for s, _, c in C.JURISDICTION_HINTS)


@query("s21_url_hints", with_tables("SELECT slug, count(*) AS pages FROM pages JOIN hints ON len(list_filter(chapters, lambda c: contains(lower(url || ' ' || html), lower(c)))) > 0 GROUP BY 1", hints=_HINT))
def url_hints(spark: SparkSession, sf: str) -> DataFrame:
    # eight hint rows at most per page: the hint list rides along as a constant array
    hints = F.array(*[F.struct(F.lit(s).alias("slug"), F.array(*[F.lit(c) for c in ch]).alias("chapters")) for s, _, ch in C.JURISDICTION_HINTS])
    hay = F.lower(F.concat_ws(" ", "url", "html"))
    p = D.table(spark, sf, "pages").select(hay.alias("hay"))
    hit = F.transform(F.filter(hints, lambda h: F.exists(h["chapters"], lambda c: F.contains(F.col("hay"), F.lower(c)))), lambda h: h["slug"])
    return p.select(F.explode(hit).alias("slug")).groupBy("slug").agg(F.count("*").alias("pages"))


@query("s22_code_url_parts", """SELECT page_id, 'city_' || (page_id % 7) AS client, CASE WHEN page_id % 3 > 0 THEN 'code_' || (page_id % 11) END AS code, CASE WHEN page_id % 3 = 2 THEN '0-0-0-' || page_id END AS doc_id FROM pages""")
def code_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr("""concat('https://lib.test/codes/city_', page_id % 7, '/latest', IF(page_id % 3 > 0, concat('/code_', page_id % 11), ''), IF(page_id % 3 = 2, concat('/0-0-0-', page_id, '?q=1'), ''))""")
    return D.table(spark, sf, "pages").select("page_id", T.code_url_parts(url).alias("u")).select("page_id", "u.*")


_RESP = """SELECT event_id, ['census', 'google', 'mapbox', 'nominatim'][k % 4 + 1] AS provider, k % 3 AS matches, ['ROOFTOP', 'RANGE_INTERPOLATED', 'APPROXIMATE'][user_id % 3 + 1] AS location_type, k % 5 = 0 AS partial,
    k / 100e0 AS relevance, k % 35 AS place_rank, CASE WHEN k % 10 = 3 THEN 'House' ELSE 'city' END AS address_type, user_id, k FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
_CONF = """SELECT *, CASE WHEN matches = 0 THEN 'low' WHEN provider = 'census' THEN CASE WHEN matches = 1 THEN 'high' ELSE 'medium' END
    WHEN provider = 'google' THEN CASE WHEN partial OR location_type = 'APPROXIMATE' THEN 'low' WHEN location_type = 'ROOFTOP' THEN CASE WHEN matches = 1 THEN 'high' ELSE 'medium' END ELSE 'medium' END
    WHEN provider = 'mapbox' THEN CASE WHEN relevance >= 0.9 THEN 'high' WHEN relevance >= 0.6 THEN 'medium' ELSE 'low' END
    ELSE CASE WHEN place_rank >= 30 OR address_type = 'House' THEN 'high' WHEN place_rank >= 26 THEN 'medium' ELSE 'low' END END AS confidence FROM resp"""


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Geocoder responses landed by four providers."""
    k = F.get_json_object("props", "$.k").cast("int")
    r = D.table(spark, sf, "events").select(
        "event_id", "user_id", k.alias("k"), D.choose(["census", "google", "mapbox", "nominatim"], k % 4).alias("provider"), (k % 3).alias("matches"),
        D.choose(["ROOFTOP", "RANGE_INTERPOLATED", "APPROXIMATE"], F.col("user_id") % 3).alias("location_type"), (k % 5 == 0).alias("partial"),
        (k / 100.0).alias("relevance"), (k % 35).alias("place_rank"), F.when(k % 10 == 3, "House").otherwise("city").alias("address_type"),
    )
    return r.withColumn("confidence", V.geocode_confidence(*[F.col(c) for c in ("provider", "matches", "location_type", "partial", "relevance", "place_rank", "address_type")]))


@query("s23_geocode_confidence", with_tables("SELECT event_id, provider, confidence FROM conf", resp=_RESP, conf=_CONF))
def geocode_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("event_id", "provider", "confidence")


@query("j11_provider_chain", with_tables("""SELECT user_id, coalesce(first(event_id ORDER BY event_id) FILTER (WHERE confidence IN ('high', 'medium')), min(event_id)) AS event_id, bool_or(confidence IN ('high', 'medium')) AS resolved FROM conf GROUP BY 1""", resp=_RESP, conf=_CONF))
def provider_chain(spark: SparkSession, sf: str) -> DataFrame:
    r = responses(spark, sf).select(
        "user_id", F.col("event_id").cast("string").alias("provider"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), "confidence", F.col("event_id").alias("priority")
    )
    return geocode.chain_providers(r, "user_id").select("user_id", F.col("provider").cast("long").alias("event_id"), "resolved")


@query("j10_geocode_lookup", with_tables("""SELECT request_id, CASE WHEN c_acctbal >= -900 THEN lon END AS lon, CASE WHEN c_acctbal >= -900 THEN lat END AS lat,
    CASE WHEN c_acctbal < -800 THEN 'low' WHEN bedrooms = 1 THEN 'medium' ELSE 'high' END AS geocode_confidence FROM pt"""))
def geocode_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return geocode.geocode(D.ask(spark, sf), D.geocodes(spark, sf)).select("request_id", "lon", "lat", "geocode_confidence")


@query("s24_confidence_cap", with_tables("SELECT user_id, CASE WHEN bool_or(confidence = 'low') THEN 'low' ELSE 'medium' END AS capped FROM conf GROUP BY 1", resp=_RESP, conf=_CONF))
def confidence_cap(spark: SparkSession, sf: str) -> DataFrame:
    # at most three labels reach the array
    r = responses(spark, sf).groupBy("user_id").agg(F.collect_set("confidence").alias("c"))
    return r.select("user_id", V.cap_confidence(F.col("c")).alias("capped"))


@query("s25_changelog_type", with_tables("""SELECT entry_id, CASE entry_type WHEN 'release' THEN 'source_ingested' WHEN 'coverage' THEN 'coverage_change' WHEN 'source_update' THEN 'source_refreshed' ELSE entry_type END AS change_type,
    coalesce(summary, title) AS summary FROM cl"""))
def changelog_type(spark: SparkSession, sf: str) -> DataFrame:
    return D.changelog_entries(spark, sf).select("entry_id", V.changelog_type(F.col("entry_type")).alias("change_type"), F.coalesce("summary", "title").alias("summary"))


@query("s26_existing_structure", with_tables("SELECT request_id, CASE WHEN existing_structure_type IN ('single_family', 'multifamily') THEN true END AS existing FROM rq"))
def existing_structure(spark: SparkSession, sf: str) -> DataFrame:
    return D.requests(spark, sf).select("request_id", V.existing_structure_flag(F.col("existing_structure_type")).alias("existing"))


@query("s28_iso_utc", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso FROM events""")
def iso_utc(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").select("event_id", T.iso_utc(F.col("ts")).alias("iso"))
