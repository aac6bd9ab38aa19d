"""Snapshots, section changes and latest-version queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import text as T
from parcelspark.operators import rules, versioning
from parcelspark.operators.skew import dealt, latest_by, number_rows, top_per_key
from parcelspark.queries import domain as D
from parcelspark.queries.domain import with_tables
from parcelspark.queries.registry import query


@query("w01_latest_version", with_tables("SELECT rule_id, jurisdiction_id, project_type, version FROM cr"))
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return rules.current_rules(D.zoning_rules(spark, sf)).select("rule_id", "jurisdiction_id", "project_type", "version")


@query("w01_latest_line", "SELECT l_suppkey, max(l_shipdate) = max(l_shipdate) AS ok, last(l_orderkey ORDER BY l_orderkey, l_linenumber) AS l_orderkey FROM lineitem GROUP BY 1")
def latest_line(spark: SparkSession, sf: str) -> DataFrame:
    li = D.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.lit(True).alias("ok"))
    return latest_by(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "ok", "l_orderkey")


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    return D.captures(spark, sf).select("registry_id", "captured_seq", T.bytes_hash(F.col("payload")).alias("content_hash"))


# the stored log holds the first version of every source that starts with src1
_OLD = "SELECT registry_id, sha256(payload) AS content_hash, 1 AS version FROM cap WHERE registry_id LIKE 'src1%' QUALIFY row_number() OVER (PARTITION BY registry_id ORDER BY captured_seq) = 1"


@query("w02_append_snapshots", with_tables("""SELECT registry_id, content_hash, captured_seq, version FROM (SELECT f.*, CAST(coalesce(o.top, 0) + row_number() OVER (PARTITION BY f.registry_id ORDER BY captured_seq, content_hash) AS BIGINT) AS version
    FROM (SELECT registry_id, sha256(payload) AS content_hash, min(captured_seq) AS captured_seq FROM cap GROUP BY 1, 2) f LEFT JOIN (SELECT registry_id, max(version) AS top FROM old GROUP BY 1) o USING (registry_id)
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.registry_id = f.registry_id AND old.content_hash = f.content_hash))""", old=_OLD))
def append_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    c = hashed(spark, sf)
    old = c.where("registry_id LIKE 'src1%'").groupBy("registry_id").agg(F.min_by("content_hash", "captured_seq").alias("content_hash")).withColumn("version", F.lit(1))
    return versioning.append_snapshots(c, old).withColumn("version", F.col("version").cast("long"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of this run: one per site and jurisdiction."""
    host = F.regexp_extract("section_url", r"^[a-z]+://([^/]+)", 1)
    p = D.section_pages(spark, sf).select("jurisdiction_id", host.alias("section_url"), "position", T.content_hash(F.col("html")).alias("content_hash"))
    return p


_HOST = """SELECT jurisdiction_id, regexp_extract(section_url, '^[a-z]+://([^/]+)', 1) AS section_url, position, sha256(trim(regexp_replace(html, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS content_hash FROM sec"""


@query("w03_section_changes", with_tables("""SELECT n.jurisdiction_id, n.section_url, CASE WHEN o.content_hash IS NULL THEN 'inserted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
    FROM (SELECT * FROM host QUALIFY row_number() OVER (PARTITION BY jurisdiction_id, section_url ORDER BY position DESC) = 1) n
    LEFT JOIN (SELECT * FROM host WHERE length(section_url) > 16 QUALIFY row_number() OVER (PARTITION BY jurisdiction_id, section_url ORDER BY position) = 1) o USING (jurisdiction_id, section_url)""", host=_HOST))
def section_changes(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf)
    keys = ["jurisdiction_id", "section_url"]
    new = latest_by(p, keys, ["position"])
    old = p.where(F.length("section_url") > 16).groupBy(*keys).agg(F.min_by("content_hash", "position").alias("content_hash"))
    return versioning.section_changes(new, old).select(*keys, "outcome")


@query("w03_section_history", with_tables("""SELECT jurisdiction_id, section_url, position, CASE WHEN lag(content_hash) OVER w IS NULL THEN 'inserted' WHEN lag(content_hash) OVER w = content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
    FROM host WINDOW w AS (PARTITION BY jurisdiction_id, section_url ORDER BY position)""", host=_HOST))
def section_history(spark: SparkSession, sf: str) -> DataFrame:
    h = versioning.section_history(_pages(spark, sf), ["jurisdiction_id", "section_url"], "position")
    return h.select("jurisdiction_id", "section_url", "position", "outcome")


@query("w03_number_rows", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS BIGINT) AS rn FROM documents")
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return number_rows(d, ["lang"], "n_chars", ["doc_id"]).select("doc_id", F.col("rn").cast("long").alias("rn"))


@query("w07_nearest_parcels", with_tables("SELECT request_id, parcel_id FROM pm WHERE NOT inside"))
def nearest_parcels(spark: SparkSession, sf: str) -> DataFrame:
    from parcelspark.operators import spatial

    req = D.located(spark, sf).select("request_id", "lon", "lat")
    pts = spatial.match_jurisdiction(spatial.distinct_points(req), D.jurisdictions(spark, sf))
    near = spatial.match_parcel(pts, D.parcels(spark, sf)).where("match_method = 'st_intersects'")
    return req.join(dealt(near), ["lon", "lat"]).select("request_id", "parcel_id")


@query("w05_top_entries", with_tables("SELECT jurisdiction_id, entry_id, CAST(row_number() OVER (PARTITION BY jurisdiction_id ORDER BY published_at DESC, entry_id) AS INTEGER) AS rn FROM cl QUALIFY rn <= 5"))
def top_entries(spark: SparkSession, sf: str) -> DataFrame:
    e = D.changelog_entries(spark, sf).select("jurisdiction_id", "entry_id", "published_at")
    return top_per_key(e, ["jurisdiction_id"], [F.col("published_at").desc(), "entry_id"], 5).select("jurisdiction_id", "entry_id", "rn")
