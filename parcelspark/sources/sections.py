"""Municipal-code pages to section rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import text as T


def select_urls(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Pages of a run: the first per (jurisdiction, URL) by position; where a run asks for a limit, the
    first ``cap`` of these per jurisdiction. Both steps shrink before the shuffle."""
    rest = [c for c in pages.columns if c not in ("jurisdiction_id", "section_url")]
    first = pages.where("section_url <> ''").groupBy("jurisdiction_id", "section_url").agg(
        F.min_by(F.struct(*rest), "position").alias("_p")
    ).select("jurisdiction_id", "section_url", "_p.*")
    if cap is None:
        return first
    w = Window.partitionBy("jurisdiction_id").orderBy("position")
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def read_sections(pages: DataFrame, *, cap: int | None = None, min_chars: int = 0, hint_chars: int | None = None) -> DataFrame:
    """Section rows with text, hash, heading and numbering; those under ``min_chars`` are left out.

    ``pages``: jurisdiction_id, position, section_url, html. Without a heading numbers are looked for in the
    text, whole unless ``hint_chars`` says how much of its start.
    """
    texts = select_urls(pages, cap).withColumn("raw_text", T.clean_text(F.col("html"))).withColumn("heading", T.heading(F.col("html")))
    nums = T.with_node_id(T.numbering(F.col("heading"), F.col("raw_text"), hint_chars), F.col("section_url"))
    s = texts.where(F.length(F.trim("raw_text")) >= min_chars).withColumn("_n", nums)
    return s.select(
        "jurisdiction_id", "section_url", "position", "raw_text", T.content_hash(F.col("raw_text")).alias("content_hash"), "heading", "_n.*",
        T.section_label(F.col("_n"), F.coalesce("heading", F.lit(""))).alias("section_label"), F.lit("medium").alias("confidence"),
    )


def search_terms(hints: DataFrame, phrases: list[str] = C.SEARCH_PHRASES) -> DataFrame:
    """``slug, terms``: a city's own terms first, then the general ones, without repeats."""
    general = F.array(*[F.lit(p) for p in phrases])
    own = F.coalesce("search_terms", F.array().cast("array<string>"))
    return hints.select("slug", F.array_distinct(F.filter(F.concat(own, general), lambda t: t != "")).alias("terms"))
