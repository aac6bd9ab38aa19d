"""Offline comparison of extracted rule values with state baselines, and the issues it raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark import catalogs as C
from parcelspark.functions import values as V
from parcelspark.functions.text import lookup

FLAG_RANK = {C.RESTRICTIVE: 0, C.REVIEW: 1, C.MATCHES: 2, C.NOT_APPLICABLE: 3}


def current_baselines(baselines: DataFrame) -> DataFrame:
    """First open baseline per field, whatever its project scope."""
    row = F.struct("num", "bool", "json", "legal_citation", F.col("source_url").alias("baseline_url"))
    first = baselines.where("effective_to IS NULL").groupBy("field_name").agg(F.min_by(row, F.struct("effective_from", "legal_citation")).alias("b"))
    return first.select("field_name", V.value(F.col("b.num"), F.col("b.bool"), F.col("b.json")).alias("baseline"), "b.legal_citation", "b.baseline_url")


def _py(c: Column) -> Column:
    """A boolean as a note spells it."""
    return F.when(c, "True").otherwise("False")


# case -> flag, issue type, severity
OUTCOMES: dict[str, tuple[str, str | None, str]] = {
    "informational": (C.NOT_APPLICABLE, None, "info"),
    "no_baseline": (C.REVIEW, "no_state_baseline", "info"),
    "missing": (C.REVIEW, "value_missing", "info"),
    "not_numeric": (C.REVIEW, "value_not_numeric", "info"),
    "not_boolean": (C.REVIEW, "value_not_boolean", "info"),
    "value_not_boolean": (C.REVIEW, "value_not_boolean", "info"),
    "floor_met": (C.MATCHES, None, "info"),
    "floor_missed": (C.RESTRICTIVE, "more_restrictive_than_state_baseline", "warning"),
    "ceiling_met": (C.MATCHES, None, "info"),
    "ceiling_missed": (C.RESTRICTIVE, "more_restrictive_than_state_baseline", "warning"),
    "equal": (C.MATCHES, None, "info"),
    "stricter": (C.RESTRICTIVE, "more_restrictive_than_state_baseline", "warning"),
    "looser": (C.REVIEW, "over_permissive_anomaly", "critical"),
    "default": (C.MATCHES, None, "info"),
    "depends": (C.REVIEW, "conditional_needs_facts", "warning"),
    "unknown": (C.REVIEW, "unknown_kind", "info"),
}
# Note per case; {n} {w} numbers, {g} {m} booleans, {c} citation, {l} law, {f} field.
NOTES: dict[str, str] = {
    "informational": "informational / optional local opt-in ({l}); not flagged",
    "no_baseline": "no state_rule_baselines row for '{f}'; cannot validate automatically - needs human review",
    "missing": "value not extracted; cannot verify against state baseline",
    "not_numeric": "value or baseline not numeric; cannot verify",
    "not_boolean": "value or baseline not boolean; cannot verify",
    "value_not_boolean": "value not boolean; cannot verify",
    "floor_met": "{n} meets or exceeds state floor of {w}",
    "floor_missed": "{n} is below the state floor of {w} ({c}); local rule is more restrictive than the state baseline",
    "ceiling_met": "{n} is within the state ceiling of {w}",
    "ceiling_missed": "{n} exceeds the state ceiling of {w} ({c}); local rule is more restrictive than the state baseline",
    "equal": "matches the required state value {m}",
    "stricter": "state requires {m} ({c}); local value {g} is more restrictive than state law allows",
    "looser": "state contemplates {m} ({c}); local value {g} is more permissive than state law and needs review",
    "default": "value {g} is the compliant default; lawful without further facts",
    "depends": "value {g} is lawful only under specific conditions ({c}); needs review to confirm those conditions apply",
    "unknown": "unhandled comparison kind for {f}",
}


def _case() -> Column:
    """Which case a row with ``kind``, ``baseline`` and the coerced values falls in."""
    kind, num, want, got, must = (F.col(c) for c in ("kind", "_num", "_want", "_got", "_must"))
    missing = V.value_is_null(F.col("value"))
    numeric = kind.isin("floor", "ceiling")
    return (
        F.when(kind == "informational", "informational").when(F.col("baseline").isNull(), "no_baseline")
        .when(~kind.isin("floor", "ceiling", "must_equal", "conditional"), "unknown").when(missing, "missing")
        .when(numeric & (num.isNull() | want.isNull()), "not_numeric")
        .when(kind == "floor", F.when(num >= want, "floor_met").otherwise("floor_missed"))
        .when(kind == "ceiling", F.when(num <= want, "ceiling_met").otherwise("ceiling_missed"))
        .when((kind == "must_equal") & (got.isNull() | must.isNull()), "not_boolean").when(got.isNull(), "value_not_boolean")
        .when(kind == "must_equal", F.when(got == must, "equal").when(got == F.col("restrictive"), "stricter").otherwise("looser"))
        .otherwise(F.when(F.coalesce(got == must, F.lit(False)), "default").otherwise("depends"))
    )


def validate_rules(attrs: DataFrame, catalog: DataFrame, baselines: DataFrame) -> DataFrame:
    """Attributes of known fields with ``flag, issue_type, severity, expected, observed, note``.

    ``attrs``: rule_id, field_name, value. Each value is coerced once, classified into a case,
    and everything else is looked up by case.
    """
    cat = catalog.select("field_name", "kind", "law", "restrictive")
    j = attrs.join(cat, "field_name").join(current_baselines(baselines), "field_name", "left")
    v, b = F.col("value"), F.col("baseline")
    j = j.withColumns({"_num": V.lenient_number(v), "_want": V.lenient_number(b), "_got": V.lenient_bool(v), "_must": V.lenient_bool(b)})
    j = j.withColumn("_case", _case())
    by_case = lambda i: lookup(F.col("_case"), {k: o[i] for k, o in OUTCOMES.items() if o[i] is not None})
    boolean = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False")
    numeric = F.col("kind").isin("floor", "ceiling")
    none = F.col("_case").isin("informational", "no_baseline", "unknown")
    plain = F.col("_case").isin("informational", "no_baseline", "unknown", "missing", "not_numeric", "not_boolean", "value_not_boolean")
    expected = F.when(~none, F.when(numeric, F.col("_want").cast("string")).otherwise(F.col("_must").cast("string")))
    observed = F.when(plain, V.value_text(v)).when(numeric, F.col("_num").cast("string")).otherwise(F.col("_got").cast("string"))
    note = lookup(F.col("_case"), NOTES)
    words = {
        "{n}": F.col("_num").cast("string"), "{w}": F.col("_want").cast("string"), "{g}": boolean("_got"), "{m}": boolean("_must"),
        "{c}": F.coalesce(F.nullif("legal_citation", F.lit("")), F.col("law")), "{l}": F.col("law"), "{f}": F.col("field_name"),
    }
    for mark, text in words.items():
        note = F.replace(note, F.lit(mark), F.coalesce(text, F.lit("None")))
    return j.withColumns(
        {"flag": by_case(0), "issue_type": by_case(1), "severity": by_case(2), "expected": expected, "observed": observed, "note": note}
    ).drop("_num", "_want", "_got", "_must", "_case")


def stored_values(attrs: DataFrame) -> DataFrame:
    """Attributes with the ``value`` that validation compares: the stored JSON, not its numeric mirror."""
    return attrs.select("rule_id", "field_name", V.parse_value(F.col("value_json")).alias("value"), "source_url")


def counters(rules: DataFrame, attrs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``jurisdiction_id, rules, attributes, issues, more_restrictive`` of candidate rules (review pending).

    Rules without attributes and attributes of fields outside the catalog count as seen.
    """
    pending = rules.where("review_status = 'pending'").select("rule_id", "jurisdiction_id")
    seen = attrs.groupBy("rule_id").agg(F.count("*").alias("a"))
    due = F.col("issue_type").isNotNull() & (F.col("flag") != C.MATCHES)
    found = verdicts.groupBy("rule_id").agg(F.count_if(due).alias("i"), F.count_if(due & (F.col("flag") == C.RESTRICTIVE)).alias("m"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return pending.join(seen, "rule_id", "left").join(found, "rule_id", "left").groupBy("jurisdiction_id").agg(
        F.count("*").alias("rules"), total("a", "attributes"), total("i", "issues"), total("m", "more_restrictive")
    )


def roll_up(verdicts: DataFrame) -> DataFrame:
    """Flag of each rule: the most severe of its attributes."""
    rank = F.coalesce(*[F.when(F.col("flag") == f, r) for f, r in FLAG_RANK.items()])
    return verdicts.groupBy("rule_id").agg(F.min_by("flag", rank).alias("compliance_flag"))


def open_issues(verdicts: DataFrame, existing: DataFrame) -> DataFrame:
    """Issues to queue: verdicts that warrant one and have none open for (rule, field, type).

    Optional columns ``notes`` and ``source_url`` of the attribute join the description.
    """
    have = set(verdicts.columns)
    part = lambda label, c: F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.concat(F.lit(label), F.col(c))) if c in have else F.lit(None)
    cite = F.concat(F.lit("State law: "), F.coalesce(F.nullif("legal_citation", F.lit("")), F.col("law")))
    text = F.concat_ws(
        " | ", F.col("note"), part("Local evidence: ", "notes"), cite, part("Baseline source: ", "baseline_url"), part("Local source: ", "source_url")
    )
    keys = ["rule_id", "field_name", "issue_type"]
    due = verdicts.where(F.col("issue_type").isNotNull() & (F.col("flag") != C.MATCHES))
    new = due.join(existing.where("status = 'open'").select(*keys), keys, "left_anti")
    return new.select(
        *keys, "severity", F.lit("open").alias("status"), F.lit("state_baseline_check").alias("detected_by"),
        F.col("expected").alias("expected_value"), F.col("observed").alias("observed_value"), text.alias("description"),
    )


def baseline_drift(catalog: DataFrame, baselines: DataFrame) -> DataFrame:
    """Fields on which the two catalogs disagree in operator, value or scope."""
    ops = F.coalesce(*[F.when(F.col("kind") == k, o) for k, o in C.KIND_OPERATOR.items()])
    c = catalog.select("field_name", ops.alias("catalog_operator"), F.col("num").alias("catalog_num"), F.col("bool").alias("catalog_bool"), F.sort_array("project_types").alias("catalog_scope"))
    b = baselines.select("field_name", F.col("operator").alias("state_operator"), F.col("num").alias("state_num"), F.col("bool").alias("state_bool"), F.sort_array("applies_to").alias("state_scope"))
    j = c.join(b, "field_name", "full_outer")
    family = lambda o: F.when(o.isin("floor", "gte"), "min").when(o.isin("ceiling", "lte"), "max").otherwise(o)
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return j.withColumn("operator_drift", ~family(F.col("catalog_operator")).eqNullSafe(family(F.col("state_operator")))).withColumn(
        "value_drift", differs("catalog_num", "state_num") | differs("catalog_bool", "state_bool")
    ).withColumn("scope_drift", differs("catalog_scope", "state_scope")).where("operator_drift OR value_drift OR scope_drift")
