"""Deterministic normalisation with an audit trail, over (field, value) rows or, in the wide form, over records as they stand.

A value passes the steps of its field in a fixed order. Each step that changes it leaves an entry with the value before the whole
chain and the value after the step. Only fields that are SAFE change; nothing is ever invented for a missing value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.text import collapse, digits, nfc, strip
from cleanloom.operators.validation import E164, TEXT_FIELDS, Condition, conditions, not_texts, record_fields, text_values, validate_fields
from cleanloom.plans.config import CANONICAL_FIELDS, QualityConfig


@dataclass(frozen=True)
class Step:
    id: str
    fields: tuple[str, ...]
    change: Callable[[Column, QualityConfig], Column]


_STEPS: dict[str, Step] = {}


def register_step(step: Step) -> Step:
    if step.id in _STEPS:
        raise ValueError(f"a step {step.id} is registered already")
    _STEPS[step.id] = step
    return step


def steps() -> tuple[Step, ...]:
    return tuple(_STEPS.values())


def lower_domain(v: Column) -> Column:
    """What follows the last @ in lower case."""
    domain = F.substring_index(v, "@", -1)
    return F.when(v.contains("@"), F.concat(F.left(v, F.length(v) - F.length(domain)), F.lower(domain))).otherwise(v)


def international_phone(v: Column) -> Column:
    """+90 and ten digits where the digits settle it, else unchanged."""
    d = digits(v)
    n = F.length(d)
    out = F.when((n == 12) & d.startswith("90"), F.concat(F.lit("+"), d)).when((n == 11) & d.startswith("0"), F.concat(F.lit("+90"), F.substring(d, 2, 10))).when((n == 10) & d.rlike("^[3-9]"), F.concat(F.lit("+90"), d))
    return F.when(out.rlike(E164), out).otherwise(v)


def company_suffix(v: Column, c: QualityConfig) -> Column:
    """The first listed legal form that ends the name, or stands after a blank in it, in its canonical spelling.

    The end is compared letter for letter, so a name that merely ends alike (ATLAS) is changed too; that is the rule.
    """
    out: Column | None = None
    for have, want in c.company_suffixes:
        ends = v.endswith(have)
        inside = v.contains(f" {have}")
        ending = F.concat(F.left(v, F.length(v) - len(have)), F.lit(want))
        within = F.replace(v, F.lit(f" {have}"), F.lit(f" {want}"))
        out = F.when(ends, ending).when(inside, within) if out is None else out.when(ends, ending).when(inside, within)
    return v if out is None else out.otherwise(v)


def place_alias(v: Column, aliases: dict[str, str]) -> Column:
    s = strip(v)
    if not aliases:
        return s
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(m, s), F.try_element_at(m, F.lower(s)), s)


register_step(Step("text.trim_whitespace", TEXT_FIELDS, lambda v, c: strip(v)))
register_step(Step("text.collapse_whitespace", TEXT_FIELDS, lambda v, c: collapse(v)))
register_step(Step("text.nfc_unicode", TEXT_FIELDS, lambda v, c: nfc(v)))
register_step(Step("email.trim", ("email",), lambda v, c: strip(v)))
register_step(Step("email.lower_domain", ("email",), lambda v, c: lower_domain(v)))
register_step(Step("phone.tr_e164", ("phone",), lambda v, c: international_phone(v)))
register_step(Step("company.canonical_suffix", ("company",), company_suffix))
register_step(Step("location.city_alias", ("city",), lambda v, c: place_alias(v, dict(c.city_aliases))))
register_step(Step("location.city_case", ("city",), lambda v, c: place_alias(v, dict(c.city_aliases))))
register_step(Step("location.district_alias", ("district",), lambda v, c: place_alias(v, dict(c.district_aliases))))
register_step(Step("location.district_case", ("district",), lambda v, c: place_alias(v, dict(c.district_aliases))))
register_step(Step("address.whitespace_cleanup", ("address",), lambda v, c: collapse(v)))


def field_eligibility(issues: Column) -> Column:
    """SAFE, unless an error says otherwise; the last such error in order of the rules wins. Warnings never block."""
    blocking = F.filter(issues, lambda i: (i["severity"] == "error") & (i["normalization_eligibility"] != "SAFE"))
    # a missing value has nothing to normalise, whatever its own eligibility says
    last = F.get(blocking, F.size(blocking) - 1)
    return F.coalesce(F.when(last["rule_id"] == "required.missing", "NOT_APPLICABLE").otherwise(last["normalization_eligibility"]), F.lit("SAFE"))


def normalize_fields(fields: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """(record, field) rows with ``eligibility`` get ``normalized`` and ``transformations`` (rule_id, original_value, normalized_value, status).

    Each step is a column of its own; steps that no row of the plan can reach are never emitted.
    """
    c = (config or QualityConfig()).check()
    t, last, audit = fields.withColumn("_s", F.col("value")), "_s", []
    on = (F.col("eligibility") == "SAFE") & F.col("value").isNotNull()
    names = []
    for k, s in enumerate(x for x in steps() if x.id not in c.disabled):
        name = f"_s{k}"
        mine = on & F.col("field_name").isin(*s.fields)
        before = F.col(last)
        after = s.change(F.when(mine, before), c)
        t = t.withColumn(name, F.when(mine, after).otherwise(before))
        audit.append(F.when(~F.col(name).eqNullSafe(before), F.struct(F.lit(s.id).alias("rule_id"), F.col("value").alias("original_value"), F.col(name).alias("normalized_value"), F.lit("CHANGED").alias("status"))))
        names.append(name)
        last = name
    t = t.withColumn("normalized", F.col(last)).withColumn("transformations", F.filter(F.array(*audit), lambda x: x.isNotNull()))
    return t.drop("_s", *names)


def eligible_fields(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """(record, field) rows with their issues and eligibility."""
    return validate_fields(record_fields(records, key), config).withColumn("eligibility", field_eligibility(F.col("issues")))


def normalized_fields(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """key, field_name, value, eligibility, normalized, transformations, issues. Blank-to-blank and unsafe fields keep their value."""
    return normalize_fields(eligible_fields(records, config, key), config)


def transformations(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """The audit: key, field_name, rule_id, original_value, normalized_value, status."""
    # an inner inline would infer a filter on the array, which the optimizer pushes through every step and so multiplies the chain
    return normalized_fields(records, config, key).select(key, "field_name", F.inline_outer("transformations")).where("rule_id IS NOT NULL")


def audit_counts(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """(rule_id, change_count)."""
    return transformations(records, config, key).groupBy("rule_id").agg(F.count("*").alias("change_count"))


def wide_eligibility(found: Sequence[Condition], values: dict[str, Column]) -> dict[str, Column]:
    """field_eligibility() of each field from the outcomes of the conditions."""
    out = {}
    for f in CANONICAL_FIELDS:
        blocks = []
        for x in reversed([x for x in found if x.field == f and x.severity == "error"]):
            says = x.rule.eligibility
            says = F.lit("NOT_APPLICABLE" if x.rule.id == "required.missing" else says) if isinstance(says, str) else says(values[f])
            blocks.append(F.when(F.col(x.name) & (says != "SAFE"), says))
        out[f] = F.coalesce(*blocks, F.lit("SAFE"))
    return out


def normalized_columns(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> tuple[DataFrame, list[Condition]]:
    """Records in one row each: key, value and normalized of each field as _v_<field> and _n_<field>, audit, and the outcomes of the conditions."""
    c = (config or QualityConfig()).check()
    value = {f: F.col(f"_v_{f}") for f in CANONICAL_FIELDS}
    t = records.select(F.col(key), *(v.alias(f"_v_{f}") for f, v in text_values(records).items()))
    found, columns = conditions(value, not_texts(records), c, "_c")
    t = t.select("*", *(v.alias(k) for k, v in columns.items()))
    t = t.withColumns({f"_e_{f}": (e == "SAFE") & value[f].isNotNull() for f, e in wide_eligibility(found, value).items()})
    last, audit = {f: f"_v_{f}" for f in CANONICAL_FIELDS}, {f: [] for f in CANONICAL_FIELDS}
    for k, s in enumerate(x for x in steps() if x.id not in c.disabled):
        mine = [f for f in CANONICAL_FIELDS if f in s.fields]
        new = {f: F.when(F.col(f"_e_{f}"), s.change(F.when(F.col(f"_e_{f}"), F.col(last[f])), c)).otherwise(F.col(last[f])) for f in mine}
        t = t.withColumns({f"_s{k}_{f}": v for f, v in new.items()})
        for f in mine:
            now = F.col(f"_s{k}_{f}")
            note = F.struct(F.lit(s.id).alias("rule_id"), value[f].alias("original_value"), now.alias("normalized_value"), F.lit("CHANGED").alias("status"))
            audit[f].append(F.when(~now.eqNullSafe(F.col(last[f])), note))
            last[f] = f"_s{k}_{f}"
    kind = "array<struct<rule_id:string,original_value:string,normalized_value:string,status:string>>"
    notes = [n for f in CANONICAL_FIELDS for n in audit[f]]
    changed = sum(((~F.col(last[f]).eqNullSafe(value[f])).cast("long") for f in CANONICAL_FIELDS), F.lit(0).cast("long"))
    listed = (F.array_compact(F.array(*notes)) if notes else F.array()).cast(kind)
    return t.select(key, *value.values(), *(F.col(last[f]).alias(f"_n_{f}") for f in CANONICAL_FIELDS), changed.alias("changed_field_count"), listed.alias("transformations"), *columns), found


def normalize_records(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """Normalised records: key, the canonical fields, changed_field_count, transformations (in order of fields, then steps)."""
    t, _ = normalized_columns(records, config, key)
    return t.select(key, *(F.col(f"_n_{f}").alias(f) for f in CANONICAL_FIELDS), "changed_field_count", "transformations")


def normalization_summary(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row: record_count, changed_records, changed_fields, transformation_count."""
    r = normalize_records(records, config, key).select(F.col("changed_field_count").alias("c"), F.size("transformations").alias("t"))
    return r.agg(F.count("*").alias("record_count"), F.count_if(F.col("c") > 0).alias("changed_records"), F.coalesce(F.sum("c"), F.lit(0)).alias("changed_fields"), F.coalesce(F.sum("t"), F.lit(0)).alias("transformation_count"))
