"""Validation rules as expressions over the value of a field.

Rules are declared once and compiled to either form: long (a row for each record and field, an issue is a row) or wide (a record stays
one row, each rule and field is a condition of it, nothing is exploded or shuffled). A disabled rule leaves no expression in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.text import NON_WS, WS, digits, is_blank, present, strip
from cleanloom.plans.config import CANONICAL_FIELDS, QualityConfig

TEXT_FIELDS = ("first_name", "last_name", "company", "city", "district", "address")
# What the columns of a rule may hold, as patterns of the whole stripped value.
EMAIL = f"\\A{NON_WS.replace('[^', '[^@')}+@{NON_WS.replace('[^', '[^@')}+\\.{NON_WS.replace('[^', '[^@')}+\\z"
PHONE = f"\\A\\+?[0-9{WS[1:-1]}().-]{{7,}}\\z"
E164 = r"\A\+90[1-9][0-9]{9}\z"

SAFE, AMBIGUOUS, UNSUPPORTED, NOT_APPLICABLE = "SAFE", "AMBIGUOUS", "UNSUPPORTED", "NOT_APPLICABLE"


@dataclass(frozen=True)
class Cell:
    """A value with what rules may look at beside it. field is a column in the long form and a name in the wide one."""

    value: Column
    field: Column | str
    city: Column
    not_text: Column

    def one_of(self, fields: Sequence[str]) -> Column:
        return F.lit(self.field in fields) if isinstance(self.field, str) else self.field.isin(*fields)


@dataclass(frozen=True)
class Rule:
    """raises: Column of a cell that is true where there is an issue."""

    id: str
    fields: tuple[str, ...]
    raises: Callable[[Cell, QualityConfig], Column]
    category: str
    code: str
    message: str
    eligibility: Callable[[Column], Column] | str = UNSUPPORTED


_RULES: dict[str, Rule] = {}


def register_rule(rule: Rule) -> Rule:
    """Adds a rule; ids are unique. Issues come in order of registration."""
    if rule.id in _RULES:
        raise ValueError(f"a rule {rule.id} is registered already")
    _RULES[rule.id] = rule
    return rule


def rules() -> tuple[Rule, ...]:
    return tuple(_RULES.values())


def phone_eligibility(v: Column) -> Column:
    """SAFE where the digits of a number settle its international form."""
    d, s = digits(v), strip(v)
    ten = (F.length(d) == 10) & d.rlike("^[3-9]")
    sure = (F.length(d) == 11) & d.startswith("0") | (F.length(d) == 12) & d.startswith("90") | ten | s.rlike(PHONE) & (F.length(d) >= 10)
    return F.when(s.rlike(E164), NOT_APPLICABLE).when(sure, SAFE).otherwise(AMBIGUOUS)


def _lengths(x: Cell, c: QualityConfig) -> Column:
    if isinstance(x.field, str):
        return F.length(x.value) > c.max_lengths.get(x.field, 2**31 - 1)
    most = F.coalesce(*(F.when(x.field == f, F.lit(n)) for f, n in c.max_lengths.items()), F.lit(2**31 - 1))
    return F.length(x.value) > most


def _mismatch(x: Cell, c: QualityConfig) -> Column:
    known = F.create_map(*[y for k, ds in c.city_districts.items() for y in (F.lit(k), F.array(*map(F.lit, ds)))])
    allowed = F.try_element_at(known, strip(x.city))
    return present(x.value) & present(x.city) & allowed.isNotNull() & ~F.array_contains(allowed, strip(x.value))


def _form(test: Callable[[Column], Column]) -> Callable[[Cell, QualityConfig], Column]:
    """An issue where there is a value and its stripped form passes the test."""
    return lambda x, c: present(x.value) & test(strip(x.value))


def _outside(names: Callable[[QualityConfig], Sequence[str]]) -> Callable[[Cell, QualityConfig], Column]:
    return lambda x, c: present(x.value) & ~strip(x.value).isin(*names(c))


def _districts(c: QualityConfig) -> list[str]:
    return sorted({d for ds in c.city_districts.values() for d in ds})


def _untidy(x: Cell, c: QualityConfig) -> Column:
    return x.value.isNotNull() & ((x.value != strip(x.value)) | x.value.rlike(WS + "{2,}"))


for _rule in (
    Rule("address.min_length", ("address",), _form(lambda s: F.length(s) < 5), "format", "address_too_short", "address is too short"),
    Rule("company.min_length", ("company",), _form(lambda s: F.length(s) < 2), "format", "company_too_short", "company is too short"),
    Rule("cross_field.city_district", ("district",), _mismatch, "cross_field", "city_district_mismatch", "district does not belong to the city", AMBIGUOUS),
    Rule("email.syntax", ("email",), _form(lambda s: ~s.rlike(EMAIL)), "format", "invalid_email_syntax", "not an e-mail address", AMBIGUOUS),
    Rule("location.city_known", ("city",), _outside(lambda c: list(c.city_districts)), "location", "unknown_city", "city is not in the list"),
    Rule("location.district_known", ("district",), _outside(_districts), "location", "unknown_district", "district is not in the list"),
    Rule("phone.format", ("phone",), _form(lambda s: ~s.rlike(PHONE)), "format", "invalid_phone_format", "not a phone number", AMBIGUOUS),
    Rule("phone.tr_e164", ("phone",), _form(lambda s: ~s.rlike(E164)), "format", "invalid_tr_e164", "not in international form", phone_eligibility),
    Rule("required.missing", CANONICAL_FIELDS, lambda x, c: x.one_of(c.required) & is_blank(x.value), "required", "required_missing", "a required value is missing", NOT_APPLICABLE),
    Rule("text.max_length", TEXT_FIELDS, _lengths, "length", "text_too_long", "text is too long"),
    Rule("text.blank", CANONICAL_FIELDS, lambda x, c: x.value.isNotNull() & (strip(x.value) == ""), "format", "blank_text", "only white space", SAFE),
    Rule("type.string", CANONICAL_FIELDS, lambda x, c: x.value.isNotNull() & x.not_text, "format", "invalid_type", "not a text"),
    Rule("text.noncanonical_whitespace", CANONICAL_FIELDS, _untidy, "whitespace", "noncanonical_whitespace", "white space at an end or doubled", SAFE),
):
    register_rule(_rule)


def record_fields(records: DataFrame, key: str = "row_number") -> DataFrame:
    """One row for each record and canonical field: key, pos, field_name, value, not_text, and the record's city as city_value.

    Fields that the table lacks are null; columns of another type than string come as their text, marked not_text.
    """
    kinds = dict(records.dtypes)
    one = lambda i, f: F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field_name"), (F.col(f"`{f}`").cast("string") if f in kinds else F.lit(None).cast("string")).alias("value"), F.lit(kinds.get(f, "string") not in ("string", "void")).alias("not_text"))
    city = F.col("city").cast("string") if "city" in kinds else F.lit(None).cast("string")
    return records.select(F.col(key), city.alias("city_value"), F.inline(F.array(*(one(i, f) for i, f in enumerate(CANONICAL_FIELDS)))))


ISSUE = "struct<rule_no:int,rule_id:string,severity:string,code:string,message:string,normalization_eligibility:string>"


def issue_array(config: QualityConfig) -> Column:
    """The issues of one (field, value) row, in order of the rules."""
    out = []
    for no, r in enumerate(rules()):
        if r.id in config.disabled:
            continue
        v = F.col("value")
        eligible = F.lit(r.eligibility) if isinstance(r.eligibility, str) else r.eligibility(v)
        issue = F.struct(
            F.lit(no).alias("rule_no"), F.lit(r.id).alias("rule_id"), F.lit(config.severities.get(r.category, "error")).alias("severity"),
            F.lit(r.code).alias("code"), F.lit(r.message).alias("message"), eligible.alias("normalization_eligibility"),
        )
        cell = Cell(v, F.col("field_name"), F.col("city_value"), F.col("not_text"))
        out.append(F.when(F.col("field_name").isin(*r.fields) & F.coalesce(r.raises(cell, config), F.lit(False)), issue))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast(f"array<{ISSUE}>")


def validate_fields(fields: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """(record, field) rows with the array ``issues``."""
    return fields.withColumn("issues", issue_array((config or QualityConfig()).check()))


def issues(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row for each issue: key, field_name, rule_id, severity, code, message, value, normalization_eligibility. Rows with equal keys are records of their own."""
    v = validate_fields(record_fields(records, key), config)
    return v.select(key, "field_name", "value", F.inline("issues")).select(key, "field_name", "rule_id", "severity", "code", "message", "value", "normalization_eligibility")


def severity_counts(issue_rows: Column) -> list[Column]:
    of = lambda s: F.size(F.filter(issue_rows, lambda i: i["severity"] == s)).alias(f"{s}_count")
    return [of(s) for s in ("error", "warning", "info")]


@dataclass(frozen=True)
class Condition:
    """A rule at a field of a record in the wide form; name is the column that says whether there is an issue."""

    no: int
    rule: Rule
    pos: int
    field: str
    name: str
    severity: str


def text_values(records: DataFrame) -> dict[str, Column]:
    """Each canonical field as text; null where the table lacks it."""
    return {f: F.col(f"`{f}`").cast("string") if f in records.columns else F.lit(None).cast("string") for f in CANONICAL_FIELDS}


def not_texts(records: DataFrame) -> frozenset[str]:
    """Fields whose columns are of another type than string."""
    kinds = dict(records.dtypes)
    return frozenset(f for f in CANONICAL_FIELDS if kinds.get(f, "string") not in ("string", "void"))


def conditions(values: dict[str, Column], odd: frozenset[str], config: QualityConfig, prefix: str) -> tuple[list[Condition], dict[str, Column]]:
    """Every rule at every field it looks at, in order of the rules, then fields, and the columns that hold their outcomes."""
    found, columns = [], {}
    for no, r in enumerate(rules()):
        for pos, f in enumerate(CANONICAL_FIELDS):
            if f in r.fields and r.id not in config.disabled:
                name = f"{prefix}{no}_{pos}"
                found.append(Condition(no, r, pos, f, name, config.severities.get(r.category, "error")))
                columns[name] = F.coalesce(r.raises(Cell(values[f], f, values["city"], F.lit(f in odd)), config), F.lit(False))
    return found, columns


def counts_by(found: Sequence[Condition], pick: Callable[[Condition], bool]) -> Column:
    return sum((F.col(x.name).cast("long") for x in found if pick(x)), F.lit(0).cast("long"))


def wide_counts(found: Sequence[Condition]) -> dict[str, Column]:
    return {f"{s}_count": counts_by(found, lambda x, s=s: x.severity == s) for s in ("error", "warning", "info")}


def conditioned(records: DataFrame, config: QualityConfig | None, keep: Sequence[str] | None = None) -> tuple[DataFrame, list[Condition]]:
    """The records (or some of their columns) with the outcome of every condition, in one projection."""
    found, columns = conditions(text_values(records), not_texts(records), (config or QualityConfig()).check(), "_c")
    return records.select(*(f"`{k}`" for k in (records.columns if keep is None else keep)), *(v.alias(k) for k, v in columns.items())), found


def record_results(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row for each record: key, error_count, warning_count, info_count, is_valid."""
    t, found = conditioned(records, config, [key])
    return t.select(key, *(v.alias(k) for k, v in wide_counts(found).items())).withColumn("is_valid", F.col("error_count") == 0)


def issue_counts(records: DataFrame, by: str = "rule_id", config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """(rule_id or field_name, issue_count)."""
    return issues(records, config, key).groupBy(by).agg(F.count("*").alias("issue_count"))


def validation_summary(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row: record_count, valid_count, invalid_count, the counts by severity and both issue maps, from one pass."""
    t, found = conditioned(records, config, [key])
    by = {"issues_by_rule": lambda x: x.rule.id, "issues_by_field": lambda x: x.field}
    names = {m: sorted({of(x) for x in found}) for m, of in by.items()}
    n = t.select(*(v.alias(k) for k, v in wide_counts(found).items()), *(counts_by(found, lambda x, of=of, k=k: of(x) == k).alias(f"{m}_{i}") for m, of in by.items() for i, k in enumerate(names[m])))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    r = n.agg(
        F.count("*").alias("record_count"), F.count_if(F.col("error_count") == 0).alias("valid_count"), F.count_if(F.col("error_count") > 0).alias("invalid_count"),
        *(total(f"{s}_count").alias(f"{s}_count") for s in ("error", "warning", "info")), *(total(f"{m}_{i}").alias(f"{m}_{i}") for m in by for i in range(len(names[m]))),
    )
    maps = [F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names[m])), F.array(*(F.col(f"{m}_{i}") for i in range(len(names[m]))))), lambda k, v: v > 0).alias(m) for m in by]
    return r.select("record_count", "valid_count", "invalid_count", "error_count", "warning_count", "info_count", *maps)


def rows_with_issues(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """Wide form: the records with ``issues`` (in order of rules, then fields), severity counts and is_valid."""
    t, found = conditioned(records, config)
    values = text_values(records)

    def issue(x: Condition) -> Column:
        eligible = F.lit(x.rule.eligibility) if isinstance(x.rule.eligibility, str) else x.rule.eligibility(values[x.field])
        return F.struct(
            F.lit(x.no).alias("rule_no"), F.lit(x.pos).alias("pos"), F.lit(x.field).alias("field_name"), F.lit(x.rule.id).alias("rule_id"), F.lit(x.severity).alias("severity"),
            F.lit(x.rule.code).alias("code"), F.lit(x.rule.message).alias("message"), values[x.field].alias("value"), eligible.alias("normalization_eligibility"),
        )

    listed = F.array_compact(F.array(*(F.when(F.col(x.name), issue(x)) for x in found)))
    return t.select(*(f"`{c}`" for c in records.columns), listed.alias("issues"), *(v.alias(k) for k, v in wide_counts(found).items())).withColumn("is_valid", F.col("error_count") == 0)
