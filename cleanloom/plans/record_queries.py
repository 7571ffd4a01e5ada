"""Queries of the record-quality operators over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions.session import table
from cleanloom.functions.text import WHITE
from cleanloom.operators import checks, evaluation, golden, mapping, normalization, profiling, quality, validation
from cleanloom.plans import benchmarks, harness
from cleanloom.plans.config import CANONICAL_FIELDS, CITY_ALIASES, CITY_DISTRICTS, COMPANY_SUFFIXES, DISTRICT_ALIASES, SEVERITIES
from cleanloom.plans.crm import VIEW, contacts

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}


def _add(name: str, f: Query, sql: str | Callable[[], str] | None = None) -> None:
    _Q[name] = f
    if sql is not None:
        _SQL[name] = sql


# --- pieces of SQL ----------------------------------------------------------------------------------------------------

_CHARS = " || ".join(f"chr({ord(c)})" for c in WHITE)
_WSC = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE)


def S(v: str) -> str:
    return f"trim({v}, {_CHARS})"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_FIELDS_SQL = " UNION ALL ".join(f"SELECT row_number, {i} AS pos, '{f}' AS field_name, {f} AS value, city FROM crm" for i, f in enumerate(CANONICAL_FIELDS))
_BASE = f"WITH crm AS ({VIEW}), f AS ({_FIELDS_SQL})"
_E164 = r"^\+90[1-9][0-9]{9}$"
_PHONE = rf"^\+?[0-9{_WSC}().-]{{7,}}$"
_EMAIL = rf"^[^@{_WSC}]+@[^@{_WSC}]+\.[^@{_WSC}]+$"
_IN = lambda xs: "(" + ", ".join(map(_quote, xs)) + ")"
_ALLOWED = " OR ".join(f"({S('city')} = {_quote(c)} AND {S('value')} NOT IN {_IN(ds)})" for c, ds in CITY_DISTRICTS.items())
_HAS = f"(value IS NOT NULL AND {S('value')} <> '')"
_RULE_SQL = {
    "address.min_length": f"field_name = 'address' AND {_HAS} AND length({S('value')}) < 5",
    "company.min_length": f"field_name = 'company' AND {_HAS} AND length({S('value')}) < 2",
    "cross_field.city_district": f"field_name = 'district' AND {_HAS} AND ({_ALLOWED})",
    "email.syntax": f"field_name = 'email' AND {_HAS} AND NOT regexp_matches({S('value')}, '{_EMAIL}')",
    "location.city_known": f"field_name = 'city' AND {_HAS} AND {S('value')} NOT IN {_IN(CITY_DISTRICTS)}",
    "location.district_known": f"field_name = 'district' AND {_HAS} AND {S('value')} NOT IN {_IN([x for ds in CITY_DISTRICTS.values() for x in ds])}",
    "phone.format": f"field_name = 'phone' AND {_HAS} AND NOT regexp_matches({S('value')}, '{_PHONE}')",
    "phone.tr_e164": f"field_name = 'phone' AND {_HAS} AND NOT regexp_matches({S('value')}, '{_E164}')",
    "required.missing": f"NOT {_HAS}",
    "text.max_length": "((field_name IN ('first_name', 'last_name', 'city', 'district') AND length(value) > 100) OR (field_name = 'company' AND length(value) > 200) OR (field_name = 'address' AND length(value) > 500))",
    "text.blank": f"value IS NOT NULL AND {S('value')} = ''",
    "type.string": "FALSE",
    "text.noncanonical_whitespace": f"value IS NOT NULL AND (value <> {S('value')} OR regexp_matches(value, '[{_WSC}]{{2,}}'))",
}
_KIND = {r.id: (r.category, r.code) for r in validation.rules()}
_NO = {r.id: n for n, r in enumerate(validation.rules())}
_ISSUES = " UNION ALL ".join(f"SELECT row_number, {_NO[r]} AS rule_no, pos, field_name, '{r}' AS rule_id, '{SEVERITIES[_KIND[r][0]]}' AS severity, '{_KIND[r][1]}' AS code, value FROM f WHERE {p}" for r, p in _RULE_SQL.items())
_WITH_ISSUES = f"{_BASE}, i AS ({_ISSUES})"


def _rule_query(rule: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return validation.issues(contacts(spark, d)).where(F.col("rule_id") == rule).select("row_number", "field_name", "severity", "code", "value")

    return q


_add("crm_contacts", contacts, VIEW)
for _r in _RULE_SQL:
    if _r != "type.string":
        _add(f"val_{_r.replace('.', '_')}", _rule_query(_r), f"{_WITH_ISSUES} SELECT row_number, field_name, severity, code, value FROM i WHERE rule_id = '{_r}'")
# a table whose phone column holds numbers
_add(
    "val_type_string",
    lambda s, d: validation.issues(contacts(s, d).withColumn("phone", F.col("row_number"))).where("rule_id = 'type.string'").select("row_number", "field_name", "severity", "code", "value"),
    f"WITH crm AS ({VIEW}) SELECT row_number, 'phone' AS field_name, '{SEVERITIES[_KIND['type.string'][0]]}' AS severity, '{_KIND['type.string'][1]}' AS code, CAST(row_number AS VARCHAR) AS value FROM crm",
)
for _by in ("rule_id", "field_name"):
    _add(f"val_issue_counts_by_{_by}", lambda s, d, by=_by: validation.issue_counts(contacts(s, d), by), f"{_WITH_ISSUES} SELECT {_by}, count(*) AS issue_count FROM i GROUP BY 1")
_COUNTS = ", ".join(f"CAST(coalesce(sum(CASE WHEN i.severity = '{s}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {s}_count" for s in ("error", "warning", "info"))
_RECORDS = f"SELECT crm.row_number, {_COUNTS} FROM crm LEFT JOIN i ON crm.row_number = i.row_number GROUP BY 1"
_add("val_record_summary", lambda s, d: validation.record_results(contacts(s, d)), f"{_WITH_ISSUES} SELECT *, error_count = 0 AS is_valid FROM ({_RECORDS})")
_PAIRS = "SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {0} AS k, count(*) AS n FROM i GROUP BY 1)"


def _as_text(column: str) -> Column:
    """A map as key=value in order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(column)


_add(
    "val_summary",
    lambda s, d: validation.validation_summary(contacts(s, d)).withColumns({c: _as_text(c) for c in ("issues_by_rule", "issues_by_field")}),
    f"{_WITH_ISSUES} SELECT count(*) AS record_count, count(*) FILTER (error_count = 0) AS valid_count, count(*) FILTER (error_count > 0) AS invalid_count, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(warning_count) AS BIGINT) AS warning_count, CAST(sum(info_count) AS BIGINT) AS info_count, ({_PAIRS.format('rule_id')}) AS issues_by_rule, ({_PAIRS.format('field_name')}) AS issues_by_field FROM ({_RECORDS})",
)
_add(
    "val_rows_with_issues",
    lambda s, d: validation.rows_with_issues(contacts(s, d)).select("row_number", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["rule_id"], i["field_name"])), ",").alias("issue_list"), "is_valid"),
    f"{_WITH_ISSUES} SELECT crm.row_number, coalesce(string_agg(rule_id || ':' || field_name, ',' ORDER BY rule_no, pos), '') AS issue_list, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM crm LEFT JOIN i ON crm.row_number = i.row_number GROUP BY 1",
)

# --- normalisation ----------------------------------------------------------------------------------------------------

_D = r"regexp_replace(value, '[^0-9]', '', 'g')"
_SURE = f"((length({_D}) = 11 AND starts_with({_D}, '0')) OR (length({_D}) = 12 AND starts_with({_D}, '90')) OR (length({_D}) = 10 AND regexp_matches({_D}, '^[3-9]')) OR (regexp_matches({S('value')}, '{_PHONE}') AND length({_D}) >= 10))"
_ELIGIBLE = f"""CASE WHEN NOT {_HAS} THEN 'NOT_APPLICABLE'
  WHEN {_RULE_SQL['address.min_length']} THEN 'UNSUPPORTED' WHEN {_RULE_SQL['company.min_length']} THEN 'UNSUPPORTED'
  WHEN {_RULE_SQL['email.syntax']} THEN 'AMBIGUOUS'
  WHEN {_RULE_SQL['phone.tr_e164']} AND NOT {_SURE} THEN 'AMBIGUOUS' WHEN {_RULE_SQL['phone.format']} THEN 'AMBIGUOUS' ELSE 'SAFE' END"""


def _collapse(v: str) -> str:
    return f"regexp_replace({S(v)}, '[{_WSC}]+', ' ', 'g')"


def _suffix(v: str) -> str:
    parts = []
    for a, b in COMPANY_SUFFIXES:
        parts.append(f"WHEN ends_with({v}, {_quote(a)}) THEN concat(left({v}, length({v}) - {len(a)}), {_quote(b)}) WHEN contains({v}, {_quote(' ' + a)}) THEN replace({v}, {_quote(' ' + a)}, {_quote(' ' + b)})")
    return f"CASE {' '.join(parts)} ELSE {v} END"


def _alias(v: str, m: dict[str, str]) -> str:
    exact = " ".join(f"WHEN {v} = {_quote(a)} THEN {_quote(b)}" for a, b in m.items())
    low = " ".join(f"WHEN lower({v}) = {_quote(a)} THEN {_quote(b)}" for a, b in m.items())
    return f"CASE {exact} {low} ELSE {v} END"


_TEXT = _collapse("value")
_MAIL = f"concat(regexp_replace({S('value')}, '[^@]*$', ''), lower(regexp_extract({S('value')}, '[^@]*$')))"
_TEL = f"CASE WHEN length({_D}) = 12 AND starts_with({_D}, '90') THEN concat('+', {_D}) WHEN length({_D}) = 11 AND starts_with({_D}, '0') THEN concat('+90', substr({_D}, 2)) WHEN length({_D}) = 10 AND regexp_matches({_D}, '^[3-9]') THEN concat('+90', {_D}) ELSE value END"
_TEL = f"CASE WHEN regexp_matches({_TEL}, '{_E164}') THEN {_TEL} ELSE value END"
_NORMAL = f"""CASE WHEN eligibility <> 'SAFE' OR value IS NULL THEN value WHEN field_name = 'email' THEN {_MAIL} WHEN field_name = 'phone' THEN {_TEL}
  WHEN field_name = 'company' THEN {_suffix(_TEXT)} WHEN field_name = 'city' THEN {_alias(_TEXT, CITY_ALIASES)} WHEN field_name = 'district' THEN {_alias(_TEXT, DISTRICT_ALIASES)} ELSE {_TEXT} END"""
_NORM = f"{_BASE}, e AS (SELECT *, {_ELIGIBLE} AS eligibility FROM f), n AS (SELECT *, {_NORMAL} AS normalized FROM e)"
_add("eligibility_by_field", lambda s, d: normalization.eligible_fields(contacts(s, d)).groupBy("field_name", "eligibility").agg(F.count("*").alias("n")), f"{_NORM} SELECT field_name, eligibility, count(*) AS n FROM n GROUP BY 1, 2")
for _f in CANONICAL_FIELDS:
    _add(f"norm_{_f}", lambda s, d, f=_f: normalization.normalized_fields(contacts(s, d)).where(F.col("field_name") == f).select("row_number", "value", "eligibility", "normalized"), f"{_NORM} SELECT row_number, value, eligibility, normalized FROM n WHERE field_name = '{_f}'")
_add("norm_changed_records", lambda s, d: normalization.normalize_records(contacts(s, d)).select("row_number", "changed_field_count"), f"{_NORM} SELECT row_number, count(*) FILTER (normalized IS DISTINCT FROM value) AS changed_field_count FROM n GROUP BY 1")
_SAFE_TEXT = "eligibility = 'SAFE' AND value IS NOT NULL AND field_name NOT IN ('email', 'phone')"
_STEPS = {
    "text.trim_whitespace": f"{_SAFE_TEXT} AND {S('value')} <> value",
    "text.collapse_whitespace": f"{_SAFE_TEXT} AND {_TEXT} <> {S('value')}",
    "email.trim": f"eligibility = 'SAFE' AND field_name = 'email' AND {S('value')} <> value",
    "email.lower_domain": f"eligibility = 'SAFE' AND field_name = 'email' AND {_MAIL} <> {S('value')}",
    "phone.tr_e164": "eligibility = 'SAFE' AND field_name = 'phone' AND normalized <> value",
    "company.canonical_suffix": f"eligibility = 'SAFE' AND field_name = 'company' AND normalized <> {_TEXT}",
    "location.city_alias": f"eligibility = 'SAFE' AND field_name = 'city' AND normalized <> {_TEXT}",
    "location.district_alias": f"eligibility = 'SAFE' AND field_name = 'district' AND normalized <> {_TEXT}",
}
_add("norm_audit_counts", lambda s, d: normalization.audit_counts(contacts(s, d)), _NORM + " SELECT rule_id, change_count FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) AS change_count FROM n WHERE {v}" for k, v in _STEPS.items()) + ") WHERE change_count > 0")
_ALL_STEPS = " + ".join(f"(SELECT count(*) FROM n WHERE {v})" for v in _STEPS.values())
_add("norm_summary", lambda s, d: normalization.normalization_summary(contacts(s, d)), f"{_NORM} SELECT {_ALL_STEPS} AS transformation_count, count(*) AS record_count, count(*) FILTER (c > 0) AS changed_records, CAST(sum(c) AS BIGINT) AS changed_fields FROM (SELECT row_number, count(*) FILTER (normalized IS DISTINCT FROM value) AS c FROM n GROUP BY 1)")
_AGAIN = _ISSUES.replace("FROM f WHERE", "FROM g WHERE")
_QUALITY = f"{_NORM}, i AS ({_ISSUES}), c AS (SELECT row_number, normalized AS city FROM n WHERE field_name = 'city'), g AS (SELECT n.row_number, n.pos, n.field_name, n.normalized AS value, c.city FROM n JOIN c ON n.row_number = c.row_number), j AS ({_AGAIN})"
_STAGE = "SELECT '{0}' AS stage, crm.row_number, " + _COUNTS.replace("i.severity", "x.severity") + " FROM crm LEFT JOIN {1} x ON crm.row_number = x.row_number GROUP BY 2"
_add(
    "quality_pre_post_summary",
    lambda s, d: quality.quality_summary(contacts(s, d)),
    f"{_QUALITY} SELECT stage, count(*) AS record_count, count(*) FILTER (error_count = 0) AS valid_count, count(*) FILTER (error_count > 0) AS invalid_count, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(warning_count) AS BIGINT) AS warning_count, CAST(sum(info_count) AS BIGINT) AS info_count FROM ({_STAGE.format('pre', 'i')} UNION ALL {_STAGE.format('post', 'j')}) GROUP BY 1",
)
_WIDE = ", ".join(f"max(normalized) FILTER (field_name = '{f}') AS {f}" for f in CANONICAL_FIELDS)
_ERRORS = "(SELECT row_number AS k, count(*) AS e FROM {0} WHERE severity = 'error' GROUP BY 1)"
_add(
    "quality_records",
    lambda s, d: quality.quality_records(contacts(s, d)).select("row_number", *CANONICAL_FIELDS, "changed_field_count", "pre_error_count", "post_error_count", "is_valid"),
    f"{_QUALITY}, w AS (SELECT row_number, {_WIDE}, count(*) FILTER (normalized IS DISTINCT FROM value) AS changed_field_count FROM n GROUP BY 1) SELECT w.*, coalesce(p.e, 0) AS pre_error_count, coalesce(q.e, 0) AS post_error_count, coalesce(q.e, 0) = 0 AS is_valid FROM w LEFT JOIN {_ERRORS.format('i')} p ON p.k = w.row_number LEFT JOIN {_ERRORS.format('j')} q ON q.k = w.row_number",
)

# --- profiles ---------------------------------------------------------------------------------------------------------

_PROFILED = {
    "source_records": ("source_record_id", ["source_record_id", "source_name", "first_name", "last_name", "email", "phone", "company", "city", "district", "address", "updated_at", "ingested_at"]),
    "partner_records": ("source_record_id", ["source_name", "source_record_id", "given_name", "surname", "email_address", "mobile", "organization", "il", "mahalle", "street", "import_batch", "notes", "updated_at"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars", "client_code", "created_at"]),
}
_INT, _FLOAT = r"^-?[0-9]+$", r"^-?[0-9]+(\.[0-9]+)?$"


def _profile(t: str) -> Query:
    key, cols = _PROFILED[t]
    return lambda s, d: profiling.column_profiles(table(s, d, t), [key], columns=cols)


for _t, (_key, _cols) in _PROFILED.items():
    _long = " UNION ALL ".join(f"SELECT '{c}' AS name, {i} AS position, {_key} AS o, CAST({c} AS VARCHAR) AS v FROM {_t}" for i, c in enumerate(_cols))
    _vals = f"WITH v AS (SELECT *, {S('v')} AS s FROM ({_long})), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS r FROM v WHERE s <> '') WHERE r <= 1000)"
    _add(
        f"profile_{_t}",
        lambda s, d, t=_t: _profile(t)(s, d).select("name", "row_count", "non_null_count", "null_count", "blank_count", "unique_count", F.round("completeness_ratio", 9).alias("completeness_ratio"), F.round("uniqueness_ratio", 9).alias("uniqueness_ratio")),
        f"{_vals} SELECT name, row_count, row_count - null_count - blank_count AS non_null_count, null_count, blank_count, unique_count, round(coalesce((row_count - null_count - blank_count) / nullif(CAST(row_count AS DOUBLE), 0), 0), 9) AS completeness_ratio, round(coalesce(unique_count / nullif(CAST(row_count - null_count - blank_count AS DOUBLE), 0), 0), 9) AS uniqueness_ratio FROM (SELECT name, count(*) AS row_count, count(*) FILTER (v IS NULL) AS null_count, count(*) FILTER (s = '') AS blank_count, count(DISTINCT s) FILTER (s <> '') AS unique_count FROM v GROUP BY 1)",
    )
    _date = "(" + " OR ".join(f"year(try_strptime(s, '{x}')) >= 1" for x in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")) + ")"
    _shares = f"SELECT name, count(*) AS n, avg(CASE WHEN regexp_matches(s, '{_INT}') THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN regexp_matches(s, '{_FLOAT}') THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN lower(s) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN {_date} THEN 1.0 ELSE 0 END) AS d FROM top GROUP BY 1"
    _add(
        f"type_inference_{_t}",
        lambda s, d, t=_t: _profile(t)(s, d).select("name", "type_inference.inferred_type", "type_inference.confidence"),
        f"{_vals} SELECT name, CASE WHEN m < 0.95 THEN 'string' WHEN a = m THEN 'integer' WHEN b = m THEN 'float' WHEN c = m THEN 'boolean' ELSE 'date' END AS inferred_type, CASE WHEN m = 1 THEN 'high' WHEN m >= 0.95 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, greatest(a, b, c, d) AS m FROM ({_shares}))",
    )
    _pats = {"email_like": _EMAIL, "phone_like": _PHONE, "numeric_like": _FLOAT, "date_like": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"}
    _add(
        f"pattern_profile_{_t}",
        lambda s, d, t=_t: _profile(t)(s, d).select("name", F.inline("patterns")).select("name", "pattern_name", "match_count", "sample_size"),
        _vals + " " + " UNION ALL ".join(f"SELECT name, '{k}' AS pattern_name, count(*) FILTER (regexp_matches(s, '{p}')) AS match_count, count(*) AS sample_size FROM top GROUP BY 1" for k, p in _pats.items()),
    )

# --- mapping ----------------------------------------------------------------------------------------------------------


def _partner_plan(s: SparkSession, d: str) -> mapping.MappingPlan:
    return mapping.build_mapping_plan(_profile("partner_records")(s, d))


_MAPPED = {"first_name": "given_name", "last_name": "surname", "email": "email_address", "phone": "mobile", "company": "organization", "city": "il", "district": "mahalle", "address": "street"}
_add("schema_map_plan", lambda s, d: _partner_plan(s, d).to_df(s).select("source_column", "column_index", "normalized_header", "decision", "canonical_field", F.col("score").cast("double").alias("score"), F.size("evidence").alias("evidence_count")))
_add(
    "schema_map_decisions",
    lambda s, d: _partner_plan(s, d).to_df(s).where("decision = 'AUTO_MAP'").select("canonical_field", "source_column"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAPPED.items()) + ") t(canonical_field, source_column)",
)
_add(
    "schema_map_apply",
    lambda s, d: mapping.apply_plan(table(s, d, "partner_records"), _partner_plan(s, d), ["source_record_id"]).select("source_record_id", *CANONICAL_FIELDS),
    "SELECT source_record_id, " + ", ".join(f"{b} AS {a}" for a, b in _MAPPED.items()) + " FROM partner_records",
)

# --- contract checks --------------------------------------------------------------------------------------------------

_add("check_repeated_record_ids", lambda s, d: checks.repeated(table(s, d, "source_records"), "source_record_id", "duplicate_source_record_id"), "SELECT 'duplicate_source_record_id' AS code, 'error' AS severity, source_record_id AS subject, CAST(count(*) - 1 AS VARCHAR) AS detail FROM source_records GROUP BY source_record_id HAVING count(*) > 1")
_add("check_repeated_emails", lambda s, d: checks.repeated(contacts(s, d), "email", "duplicate_email"), f"WITH crm AS ({VIEW}) SELECT 'duplicate_email' AS code, 'error' AS severity, email AS subject, CAST(count(*) - 1 AS VARCHAR) AS detail FROM crm WHERE email <> '' GROUP BY email HAVING count(*) > 1")
_add(
    "check_unmapped_records",
    lambda s, d: checks.referenced(table(s, d, "match_pairs"), "source_record_id_b", table(s, d, "source_records"), "source_record_id", "unmapped_source_record"),
    "SELECT DISTINCT 'unmapped_source_record' AS code, 'error' AS severity, source_record_id_b AS subject, '' AS detail FROM match_pairs p WHERE source_record_id_b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_records r WHERE r.source_record_id = p.source_record_id_b)",
)
_SAME = "person_id_a IS NOT DISTINCT FROM person_id_b"
_add(
    "check_pairs",
    lambda s, d: checks.pair_checks(table(s, d, "match_pairs")),
    f"SELECT CASE WHEN pair_type = 'hard_negative' THEN 'invalid_hard_negative' ELSE 'invalid_hard_positive' END AS code, 'error' AS severity, concat_ws('|', person_id_a, person_id_b) AS subject, '' AS detail FROM match_pairs WHERE coalesce(pair_type = 'hard_negative', FALSE) = ({_SAME})",
)
_add(
    "check_split_leakage",
    lambda s, d: checks.split_leakage(golden.person_splits(_people(s, d)).unionByName(golden.person_splits(_people(s, d), 7))),
    lambda: f"SELECT 'split_leakage' AS code, 'error' AS severity, person_id AS subject, '2 splits' AS detail FROM (({_splits_sql(99)}) UNION ALL ({_splits_sql(7)})) GROUP BY person_id HAVING count(DISTINCT split) > 1",
)
_OWNERS = "SELECT DISTINCT source_record_id, person_id FROM corruption_events WHERE person_id IS NOT NULL AND source_record_id IS NOT NULL"
_add(
    "check_duplicate_groups",
    lambda s, d: checks.duplicate_group_checks(table(s, d, "duplicate_groups"), table(s, d, "corruption_events").where("person_id IS NOT NULL AND source_record_id IS NOT NULL").select("source_record_id", "person_id").distinct()),
    f"WITH m AS ({_OWNERS}), e AS (SELECT DISTINCT person_id, unnest(source_record_ids) AS source_record_id FROM duplicate_groups), j AS (SELECT e.person_id, count(DISTINCT m.person_id) AS owners, count(*) FILTER (m.person_id IS NULL) AS lost FROM e LEFT JOIN m ON m.source_record_id = e.source_record_id GROUP BY 1) SELECT 'invalid_duplicate_group' AS code, 'error' AS severity, person_id AS subject, CAST(owners AS VARCHAR) || ' persons' AS detail FROM j WHERE owners <> 1 OR lost > 0",
)
_add(
    "check_hard_cases",
    lambda s, d: checks.hard_case_checks(table(s, d, "partner_records"), table(s, d, "source_records"), table(s, d, "match_pairs"), "hard_negative"),
    "WITH p AS (SELECT * FROM match_pairs WHERE pair_type = 'hard_negative'), named AS (SELECT source_record_id_a AS r FROM p UNION SELECT source_record_id_b FROM p), ids AS (SELECT source_record_id AS r FROM partner_records) "
    "SELECT 'duplicate_source_record_id' AS code, 'error' AS severity, r AS subject, CAST(count(*) - 1 AS VARCHAR) AS detail FROM ids WHERE r <> '' GROUP BY r HAVING count(*) > 1 "
    "UNION ALL SELECT 'missing_source_record_id', 'error', 'hard_negative', '' FROM ids WHERE r IS NULL OR r = '' "
    "UNION ALL SELECT DISTINCT 'unmapped_hard_case_record', 'error', r, '' FROM ids WHERE r <> '' AND r NOT IN (SELECT source_record_id FROM source_records WHERE source_record_id IS NOT NULL) "
    "UNION ALL SELECT 'missing_hard_negative_record', 'error', r, '' FROM named WHERE r IS NULL OR r NOT IN (SELECT r FROM ids WHERE r IS NOT NULL) "
    f"UNION ALL SELECT 'invalid_hard_negative', 'error', concat_ws('|', person_id_a, person_id_b), '' FROM p WHERE {_SAME}",
)
_add(
    "check_counts_reconcile",
    lambda s, d: checks.counts_reconcile(golden.corruption_counts(table(s, d, "corruption_events").dropDuplicates(["event_id"])), golden.corruption_counts(table(s, d, "corruption_events")), "corruption_type", "event_count"),
    "WITH h AS (SELECT corruption_type, count(DISTINCT event_id) AS n, count(*) AS w FROM corruption_events GROUP BY 1) SELECT 'corruption_count_mismatch' AS code, 'error' AS severity, corruption_type AS subject, CAST(n AS VARCHAR) || ' not ' || CAST(w AS VARCHAR) AS detail FROM h WHERE n <> w",
)
_add("golden_corruption_counts", lambda s, d: golden.corruption_counts(table(s, d, "corruption_events")), "SELECT corruption_type, count(*) AS event_count FROM corruption_events GROUP BY 1")
_add("row_accounting", lambda s, d: quality.row_accounting(contacts(s, d).where("length(trim(first_name)) > 0"), contacts(s, d).where("first_name IS NULL OR length(trim(first_name)) = 0")), f"WITH crm AS ({VIEW}) SELECT count(*) AS source_rows, count(*) FILTER (length(trim(first_name)) > 0) AS accepted_rows, count(*) FILTER (first_name IS NULL OR length(trim(first_name)) = 0) AS rejected_rows FROM crm")

# --- synthetic data ---------------------------------------------------------------------------------------------------


def _lcg(seed: int, person: str, field: int, turn: int = 0) -> str:
    x = f"(({person} * 7919 + {field * 104_729 + turn * 15_485_863} + {seed * 32_452_843 + 1}) % {golden._M})"
    x = f"(({x} * {golden._A} + 12345) % {golden._M})"
    x = f"(({x} * ({x} % {golden._Q} + 7919) + 12345) % {golden._M})"
    x = f"(({x} * {golden._A} + 12345) % {golden._M})"
    return x


def _people(s: SparkSession, d: str) -> DataFrame:
    return golden.clean_people(s, table(s, d, "customer").count())


def _sql_pick(values, d: str) -> str:
    return f"list_extract([{', '.join(map(_quote, values))}], CAST({d} % {len(values)} AS INTEGER) + 1)"


_P = "person_index"
_SLUG = lambda v: f"trim(regexp_replace(lower(translate({v}, '{golden.TURKISH}', '{golden.PLAIN}')), '[^a-z0-9]+', '.', 'g'), '.')"
_DISTRICT = "CASE " + _lcg(42, _P, 5) + f" % {len(CITY_DISTRICTS)} " + " ".join(f"WHEN {k} THEN {_quote(ds[0])}" for k, ds in enumerate(CITY_DISTRICTS.values())) + " END"
_PEOPLE = (
    f"SELECT person_index, person_id, first_name, last_name, {_SLUG('first_name')} || '.' || {_SLUG('last_name')} || CAST({_P} AS VARCHAR) || '@' || {_sql_pick(golden.MAIL_DOMAINS, _lcg(42, _P, 8))} AS email, phone, company, city, district, address FROM ("
    f"SELECT {_P}, 'P-' || lpad(CAST({_P} AS VARCHAR), 6, '0') AS person_id, {_sql_pick(golden.FIRST_NAMES, _lcg(42, _P, 1))} AS first_name, {_sql_pick(golden.LAST_NAMES, _lcg(42, _P, 2))} AS last_name, '+905' || lpad(CAST({_P} AS VARCHAR), 9, '0') AS phone, {_sql_pick(golden.COMPANY_STEMS, _lcg(42, _P, 3))} || ' ' || {_sql_pick(golden.COMPANY_LINES, _lcg(42, _P, 4))} || ' A.Ş.' AS company, {_sql_pick(list(CITY_DISTRICTS), _lcg(42, _P, 5))} AS city, {_DISTRICT} AS district, {_sql_pick(golden.STREETS, _lcg(42, _P, 6))} || ' Caddesi No:' || CAST({_lcg(42, _P, 7)} % 250 + 1 AS VARCHAR) AS address FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS {_P} FROM customer))"
)
_add("golden_people", lambda s, d: _people(s, d).drop("person_index"), f"SELECT * EXCLUDE (person_index) FROM ({_PEOPLE})")


def _splits_sql(seed: int) -> str:
    return f"SELECT 'P-' || lpad(CAST(i AS VARCHAR), 6, '0') AS person_id, CASE WHEN r <= floor(n * 0.7) THEN 'train' WHEN r <= floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS split FROM (SELECT i, row_number() OVER (ORDER BY {_lcg(seed, 'i', 31)}, i) AS r, count(*) OVER () AS n FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS i FROM customer))"


_add("person_splits", lambda s, d: golden.person_splits(_people(s, d)), _splits_sql(99))
_add("golden_source_a", lambda s, d: golden.corrupt(golden.source_records(_people(s, d), "source_a", "A"), 43)[0].drop("person_index"))
_B1 = ", ".join(f"CASE WHEN {_lcg(42, _P, k, 9)} % 100 >= 12 THEN {f} END AS {golden.LAYOUTS[1][f]}" for k, f in enumerate(CANONICAL_FIELDS))
_add(
    "golden_source_b",
    lambda s, d: golden.source_b(_people(s, d), 1),
    f"SELECT 'B-' || lpad(CAST({_P} AS VARCHAR), 6, '0') AS source_record_id, 'source_b' AS source_name, person_id, {_B1}, 'BATCH-' || lpad(CAST({_P} % 17 AS VARCHAR), 3, '0') AS import_batch, 'imported' AS notes FROM ({_PEOPLE})",
)
_add(
    "golden_source_b_labels",
    lambda s, d: s.createDataFrame([(n, *x) for n in range(len(golden.LAYOUTS)) for x in golden.layout_mapping(n)], "layout int, source_column string, canonical_field string, decision string"),
    "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{c}', {_quote(f) if f else 'NULL'}, '{k}')" for n in range(len(golden.LAYOUTS)) for c, f, k in golden.layout_mapping(n)) + ") t(layout, source_column, canonical_field, decision)",
)
_COPIES = f"SELECT 'C-' || lpad(CAST(row_number() OVER (ORDER BY {_P}, copy) AS VARCHAR), 6, '0') AS source_record_id, 'source_c' AS source_name, person_id, copy, {', '.join(CANONICAL_FIELDS)} FROM (SELECT *, 0 AS copy FROM ({_PEOPLE}) UNION ALL SELECT *, 1 AS copy FROM ({_PEOPLE}) WHERE {_lcg(42, _P, 20)} % 100 < 8)"
_add("golden_source_c_copies", lambda s, d: golden.source_c_copies(_people(s, d)).drop("serial"), _COPIES)
_add("golden_source_c", lambda s, d: golden.source_c(_people(s, d))[0].drop("serial"))
_add("golden_events", lambda s, d: golden.corrupt(golden.source_records(_people(s, d), "source_a", "A"), 43)[1].unionByName(golden.source_c(_people(s, d))[1]))
_add(
    "golden_duplicate_groups",
    lambda s, d: golden.duplicate_groups(golden.source_c_copies(_people(s, d))).withColumn("source_record_ids", F.array_join("source_record_ids", ",")),
    f"SELECT person_id, string_agg(source_record_id, ',' ORDER BY source_record_id) AS source_record_ids, source_name FROM ({_COPIES}) GROUP BY person_id, source_name HAVING count(*) > 1",
)
_add(
    "golden_positive_pairs",
    lambda s, d: golden.positive_pairs(golden.source_c_copies(_people(s, d))),
    f"WITH c AS ({_COPIES}) SELECT a.person_id AS person_id_a, b.person_id AS person_id_b, a.source_record_id AS source_record_id_a, b.source_record_id AS source_record_id_b, a.source_name, 'duplicate' AS pair_type FROM c a JOIN c b ON a.person_id = b.person_id AND a.copy = 0 AND b.copy = 1",
)
_add("golden_hard_positives", lambda s, d: golden.hard_positives(_people(s, d), 200)[0].drop("serial"))
_add(
    "golden_hard_positive_pairs",
    lambda s, d: golden.hard_positives(_people(s, d), 200)[2],
    f"SELECT person_id AS person_id_a, person_id AS person_id_b, 'hard_positive-' || lpad(CAST(2 * n - 1 AS VARCHAR), 6, '0') AS source_record_id_a, 'hard_positive-' || lpad(CAST(2 * n AS VARCHAR), 6, '0') AS source_record_id_b, 'hard_positive' AS source_name, 'hard_positive' AS pair_type FROM (SELECT person_id, row_number() OVER (ORDER BY {_P}) AS n FROM (SELECT person_id, {_P} FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS {_P}, 'P-' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), 6, '0') AS person_id FROM customer) ORDER BY {_lcg(42, _P, 41)}, {_P} LIMIT 200))",
)
_add("golden_hard_negatives", lambda s, d: golden.hard_negatives(_people(s, d), 200))

# --- evaluation -------------------------------------------------------------------------------------------------------

_D2 = "regexp_replace(after_value, '[^0-9]', '', 'g')"
_TEL2 = f"CASE WHEN length({_D2}) = 12 AND starts_with({_D2}, '90') THEN '+' || {_D2} WHEN length({_D2}) = 11 AND starts_with({_D2}, '0') THEN '+90' || substr({_D2}, 2) WHEN length({_D2}) = 10 AND regexp_matches({_D2}, '^[3-9]') THEN '+90' || {_D2} ELSE after_value END"
_MAIL2 = f"concat(regexp_replace({S('after_value')}, '[^@]*$', ''), lower(regexp_extract({S('after_value')}, '[^@]*$')))"
# only events of phones and e-mails keep what stood before, all others are skipped
_EVENTS = f"SELECT *, CASE WHEN field_name = 'email' THEN {_MAIL2} WHEN regexp_matches({_TEL2}, '{_E164}') THEN {_TEL2} ELSE after_value END AS z FROM corruption_events"
_OUTCOMES = f"SELECT *, CASE WHEN coalesce(corruption_type NOT IN ('whitespace', 'phone_format'), TRUE) OR before_value IS NULL OR after_value IS NULL THEN 'skipped' WHEN z = before_value THEN CASE WHEN after_value = before_value THEN 'unnecessary' ELSE 'correct' END WHEN z = after_value THEN 'missed' ELSE 'incorrect' END AS outcome FROM ({_EVENTS})"
_add(
    "norm_benchmark",
    lambda s, d: evaluation.normalization_benchmark(table(s, d, "corruption_events")).groupBy("field_name", "corruption_type", "outcome").agg(F.count("*").alias("n")),
    f"SELECT field_name, corruption_type, outcome, count(*) AS n FROM ({_OUTCOMES}) GROUP BY 1, 2, 3",
)
_add(
    "validation_benchmark",
    lambda s, d: evaluation.validation_benchmark(evaluation.validation_cases(s)).select("case_id", "target_rule", "outcome"),
    "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', '{'TP' if fire else 'TN'}')" for i, (r, fire, _) in enumerate(benchmarks.VALIDATION_CASES, 1)) + ") t(case_id, target_rule, outcome)",
)


def _labels_sql(rows: list[tuple[str, str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', 'correct')" for a, b, c in rows) + ") t(case_id, source_column, decision, outcome)"


_RESULT = ("case_id", "source_column", "decision", "outcome")
_add("mapping_benchmark", lambda s, d: evaluation.mapping_benchmark(s).select(*_RESULT), _labels_sql([(c["case_id"], h, k) for c in benchmarks.MAPPING_CASES for h, (k, _) in c["expected"].items()]))
_add("layout_benchmark", lambda s, d: harness.layout_results(s, _people(s, d)).select(*_RESULT), _labels_sql([(f"layout_{n}", c, k) for n in range(len(golden.LAYOUTS)) for c, _, k in golden.layout_mapping(n)]))


def _measured(s: SparkSession, d: str) -> DataFrame:
    """The metrics that the gates judge, measured on the tables and the labelled cases."""
    m = evaluation.mapping_metrics(evaluation.mapping_benchmark(s)).select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(c).alias("value")) for k, c in (("schema_mapping_accuracy", "accuracy"), ("review_routing_recall", "review_recall"))))))
    n = evaluation.normalization_accuracy(evaluation.normalization_benchmark(table(s, d, "corruption_events")))
    return m.unionByName(n.select(F.lit("normalization_accuracy").alias("metric"), F.round("accuracy", 9).alias("value")))


_ACCURACY = f"(SELECT round(coalesce(count(*) FILTER (outcome = 'correct') / nullif(CAST(count(*) FILTER (outcome <> 'skipped') AS DOUBLE), 0), 0), 9) FROM ({_OUTCOMES}))"
_add(
    "hard_gates",
    lambda s, d: evaluation.hard_gates(_measured(s, d), {k: evaluation.GATES[k] for k in harness.MEASURED}),
    "SELECT *, value >= threshold AS passed FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE), 'gte', CAST({evaluation.GATES[k][1]} AS DOUBLE))" for k, v in (("schema_mapping_accuracy", "1"), ("review_routing_recall", "1"), ("normalization_accuracy", _ACCURACY))) + ") t(metric, value, operator, threshold)",
)


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v() for k, v in _SQL.items()}
