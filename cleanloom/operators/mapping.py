"""Source headers to canonical fields, with evidence for every score.

A table has at most a few hundred headers, so candidates, scores and decisions are metadata on the driver; applying a plan is one
projection over the data. Scores are exact decimals, so a sum that lands on a threshold counts as reaching it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal
from difflib import SequenceMatcher
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.plans.config import CANONICAL_FIELDS, ConfigError, MappingConfig

SIX = Decimal("0.000001")
# What it adds that the first or last word of a header is the field, and floors for words in common.
TOKEN_WEIGHT = Decimal("0.58")
WORD_FLOOR, FIELD_FLOOR = 0.72, 0.86
AUTO_MAP, REVIEW, UNMAPPED, CONFLICT = "AUTO_MAP", "REVIEW", "UNMAPPED", "CONFLICT"
COLLISION = "ONE_TO_ONE_COLLISION"


def normalize_header(header: str) -> str:
    """Stripped, composed and case-folded; only a-z and 0-9 stay, other runs become one underscore where hyphens, blanks or underscores stood."""
    x = unicodedata.normalize("NFC", header.strip()).casefold()
    x = re.sub(r"[-_]+", " ", x)
    x = re.sub(r"[^a-z0-9]+", " ", x).strip()
    return re.sub(r"\s+", "_", x)


def alias_owners(config: MappingConfig) -> dict[str, str]:
    """Normalised alias to field; an alias of two fields is an error."""
    out: dict[str, str] = {}
    for f in config.fields:
        for a in config.aliases[f]:
            k = normalize_header(a)
            if out.setdefault(k, f) != f:
                raise ConfigError(f"alias {a} belongs to {out[k]} and {f}")
    return out


@dataclass(frozen=True)
class ColumnFacts:
    """What mapping needs to know of a column's profile."""

    rows: int = 0
    non_null: int = 0
    kind: str = "string"
    completeness: Decimal = Decimal(0)
    uniqueness: Decimal = Decimal(0)
    patterns: Mapping[str, Decimal] = field(default_factory=dict)

    @staticmethod
    def of(row: Any) -> ColumnFacts:
        dec = lambda x: Decimal(repr(float(x)))
        return ColumnFacts(row.row_count, row.non_null_count, row.type_inference.inferred_type, dec(row.completeness_ratio), dec(row.uniqueness_ratio), {p.pattern_name: dec(p.match_ratio) for p in row.patterns})


@dataclass(frozen=True)
class Evidence:
    kind: str
    value: Decimal
    weight: Decimal
    contribution: Decimal
    note: str


@dataclass(frozen=True)
class Candidate:
    field: str
    score: Decimal
    evidence: tuple[Evidence, ...]

    def has(self, kind: str) -> bool:
        return any(e.kind == kind for e in self.evidence)


@dataclass(frozen=True)
class ColumnMapping:
    source_column: str
    index: int
    normalized_header: str
    decision: str
    canonical_field: str | None
    score: Decimal
    evidence: tuple[Evidence, ...]
    alternatives: tuple[Candidate, ...]
    conflicts: tuple[str, ...]
    reason: str


def _six(x: Decimal) -> Decimal:
    return x.quantize(SIX, ROUND_HALF_EVEN)


def likeness(header: str, names: Sequence[str], target: str) -> Decimal:
    """Closest of the names to the header, with a floor where whole words of the field stand in it."""
    best = max((SequenceMatcher(None, header, n).ratio() for n in names), default=0.0)
    mine, field_words = set(header.split("_")), set(target.split("_"))
    if mine & field_words:
        best = max(best, WORD_FLOOR)
    if target in mine or header.startswith(f"{target}_") or header.endswith(f"_{target}"):
        best = max(best, FIELD_FLOOR)
    return Decimal(repr(best))


def evidence_for(header: str, target: str, owner: str | None, facts: ColumnFacts, config: MappingConfig) -> list[Evidence]:
    w, out = config.weights, []

    def add(kind: str, value: Decimal, weight: Decimal, contribution: Decimal, note: str) -> None:
        out.append(Evidence(kind, value, weight, contribution, note))

    if owner == target:
        add("EXACT_ALIAS", Decimal(1), w["exact_alias"], w["exact_alias"], "the header is an alias of the field")
    parts = header.split("_")
    if owner is None and header != target and target in (parts[0], parts[-1]):
        add("LEXICAL_SIMILARITY", Decimal(1), TOKEN_WEIGHT, TOKEN_WEIGHT, "the header begins or ends with the field")
    like = likeness(header, [target, *(normalize_header(a) for a in config.aliases[target])], target)
    if like >= config.thresholds["lexical_minimum"]:
        add("LEXICAL_SIMILARITY", like, w["lexical_similarity"], _six(like * w["lexical_similarity"]), "the header is spelled alike")
    if facts.kind == "string":
        add("TYPE_COMPATIBILITY", Decimal(1), w["type_compatibility"], w["type_compatibility"], "the values are of the field's type")
    elif facts.non_null > 0:
        add("TYPE_INCOMPATIBILITY", Decimal(1), w["type_incompatibility"], w["type_incompatibility"], f"the values are of type {facts.kind}")
    p = lambda n: facts.patterns.get(n, Decimal(0))
    own = {"email": "email_like", "phone": "phone_like"}.get(target)
    if own:
        strong = p(own) >= config.thresholds["pattern_dominance"]
        if strong:
            weight = w[f"pattern_{target}"]
            add(f"PATTERN_{target.upper()}", p(own), weight, _six(p(own) * weight), f"the values look like {target}")
        elif p("numeric_like") >= Decimal("0.95"):
            add("PATTERN_NUMERIC", p("numeric_like"), w["pattern_numeric"], w["pattern_numeric"], "the values are plain numbers")
    if facts.completeness >= Decimal("0.80"):
        add("COMPLETENESS", facts.completeness, w["completeness"], _six(facts.completeness * w["completeness"]), "most rows have a value")
    if facts.uniqueness >= Decimal("0.90"):
        add("UNIQUENESS", facts.uniqueness, w["uniqueness"], _six(facts.uniqueness * w["uniqueness"]), "most values are distinct")
    return out


def score_of(target: str, evidence: Sequence[Evidence], facts: ColumnFacts, config: MappingConfig) -> Decimal:
    """Sum of the contributions; values that are all but surely e-mails or phones lift their field to automatic mapping; within 0 and 1."""
    total = sum((e.contribution for e in evidence), Decimal(0))
    own = {"email": "email_like", "phone": "phone_like"}.get(target)
    if own and facts.rows >= 2 and facts.patterns.get(own, Decimal(0)) >= config.thresholds["pattern_auto_map_support"]:
        total = max(total, config.thresholds["auto_map"])
    return _six(min(Decimal(1), max(Decimal(0), total)))


def candidates_for(header: str, facts: ColumnFacts, config: MappingConfig, owners: Mapping[str, str]) -> list[Candidate]:
    """Fields with a score above zero, the best first, then by name."""
    key = normalize_header(header)
    out = []
    for f in config.fields:
        ev = evidence_for(key, f, owners.get(key), facts, config)
        s = score_of(f, ev, facts, config)
        if s > 0:
            out.append(Candidate(f, s, tuple(ev)))
    return sorted(out, key=lambda c: (-c.score, c.field))


def decide(header: str, index: int, found: Sequence[Candidate], facts: ColumnFacts, collides: Sequence[str], config: MappingConfig) -> ColumnMapping:
    """The first of these that holds settles a column: nothing found, collision, contradiction, too low, ambiguous, too close, high enough."""
    t, key = config.thresholds, normalize_header(header)
    vague = key in {normalize_header(h) for h in config.ambiguous}

    def result(decision: str, why: str, target: str | None, conflicts: Sequence[str] = ()) -> ColumnMapping:
        top = found[0] if found else None
        return ColumnMapping(header, index, key, decision, target, top.score if top else Decimal(0), top.evidence if top else (), tuple(found[1:4]), tuple(conflicts), why)

    if not found:
        return result(UNMAPPED, "no field fits", None)
    top = found[0]
    second = found[1].score if len(found) > 1 else Decimal(0)
    lexical_only = top.has("LEXICAL_SIMILARITY") and not any(top.has(k) for k in ("EXACT_ALIAS", "PATTERN_EMAIL", "PATTERN_PHONE"))
    support = {"email": "email_like", "phone": "phone_like"}.get(top.field)
    strong = bool(support) and facts.patterns.get(support, Decimal(0)) >= t["pattern_auto_map_support"]
    if collides:
        return result(CONFLICT, "several columns claim the field", top.field, [f"{COLLISION}: {top.field} is claimed by {', '.join(collides)}"])
    plain_numbers = top.field == "phone" and top.has("EXACT_ALIAS") and top.has("PATTERN_NUMERIC")
    if plain_numbers and top.score >= t["review"]:
        return result(REVIEW, "the header says phone, the values are plain numbers", top.field)
    if top.score < t["review"]:
        if vague and top.score >= Decimal("0.35"):
            return result(REVIEW, "the header is ambiguous", top.field)
        return result(UNMAPPED, "the best score is too low", None)
    if vague and lexical_only:
        return result(REVIEW, "the header is ambiguous and nothing but its spelling speaks for the field", top.field)
    if len(found) > 1 and top.score - second < t["ambiguity_margin"]:
        return result(REVIEW, "two fields are too close", top.field)
    if top.score >= t["auto_map"]:
        if vague and not top.has("EXACT_ALIAS") and not strong:
            return result(REVIEW, "the header is ambiguous", top.field)
        if lexical_only:
            return result(REVIEW, "nothing but the spelling speaks for the field", top.field)
        return result(AUTO_MAP, "the evidence is sufficient", top.field)
    return result(REVIEW, "the score calls for a look", top.field)


@dataclass(frozen=True)
class MappingPlan:
    columns: tuple[ColumnMapping, ...]
    missing: tuple[str, ...]

    def counts(self) -> dict[str, int]:
        return {d: sum(c.decision == d for c in self.columns) for d in (AUTO_MAP, REVIEW, UNMAPPED, CONFLICT)}

    def to_df(self, spark: SparkSession) -> DataFrame:
        ev = "array<struct<kind:string,value:decimal(20,6),weight:decimal(10,6),contribution:decimal(10,6),note:string>>"
        schema = f"source_column string, column_index int, normalized_header string, decision string, canonical_field string, score decimal(10,6), evidence {ev}, alternatives array<struct<field:string,score:decimal(10,6)>>, conflicts array<string>, reason string"
        e = lambda xs: [(x.kind, _six(x.value), x.weight, x.contribution, x.note) for x in xs]
        return spark.createDataFrame(
            [(c.source_column, c.index, c.normalized_header, c.decision, c.canonical_field, c.score, e(c.evidence), [(a.field, a.score) for a in c.alternatives], list(c.conflicts), c.reason) for c in self.columns], schema
        )


def plan_columns(headers: Sequence[str], facts: Mapping[str, ColumnFacts], config: MappingConfig | None = None) -> MappingPlan:
    """A decision for every header, in order."""
    c = (config or MappingConfig()).check()
    owners = alias_owners(c)
    found = {h: candidates_for(h, facts.get(h, ColumnFacts()), c, owners) for h in headers}
    claims: dict[str, list[str]] = {}
    for h in headers:
        if found[h] and found[h][0].score >= c.thresholds["review"]:
            claims.setdefault(found[h][0].field, []).append(h)
    out = []
    for i, h in enumerate(headers):
        rivals = claims.get(found[h][0].field, []) if found[h] else []
        out.append(decide(h, i, found[h], facts.get(h, ColumnFacts()), rivals if len(rivals) > 1 and h in rivals else (), c))
    have = {m.canonical_field for m in out if m.decision == AUTO_MAP}
    return MappingPlan(tuple(out), tuple(f for f in c.fields if f not in have))


def build_mapping_plan(profiles: DataFrame, config: MappingConfig | None = None) -> MappingPlan:
    """From column profiles; at most one row for each header comes to the driver."""
    rows = profiles.orderBy("position").collect()
    return plan_columns([r.name for r in rows], {r.name: ColumnFacts.of(r) for r in rows}, config)


def apply_plan(table: DataFrame, plan: MappingPlan, keep: Sequence[str] = ("row_number",)) -> DataFrame:
    """Canonical columns (null where nothing maps), ``unmapped`` by header, and ``lineage``: one projection. Only AUTO_MAP maps; REVIEW is left out of both."""
    auto = {m.canonical_field: m.source_column for m in plan.columns if m.decision == AUTO_MAP}
    text = lambda c: F.col(f"`{c}`").cast("string")
    rest = [m.source_column for m in plan.columns if m.decision in (UNMAPPED, CONFLICT)]
    unmapped = F.create_map(*[x for c in rest for x in (F.lit(c), text(c))]) if rest else F.create_map().cast("map<string,string>")
    line = [F.struct(F.lit(s).alias("source_column"), F.lit(f).alias("canonical_field"), text(s).alias("source_value"), text(s).alias("mapped_value")) for f, s in auto.items()]
    kind = "array<struct<source_column:string,canonical_field:string,source_value:string,mapped_value:string>>"
    return table.select(
        *(c for c in keep if c in table.columns),
        *((text(auto[f]) if f in auto else F.lit(None).cast("string")).alias(f) for f in CANONICAL_FIELDS),
        unmapped.alias("unmapped"), (F.array(*line) if line else F.array().cast(kind)).alias("lineage"),
    )


# The ways in which a labelled column can come out wrong. Only some follow from decision and field alone.
FAILURES = (
    "LEXICAL_FALSE_POSITIVE", "PATTERN_FALSE_POSITIVE", "TYPE_CONFLICT", "HEADER_PATTERN_CONFLICT", "AMBIGUOUS_ALIAS", "COLLISION",
    "THRESHOLD_ERROR", "MISSING_EVIDENCE", "FALSE_AUTO_MAP", "MISSED_MAPPING", "FALSE_REVIEW", "FALSE_UNMAPPED",
)
#: For a label that isn't AUTO_MAP: what each other decision is.
_WRONG = {
    UNMAPPED: {AUTO_MAP: "FALSE_AUTO_MAP", CONFLICT: "FALSE_UNMAPPED"},
    REVIEW: {AUTO_MAP: "FALSE_AUTO_MAP", UNMAPPED: "FALSE_UNMAPPED"},
}


def failure_kind(expected: str, field: str | None, got: str, got_field: str | None) -> str | None:
    """Why a labelled column came out otherwise, one of FAILURES; null if it didn't. expected and got are decisions."""
    if expected in _WRONG:
        return _WRONG[expected].get(got)
    if not field:
        return None
    if got == AUTO_MAP:
        return None if got_field == field else "FALSE_AUTO_MAP"
    return {CONFLICT: "COLLISION", REVIEW: "FALSE_REVIEW" if expected == AUTO_MAP else "MISSED_MAPPING"}.get(got, "MISSED_MAPPING")


def label_outcome(expected: str, field: str | None, got: str, got_field: str | None) -> str:
    """correct, incorrect (something false was claimed) or missed (something true wasn't)."""
    if expected != AUTO_MAP:
        return "correct" if got == expected else "missed" if expected == REVIEW else "incorrect"
    if got == AUTO_MAP:
        return "correct" if got_field == field else "incorrect"
    return "missed"
