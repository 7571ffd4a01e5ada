"""Settings of the record-quality rules: fixed values, and overrides from YAML checked when they are loaded."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from decimal import Decimal
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting that can't be right."""


# The canonical fields, in order.
CANONICAL_FIELDS = ("first_name", "last_name", "email", "phone", "company", "city", "district", "address")
SOURCE_FIELDS = ("source_record_id", "source_name")
PERSON_ID_PATTERN = r"^P-[0-9]{6}$"

# Places that validation knows, and the districts of each city.
CITY_DISTRICTS = {
    "İstanbul": ("Kadıköy", "Beşiktaş"),
    "Ankara": ("Çankaya",),
    "İzmir": ("Konak",),
    "Bursa": ("Nilüfer",),
    "Antalya": ("Muratpaşa",),
    "Adana": ("Seyhan",),
    "Konya": ("Selçuklu",),
    "Gaziantep": ("Şahinbey",),
    "Kocaeli": ("İzmit",),
    "Mersin": ("Mezitli",),
}
# Spellings of places that normalisation replaces.
CITY_ALIASES = {
    "istanbul": "İstanbul", "ISTANBUL": "İstanbul", "ankara": "Ankara", "izmir": "İzmir", "bursa": "Bursa", "antalya": "Antalya",
    "adana": "Adana", "konya": "Konya", "gaziantep": "Gaziantep", "kocaeli": "Kocaeli", "mersin": "Mersin",
}
DISTRICT_ALIASES = {
    "kadikoy": "Kadıköy", "besiktas": "Beşiktaş", "cankaya": "Çankaya", "konak": "Konak", "nilufer": "Nilüfer", "muratpasa": "Muratpaşa",
    "seyhan": "Seyhan", "selcuklu": "Selçuklu", "sahinbey": "Şahinbey", "mezitli": "Mezitli", "izmit": "İzmit",
}
# Legal forms and their canonical spelling; the first that applies is used.
COMPANY_SUFFIXES = (
    ("A.S.", "A.Ş."), ("A.S", "A.Ş."), ("AŞ", "A.Ş."), ("A. S.", "A.Ş."), ("A. S", "A.Ş."), ("AS", "A.Ş."),
    ("LTD. STI.", "Ltd. Şti."), ("LTD STI", "Ltd. Şti."), ("LTD. ŞTİ.", "Ltd. Şti."),
)
# Longest texts that pass without a warning.
MAX_LENGTHS = {"first_name": 100, "last_name": 100, "company": 200, "city": 100, "district": 100, "address": 500}
# Severity by kind of rule.
SEVERITIES = {"required": "error", "format": "error", "length": "warning", "location": "warning", "cross_field": "warning", "whitespace": "info"}

# Headers that stand for a canonical field, and headers that say nothing certain.
HEADER_ALIASES = {
    "first_name": ("ad", "isim", "first_name", "firstname", "given_name"),
    "last_name": ("soyad", "soyisim", "last_name", "lastname", "surname"),
    "email": ("email", "eposta", "e_posta", "e-posta", "e_posta_adresi", "mail", "email_address"),
    "phone": ("telefon", "tel", "cep", "cep_telefonu", "cep telefonu", "phone", "mobile", "gsm"),
    "company": ("firma", "sirket", "şirket", "company", "organization"),
    "city": ("sehir", "şehir", "il", "city", "city_name"),
    "district": ("ilce", "ilçe", "mahalle", "district"),
    "address": ("adres", "address", "street", "full_address"),
}
AMBIGUOUS_HEADERS = ("contact", "info", "customer", "tel_mail", "location", "name", "data")
# What each kind of evidence adds to a candidate.
WEIGHTS = {
    "exact_alias": Decimal("0.95"),
    "lexical_similarity": Decimal("0.35"),
    "type_compatibility": Decimal("0.12"),
    "type_incompatibility": Decimal("-0.25"),
    "pattern_email": Decimal("0.40"),
    "pattern_phone": Decimal("0.40"),
    "pattern_numeric": Decimal("-0.15"),
    "completeness": Decimal("0.05"),
    "uniqueness": Decimal("0.03"),
}
THRESHOLDS = {
    "auto_map": Decimal("0.90"),
    "review": Decimal("0.60"),
    "ambiguity_margin": Decimal("0.08"),
    "lexical_minimum": Decimal("0.55"),
    "pattern_dominance": Decimal("0.85"),
    "pattern_auto_map_support": Decimal("0.90"),
}


@dataclass(frozen=True)
class IngestionConfig:
    delimiters: tuple[str, ...] = (",", ";")
    sample_lines: int = 5
    encodings: tuple[str, ...] = ("utf-8", "utf-8-sig", "cp1254", "iso-8859-9")
    csv_enabled: bool = True
    xlsx_enabled: bool = True
    worksheet_policy: str = "first"
    max_bytes: int = 52_428_800
    max_rows: int = 200_000
    max_columns: int = 256
    empty_file: str = "error"
    duplicate_header: str = "error"
    blank_header_cell: str = "error"
    malformed_row: str = "reject"
    sample_values: int = 5
    pattern_sample: int = 1000

    def check(self) -> IngestionConfig:
        if not self.delimiters or any(len(d) != 1 for d in self.delimiters):
            raise ConfigError("delimiters must be single characters")
        if min(self.max_bytes, self.max_rows, self.max_columns, self.sample_lines, self.sample_values, self.pattern_sample) < 1:
            raise ConfigError("limits must be positive")
        if self.worksheet_policy not in ("first", "explicit"):
            raise ConfigError("worksheet_policy is first or explicit")
        return self


@dataclass(frozen=True)
class QualityConfig:
    required: tuple[str, ...] = CANONICAL_FIELDS
    severities: Mapping[str, str] = field(default_factory=lambda: dict(SEVERITIES))
    disabled: frozenset[str] = frozenset()
    max_lengths: Mapping[str, int] = field(default_factory=lambda: dict(MAX_LENGTHS))
    city_districts: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(CITY_DISTRICTS))
    city_aliases: Mapping[str, str] = field(default_factory=lambda: dict(CITY_ALIASES))
    district_aliases: Mapping[str, str] = field(default_factory=lambda: dict(DISTRICT_ALIASES))
    company_suffixes: tuple[tuple[str, str], ...] = COMPANY_SUFFIXES

    def check(self) -> QualityConfig:
        if bad := set(self.severities.values()) - {"error", "warning", "info"}:
            raise ConfigError(f"unknown severities: {sorted(bad)}")
        if bad := set(self.required) - set(CANONICAL_FIELDS):
            raise ConfigError(f"unknown required fields: {sorted(bad)}")
        if any(v < 1 for v in self.max_lengths.values()):
            raise ConfigError("lengths must be positive")
        return self


@dataclass(frozen=True)
class MappingConfig:
    fields: tuple[str, ...] = CANONICAL_FIELDS
    aliases: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(HEADER_ALIASES))
    ambiguous: tuple[str, ...] = AMBIGUOUS_HEADERS
    weights: Mapping[str, Decimal] = field(default_factory=lambda: dict(WEIGHTS))
    thresholds: Mapping[str, Decimal] = field(default_factory=lambda: dict(THRESHOLDS))

    def check(self) -> MappingConfig:
        if self.thresholds["review"] >= self.thresholds["auto_map"]:
            raise ConfigError("the review threshold must lie below the one for automatic mapping")
        if bad := [k for k, v in self.weights.items() if v < 0 and k not in ("type_incompatibility", "pattern_numeric")]:
            raise ConfigError(f"weights must not be negative: {bad}")
        if bad := set(self.fields) - set(CANONICAL_FIELDS):
            raise ConfigError(f"not in the canonical schema: {sorted(bad)}")
        if bad := [f for f in self.fields if not self.aliases.get(f)]:
            raise ConfigError(f"fields without aliases: {bad}")
        return self


def load(kind: type, path: str | Path | None = None) -> Any:
    """The settings of a kind with the values of a YAML file over them, unknown keys being an error."""
    config = kind()
    if path is None:
        return config.check()
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(raw, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    known = {f.name: f for f in fields(kind)}
    if bad := set(raw) - set(known):
        raise ConfigError(f"{path}: unknown settings {sorted(bad)}")
    shaped = {}
    for k, v in raw.items():
        have = getattr(config, k)
        if isinstance(have, tuple):
            v = tuple(tuple(x) if isinstance(x, list) else x for x in v)
        elif isinstance(have, frozenset):
            v = frozenset(v)
        elif isinstance(have, Mapping) and have and isinstance(next(iter(have.values())), Decimal):
            v = {**have, **{a: Decimal(str(b)) for a, b in v.items()}}
        elif isinstance(have, Mapping):
            v = {a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}
        shaped[k] = v
    return replace(config, **shaped).check()
