"""Labelled cases of the benchmarks. Records, headers and what must come out of them."""

from __future__ import annotations

from cleanloom.plans.config import CANONICAL_FIELDS

VALID = dict(zip(CANONICAL_FIELDS, ("Ali", "Yılmaz", "ali@example.com", "+905321234567", "Acme A.Ş.", "İstanbul", "Kadıköy", "Bağdat Caddesi No:1")))


def valid_record(**change: str | None) -> dict[str, str | None]:
    """A record that no rule objects to, with some values changed."""
    return VALID | change


#: (rule, whether it must raise an issue, record).
VALIDATION_CASES: tuple[tuple[str, bool, dict[str, str | None]], ...] = (
    ("required.missing", True, valid_record(first_name="")),
    ("required.missing", False, valid_record()),
    ("email.syntax", True, valid_record(email="test@@example.com")),
    ("email.syntax", False, valid_record()),
    ("text.noncanonical_whitespace", True, valid_record(email="  test@example.com  ")),
    ("phone.tr_e164", True, valid_record(phone="0532 123 45 67")),
    ("phone.tr_e164", False, valid_record()),
    ("phone.tr_e164", True, valid_record(phone="0532123")),
    ("phone.format", True, valid_record(phone="abc-phone")),
    ("location.city_known", True, valid_record(city="UnknownTown")),
    ("location.city_known", False, valid_record()),
    ("cross_field.city_district", True, valid_record(district="Çankaya")),
    ("cross_field.city_district", False, valid_record(city="Ankara", district="Çankaya")),
    ("text.blank", True, valid_record(first_name="   ")),
    ("company.min_length", True, valid_record(company="A")),
    ("address.min_length", True, valid_record(address="1234")),
)

_SAME = {f: ("AUTO_MAP", f) for f in CANONICAL_FIELDS}
_FIRST, _LAST = {"first_name": _SAME["first_name"]}, {"last_name": _SAME["last_name"]}
_ROW = ["Test Sokak"]


def _case(case_id: str, expected: dict[str, tuple[str, str | None]], *rows: list[str]) -> dict:
    return {"case_id": case_id, "headers": list(expected), "rows": list(rows), "expected": expected}


def _all(headers: str) -> dict[str, tuple[str, str | None]]:
    return {h: ("AUTO_MAP", f) for h, f in zip(headers.split(), CANONICAL_FIELDS)}


#: Headers with sample rows, and for each header the decision and field that are right.
MAPPING_CASES: tuple[dict, ...] = (
    _case("turkish_aliases_layout1", _all("ad soyad e_mail gsm sirket sehir ilce adres"), ["Ayse", "Yilmaz", "ayse@example.com", "05321234567", "Acme", "Istanbul", "Kadikoy", *_ROW]),
    _case("english_aliases_layout2", _all("given_name surname email_address mobile organization il mahalle street"), ["Ali", "Kaya", "ali@example.com", "05321234567", "Acme", "Istanbul", "Kadikoy", *_ROW]),
    _case("casing_and_spacing", {"First Name": ("AUTO_MAP", "first_name"), "E-Posta Adresi": ("AUTO_MAP", "email"), "CEP TELEFONU": ("AUTO_MAP", "phone")}, ["Ayse", "ayse@example.com", "05321234567"]),
    _case("unknown_notes_unmapped", _FIRST | _LAST | {"email": ("AUTO_MAP", "email"), "notes": ("UNMAPPED", None), "legacy_status": ("UNMAPPED", None)}, ["Ali", "Kaya", "ali@example.com", "VIP customer", "active"]),
    _case("ambiguous_contact_review", {"contact": ("REVIEW", "email")} | _FIRST | _LAST, ["ali@example.com", "Ali", "Kaya"]),
    _case("pattern_dominant_email_contact", {"contact": ("AUTO_MAP", "email")} | _FIRST, ["ali@example.com", "Ali"], ["ayse@example.com", "Ayse"], ["veli@example.com", "Veli"]),
    _case("email_phone_collision", {"email": ("CONFLICT", "email"), "email_2": ("CONFLICT", "email")} | _FIRST, ["ali@example.com", "backup@example.com", "Ali"]),
    _case("header_phone_numeric_conflict", {"phone": ("REVIEW", "phone")} | _FIRST, ["12345", "Ali"], ["67890", "Ayse"]),
    _case(
        "company_name_lexical",
        {"company_name": ("REVIEW", "company")} | {f: _SAME[f] for f in CANONICAL_FIELDS if f != "company"},
        ["Acme AS", "Ali", "Kaya", "ali@example.com", "05321234567", "Istanbul", "Kadikoy", *_ROW],
    ),
    _case("location_ambiguous_review", {"location": ("REVIEW", "city")} | _FIRST, ["Istanbul", "Ali"]),
    _case("mixed_contact_close_scores", {"contact": ("UNMAPPED", "email")} | _FIRST, ["ali@example.com", "Ali"], ["05321234567", "Ayse"]),
    _case("unknown_business_field", _FIRST | {"crm_pipeline_stage": ("UNMAPPED", None)}, ["Ali", "negotiation"]),
    _case("tel_mail_ambiguous_header", {"tel_mail": ("REVIEW", "email")} | _FIRST, ["ali@example.com", "Ali"]),
)

#: What each malformed fixture must give: (accepted, rejected, reason) or a fatal code.
MALFORMED_EXPECTED: dict[str, str | tuple[int, int, str | None]] = {
    "empty_file.csv": "empty_file",
    "header_only.csv": (0, 0, None),
    "duplicate_header.csv": "duplicate_header",
    "missing_column_row.csv": (0, 1, "inconsistent_column_count"),
    "extra_column_row.csv": (0, 1, "inconsistent_column_count"),
    "broken_quotes.csv": (0, 1, "unclosed_quote"),
    "semicolon_delimiter.csv": (1, 0, None),
    "utf8_turkish.csv": (1, 0, None),
    "latin5_turkish.csv": (1, 0, None),
}
