"""Synthetic people, their records in several sources, corruption, duplicates and hard cases.

Every random choice is a hash of (seed, person, field, draw), so the output depends on neither the partitioning nor the order in
which rows are made. The same seed gives the same data; bits of other generators are not reproduced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.functions.session import cut
from cleanloom.functions.text import title
from cleanloom.plans.config import CANONICAL_FIELDS, CITY_DISTRICTS

# The vocabulary of the generator, made for it: any other would do.
FIRST_NAMES = ("Aylin", "Baran", "Ceren", "Doruk", "Esra", "Ferit", "Gamze", "Haluk", "Irmak", "Jale", "Kaan", "Leyla", "Murat", "Nehir", "Orhun", "Pınar", "Rıza", "Sevgi", "Şermin", "Tolga", "Umut", "Vildan", "Yasin", "Zerrin")
LAST_NAMES = ("Akıncı", "Bulut", "Ceylan", "Çınar", "Duman", "Ekinci", "Fidan", "Gürbüz", "Işık", "Keskin", "Lale", "Mutlu", "Narin", "Ordulu", "Pehlivan", "Sezer", "Şentürk", "Toprak", "Uçar", "Varol", "Yalçın", "Zengin")
COMPANY_STEMS = ("Akasya", "Bozkır", "Çağlayan", "Doğu Rüzgarı", "Fırat", "Göktaş", "İnci", "Kardelen", "Meltem", "Poyraz", "Sarnıç", "Yakamoz")
COMPANY_LINES = ("Ambalaj", "Boya", "Cam", "Dokuma", "Elektrik", "Fide", "Gıda", "Hırdavat", "İplik", "Kağıt", "Mermer", "Otomotiv", "Seramik")
STREETS = ("Akçaağaç", "Badem", "Çamlık", "Değirmen", "Erguvan", "Gül", "Ihlamur", "Kestane", "Menekşe", "Nergis", "Pınarbaşı", "Söğütlü", "Üçler", "Yasemin")
MAIL_DOMAINS = ("posta.test", "isyeri.test", "kutu.test", "yazisma.test", "ornek.test")
#: Rows of a Turkish keyboard: a slip hits the key to the right, at the end of a row the one to the left.
KEYS = ("qwertyuıopğü", "asdfghjklşi", "zxcvbnmöç", "1234567890")
TYPO_FROM = "".join(KEYS)
TYPO_TO = "".join(row[1:] + row[-2] for row in KEYS)
# Turkish letters with their plain ones, and the operators by name.
TURKISH, PLAIN = "ıİğĞüÜşŞöÖçÇ", "iIgGuUsSoOcC"
OPERATORS = ("case_change", "unicode_turkish", "whitespace", "punctuation", "typo", "abbreviation", "phone_format", "email_corruption", "missing_value", "field_conflict")
# Profiles of noise: the chance of each field and the weight of each operator in percent, and the most of a record.
PROFILES = {
    "formatting_noise": {
        "rates": {"first_name": 35, "last_name": 35, "email": 20, "phone": 45, "company": 40, "city": 25, "district": 25, "address": 30},
        "weights": {"case_change": 20, "unicode_turkish": 15, "whitespace": 20, "punctuation": 10, "phone_format": 20, "abbreviation": 15},
        "most": 3,
    },
    "semantic_noise": {
        "rates": {"first_name": 25, "last_name": 25, "email": 30, "phone": 20, "company": 25, "city": 15, "district": 15, "address": 20},
        "weights": {"typo": 25, "email_corruption": 15, "missing_value": 10, "field_conflict": 15, "duplicate": 20, "case_change": 5, "whitespace": 5, "unicode_turkish": 5},
        "most": 4,
    },
    "hard_positive": {
        "rates": {"first_name": 70, "last_name": 70, "email": 60, "phone": 65, "company": 55, "city": 50, "district": 50, "address": 60},
        "weights": {"typo": 20, "missing_value": 20, "case_change": 15, "unicode_turkish": 15, "whitespace": 10, "phone_format": 10, "email_corruption": 10},
        "most": 5,
    },
}
# How grave each kind of corruption is.
SEVERITY = {
    "case_change": "low", "unicode_turkish": "low", "whitespace": "low", "punctuation": "low", "typo": "medium", "abbreviation": "low",
    "phone_format": "low", "email_corruption": "medium", "missing_value": "medium", "column_rename": "low", "duplicate": "high", "field_conflict": "high",
}

#: Modulus and multiplier of the draw; products stay within 64 bits.
_M, _A, _Q = 2_147_483_647, 48_271, 46_337


def draw(seed: int, person: Column, field: int | Column, turn: int | Column = 0) -> Column:
    """A whole number in 0 .. 2^31 - 2 settled by its arguments, written in plain arithmetic that any SQL has.

    The middle step is quadratic: without it the draws of two turns would differ by a constant, and so depend on one another.
    """
    x = (person.cast("long") * 7919 + (field if isinstance(field, Column) else F.lit(field)).cast("long") * 104_729 + (turn if isinstance(turn, Column) else F.lit(turn)).cast("long") * 15_485_863 + F.lit(seed * 32_452_843 + 1)) % _M
    x = (x * _A + 12_345) % _M
    x = (x * (x % _Q + 7919) + 12_345) % _M
    return (x * _A + 12_345) % _M


def pick(values: Sequence[str], d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (d % len(values) + 1).cast("int"))


def slug(x: Column) -> Column:
    y = F.lower(F.translate(x, TURKISH, PLAIN))
    return F.regexp_replace(F.regexp_replace(y, "[^a-z0-9]+", "."), r"^\.+|\.+$", "")


def person_id(i: Column) -> Column:
    return F.concat(F.lit("P-"), F.lpad(i.cast("string"), F.greatest(F.lit(6), F.length(i.cast("string"))), F.lit("0")))


def clean_people(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """(person_index, person_id and the canonical fields): distinct people with distinct e-mails and phones."""
    i = F.col("person_index")
    d = lambda k: draw(seed, i, k)
    cities = list(CITY_DISTRICTS)
    district = F.coalesce(*(F.when(d(5) % len(cities) == k, F.lit(CITY_DISTRICTS[c][0])) for k, c in enumerate(cities)))
    t = spark.range(1, count + 1).select(F.col("id").alias("person_index"))
    t = t.select(i, person_id(i).alias("person_id"), pick(FIRST_NAMES, d(1)).alias("first_name"), pick(LAST_NAMES, d(2)).alias("last_name"), F.concat_ws(" ", pick(COMPANY_STEMS, d(3)), pick(COMPANY_LINES, d(4)), F.lit("A.Ş.")).alias("company"), pick(cities, d(5)).alias("city"), district.alias("district"), F.concat(pick(STREETS, d(6)), F.lit(" Caddesi No:"), (d(7) % 250 + 1).cast("string")).alias("address"))
    mail = F.concat(slug(F.col("first_name")), F.lit("."), slug(F.col("last_name")), i.cast("string"), F.lit("@"), pick(MAIL_DOMAINS, d(8)))
    phone = F.concat(F.lit("+905"), F.lpad(i.cast("string"), 9, "0"))
    return t.select("person_index", "person_id", "first_name", "last_name", mail.alias("email"), phone.alias("phone"), "company", "city", "district", "address")


def weighted(d: Column, weights: dict[str, int]) -> Column:
    """The key whose cumulative weight holds the draw."""
    at, out, total = 0, None, sum(weights.values())
    for k, w in weights.items():
        at += w
        out = F.when(d % total < at, k) if out is None else out.when(d % total < at, k)
    return out


def nth(d: Column, *choices: Column) -> Column:
    """The choice that the draw falls on."""
    out = F.when(d % len(choices) == 0, choices[0])
    for k, c in enumerate(choices[1:], 1):
        out = out.when(d % len(choices) == k, c)
    return out


def scattered(v: Column, d: Column, percent: int, change: Callable[[Column], Column]) -> Column:
    """The value with each letter changed by the given chance, settled by the draw and the place of the letter."""
    letters = F.transform(F.split(v, ""), lambda c, i: F.when(((d + i * 7919) * _A) % _M % 100 < percent, change(c)).otherwise(c))
    return F.array_join(letters, "")


def corrupted(kind: Column, field: Column, v: Column, d: Column) -> Column:
    """The value after one operator; an operator that has nothing to work on leaves it."""
    e = (d * _A + 1) % _M  # a second draw, for operators that choose twice
    at = (e % F.greatest(F.length(v), F.lit(1)) + 1).cast("int")
    letter = F.substring(v, at, F.lit(1))
    slip = F.translate(F.when(letter == "I", "ı").when(letter == "İ", "i").otherwise(F.lower(letter)), TYPO_FROM, TYPO_TO)
    typo = F.concat(F.substring(v, F.lit(1), at - 1), slip, F.substring(v, at + 1, F.length(v)))
    words = F.split(F.trim(v), " +")
    short = F.when(F.size(words) > 1, F.array_join(F.transform(words, lambda w, i: F.when(i == e % F.size(words), F.concat(F.substring(w, 1, 3), F.lit("."))).otherwise(w)), " ")).otherwise(v)
    local = F.right(F.regexp_replace(v, r"\P{Nd}", ""), F.lit(10))
    block = lambda start, n: F.substring(local, start, n)
    phone = F.when(F.length(local) == 10, nth(
        d, F.concat_ws(" ", F.lit("0"), block(1, 3), block(4, 3), block(7, 4)), F.concat_ws(".", block(1, 3), block(4, 3), block(7, 4)), F.concat(F.lit("(0"), block(1, 3), F.lit(") "), block(4, 7)),
        F.concat(F.lit("90"), local), F.concat(F.lit("0"), local), F.concat_ws(" ", F.lit("+90"), block(1, 3), block(4, 7)),
    )).otherwise(v)
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    mail = F.when(F.contains(v, F.lit("@")), nth(d, F.concat(name, F.lit("@@"), domain), F.concat(name, domain), F.concat(F.replace(name, F.lit("."), F.lit("-")), F.lit("@"), domain), F.concat(name, F.lit("@"), F.substring_index(domain, ".", 1)))).otherwise(v)
    return (
        F.when(kind == "case_change", nth(d, F.upper(v), F.lower(v), title(v), scattered(v, e, 50, lambda c: F.when(F.upper(c) == c, F.lower(c)).otherwise(F.upper(c)))))
        .when(kind == "unicode_turkish", nth(d, F.translate(v, TURKISH, PLAIN), scattered(v, e, 30, lambda c: F.translate(c, TURKISH, PLAIN)), scattered(v, e, 20, lambda c: F.translate(c, PLAIN, TURKISH))))
        .when(kind == "whitespace", nth(d, F.regexp_replace(F.trim(v), " +", "  "), F.concat(F.lit("  "), F.trim(v), F.lit("  "))))
        .when(kind == "punctuation", nth(d, F.replace(v, F.lit(" "), F.lit("-")), F.replace(v, F.lit("."), F.lit(",")), F.replace(v, F.lit("."), F.lit(""))))
        .when(kind == "typo", typo)
        .when(kind == "abbreviation", short)
        .when((kind == "phone_format") & (field == "phone"), phone)
        .when((kind == "email_corruption") & (field == "email"), mail)
        .when(kind == "missing_value", F.lit(None).cast("string"))
        .when(kind == "field_conflict", nth(d, F.concat(v, F.lit(" Holding")), F.replace(v, F.lit("A.Ş."), F.lit("Ltd. Şti.")), F.concat(v, F.lit(" (devir)"))))
        .otherwise(v)
    )


_EVENT = ("corruption_type", "field_name", "before_value", "after_value", "severity", "person_id", "source_record_id", "source_name")


def corrupt(records: DataFrame, seed: int, profile: str = "formatting_noise", index: str = "person_index", drop_percent: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, events): each field is corrupted with its chance in the profile, at most so many of a record, the ones with the smallest draws.

    ``drop_percent``: after that, each field is emptied with this chance, which is an event of its own. An event is
    (corruption_type, field_name, before_value, after_value, severity, person_id, source_record_id, source_name); a field that was
    null or didn't change gives none.
    """
    p, i = PROFILES[profile], F.col(index)
    hit = [F.when(draw(seed, i, k, 1) % 100 < p["rates"].get(f, 0), F.struct(draw(seed, i, k, 2).alias("d"), F.lit(f).alias("f"))) for k, f in enumerate(CANONICAL_FIELDS)]
    chosen = F.transform(F.slice(F.array_sort(F.filter(F.array(*hit), lambda x: x.isNotNull())), 1, p["most"]), lambda x: x["f"])
    # one expression over the cells of a record serves all fields; the operator is settled before it is used
    cells = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v"), draw(seed, i, k, 3).alias("d3"), draw(seed, i, k, 4).alias("d4"), (draw(seed, i, k, 5) % 100 < drop_percent).alias("gone")) for k, f in enumerate(CANONICAL_FIELDS)))
    t = records.withColumn("_hit", chosen).withColumn("_cells", cells)
    t = t.withColumn("_cells", F.transform("_cells", lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v"), x["d4"].alias("d"), x["gone"].alias("gone"), weighted(x["d3"], p["weights"]).alias("kind"))))
    after = lambda x: F.when(F.array_contains("_hit", x["f"]) & x["v"].isNotNull(), corrupted(x["kind"], x["f"], x["v"], x["d"])).otherwise(x["v"])
    t = t.withColumn("_cells", F.transform("_cells", lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v"), F.when(x["gone"], "missing_value").otherwise(x["kind"]).alias("kind"), F.when(~x["gone"], after(x)).alias("after"))))
    changed = F.filter("_cells", lambda x: x["v"].isNotNull() & ~x["after"].eqNullSafe(x["v"]))
    grave = lambda kind: F.coalesce(*(F.when(kind == k, v) for k, v in SEVERITY.items()), F.lit("medium"))
    # explode_outer, as an inner one would infer a filter that repeats every operator
    log = t.select("person_id", "source_record_id", "source_name", F.explode_outer(changed).alias("e")).where("e IS NOT NULL")
    log = log.select(F.col("e.kind").alias("corruption_type"), F.col("e.f").alias("field_name"), F.col("e.v").alias("before_value"), F.col("e.after").alias("after_value"), grave(F.col("e.kind")).alias("severity"), "person_id", "source_record_id", "source_name")
    keep = [c for c in records.columns if c not in CANONICAL_FIELDS]
    return t.select(*keep, *(F.col("_cells")[k]["after"].alias(f) for k, f in enumerate(CANONICAL_FIELDS))), log.select(*_EVENT)


def padded(i: Column, width: int = 6) -> Column:
    s = i.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def source_records(people: DataFrame, name: str, prefix: str) -> DataFrame:
    return people.select(F.concat(F.lit(f"{prefix}-"), padded(F.col("person_index"))).alias("source_record_id"), F.lit(name).alias("source_name"), "person_index", "person_id", *CANONICAL_FIELDS)


# The three column layouts of source B, canonical field to header.
LAYOUTS = (
    {"first_name": "ad", "last_name": "soyad", "email": "e_mail", "phone": "gsm", "company": "sirket", "city": "sehir", "district": "ilce", "address": "adres"},
    {"first_name": "given_name", "last_name": "surname", "email": "email_address", "phone": "mobile", "company": "organization", "city": "il", "district": "mahalle", "address": "street"},
    {"first_name": "first_name", "last_name": "last_name", "email": "email", "phone": "cep_telefonu", "company": "company", "city": "city", "district": "district", "address": "address"},
)


def source_b(people: DataFrame, layout: int, seed: int = 42, missing_percent: int = 12) -> DataFrame:
    """Source B in one of its layouts: renamed columns, some values missing, extra columns legacy_code, or import_batch and notes."""
    t = source_records(people, "source_b", "B")
    i = F.col("person_index")
    cols = [F.when(draw(seed, i, k, 9) % 100 >= missing_percent, F.col(f)).alias(LAYOUTS[layout][f]) for k, f in enumerate(CANONICAL_FIELDS)]
    code = F.concat(F.lit("LEG-"), F.lpad(i.cast("string"), 5, "0")).alias("legacy_code")
    extra = [F.concat(F.lit("BATCH-"), F.lpad((i % 17).cast("string"), 3, "0")).alias("import_batch"), F.lit("imported").alias("notes")] if layout == 1 else [code]
    return t.select("source_record_id", "source_name", "person_id", *cols, *extra)


def layout_mapping(layout: int) -> list[tuple[str, str | None, str]]:
    """(column, canonical field or null, decision) of each column of a layout: what a mapper should find."""
    extra = ["import_batch", "notes"] if layout == 1 else ["legacy_code"]
    return [("source_record_id", None, "UNMAPPED"), ("source_name", None, "UNMAPPED"), *((h, f, "AUTO_MAP") for f, h in LAYOUTS[layout].items()), *((h, None, "UNMAPPED") for h in extra)]


#: People whose serial numbers are counted by one task.
SERIAL_BLOCK = 65_536


def serials(t: DataFrame, index: str, within: str, name: str) -> DataFrame:
    """Numbers from 1 without gaps in the order of index, then within. Blocks of the index are counted first, so no task holds all rows."""
    t = t.withColumn("_b", F.floor(F.col(index) / SERIAL_BLOCK))
    sizes = t.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each block
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(index, within))
    return t.join(before, "_b").withColumn(name, F.col("_before") + rank).drop("_b", "_before")


def source_c_copies(people: DataFrame, seed: int = 42, duplicate_percent: int = 8) -> DataFrame:
    """Every person once, some once more, before noise: copy tells which, and ids run over both without gaps."""
    copies = F.sequence(F.lit(0), F.when(draw(seed, F.col("person_index"), 20) % 100 < duplicate_percent, 1).otherwise(0))
    t = serials(people.select("*", F.explode(copies).alias("copy")), "person_index", "copy", "serial")
    return t.select(F.concat(F.lit("C-"), padded(F.col("serial"))).alias("source_record_id"), F.lit("source_c").alias("source_name"), "serial", "person_id", "copy", *CANONICAL_FIELDS)


def source_c(people: DataFrame, seed: int = 42, duplicate_percent: int = 8) -> tuple[DataFrame, DataFrame]:
    """(records, events) of source C: the copies with semantic noise, each copy with its own; a duplicate is an event too."""
    plain = source_c_copies(people, seed, duplicate_percent)
    records, log = corrupt(plain, seed + 3, "semantic_noise", "serial")
    pairs = positive_pairs(plain)
    again = pairs.select(
        F.lit("duplicate").alias("corruption_type"), F.lit("*").alias("field_name"), F.col("source_record_id_a").alias("before_value"), F.col("source_record_id_b").alias("after_value"),
        F.lit(SEVERITY["duplicate"]).alias("severity"), F.col("person_id_a").alias("person_id"), F.col("source_record_id_b").alias("source_record_id"), "source_name",
    )
    return records, log.unionByName(again)


def duplicate_groups(c: DataFrame) -> DataFrame:
    """(person_id, source_record_ids, source_name) of people with several records; a person has two at most."""
    g = c.groupBy("person_id", "source_name").agg(F.array_sort(F.collect_list("source_record_id")).alias("source_record_ids"))
    return g.where(F.size("source_record_ids") > 1).select("person_id", "source_record_ids", "source_name")


def positive_pairs(c: DataFrame, pair_type: str = "duplicate") -> DataFrame:
    """Original and copy of the same person, as pairs of records."""
    a, b = c.where("copy = 0"), c.where("copy = 1")
    j = a.select("person_id", F.col("source_record_id").alias("source_record_id_a"), "source_name").join(b.select("person_id", F.col("source_record_id").alias("source_record_id_b")), "person_id")
    return j.select(F.col("person_id").alias("person_id_a"), F.col("person_id").alias("person_id_b"), "source_record_id_a", "source_record_id_b", "source_name", F.lit(pair_type).alias("pair_type"))


def hard_positives(people: DataFrame, count: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, events, pairs): ``count`` people, those with the smallest draws, each as they are and once heavily corrupted with gaps."""
    some = people.withColumn("_d", draw(seed, F.col("person_index"), 41)).orderBy("_d", "person_index").limit(count)
    t = cut(some.drop("_d")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    t = serials(t, "person_index", "copy", "serial")
    t = t.select(F.concat(F.lit("hard_positive-"), padded(F.col("serial"))).alias("source_record_id"), F.lit("hard_positive").alias("source_name"), "serial", "person_id", "copy", *CANONICAL_FIELDS)
    bad, log = corrupt(t.where("copy = 1"), seed + 4, "hard_positive", "serial", drop_percent=35)
    return t.where("copy = 0").unionByName(bad), log, positive_pairs(t, "hard_positive")


def hard_negative_records(pairs: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, pairs with record ids): both people of each pair as they are, under ids of their own."""
    p = cut(pairs.select("person_id_a", "person_id_b", F.row_number().over(Window.orderBy(F.col("likeness").desc(), "person_id_a", "person_id_b")).alias("n")))  # as many rows as were asked for
    rid = lambda k: F.concat(F.lit("hard_negative-"), padded(F.col("n") * 2 - k))
    p = p.withColumns({"source_record_id_a": rid(1), "source_record_id_b": rid(0), "source_name": F.lit("hard_negative"), "pair_type": F.lit("hard_negative")}).drop("n")
    each = p.select(F.inline(F.array(*(F.struct(F.col(f"source_record_id_{x}").alias("source_record_id"), F.col(f"person_id_{x}").alias("person_id")) for x in "ab"))))
    return each.join(people.select("person_id", *CANONICAL_FIELDS), "person_id").withColumn("source_name", F.lit("hard_negative")), p


# What equal fields add to the likeness of two people.
LIKENESS = {"city": 0.25, "district": 0.20, "company": 0.25, "last_name": 0.20}
FIRST_LETTERS = 0.10


def likeness(a: str, b: str) -> Column:
    """Of two people of a join, from 0 to 1."""
    parts = [F.when(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), w).otherwise(0.0) for f, w in LIKENESS.items()]
    parts.append(F.when(F.substring(f"{a}.first_name", 1, 2) == F.substring(f"{b}.first_name", 1, 2), FIRST_LETTERS).otherwise(0.0))
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.round(out, 2)


def hard_negatives(people: DataFrame, count: int, least: float = 0.25) -> DataFrame:
    """The ``count`` pairs of different people who look most alike, of all pairs of at least that likeness; an error if there are fewer.

    People meet under every set of fields that makes a pair likely enough, and a pair counts under the set of all its equal fields. Of
    those who share a set no more are paired than give ``count`` pairs, which are then as much alike as any left out, so it stays linear.
    """
    fields = {f: (F.col(f), w) for f, w in LIKENESS.items()} | {"first_letters": (F.substring("first_name", 1, 2), FIRST_LETTERS)}
    sets = [c for n in range(1, len(fields) + 1) for c in combinations(fields, n) if round(sum(fields[f][1] for f in c), 2) >= least]
    t = people.select("person_id", "first_name", *LIKENESS).dropDuplicates(["person_id"])
    key = lambda k, c: F.when(reduce(and_, (fields[f][0].isNotNull() for f in c)), F.struct(F.lit(k).alias("k"), F.to_json(F.array(*(fields[f][0] for f in c))).alias("values")))
    t = t.withColumn("key", F.explode(F.array_compact(F.array(*(key(k, c) for k, c in enumerate(sets))))))
    order = Window.partitionBy("key").orderBy(F.xxhash64("person_id"), "person_id")
    t = t.withColumn("r", F.row_number().over(order)).where(F.col("r") <= math.isqrt(2 * count) + 2)
    same = lambda f: F.substring("a.first_name", 1, 2) == F.substring("b.first_name", 1, 2) if f == "first_letters" else F.col(f"a.{f}") == F.col(f"b.{f}")
    whole = [reduce(and_, (F.coalesce(same(f), F.lit(False)) == F.lit(f in c) for f in fields)) & (F.col("a.key.k") == k) for k, c in enumerate(sets)]
    j = t.alias("a").join(t.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.r") < F.col("b.r"))).where(reduce(or_, whole))
    j = j.select(F.least("a.person_id", "b.person_id").alias("person_id_a"), F.greatest("a.person_id", "b.person_id").alias("person_id_b"), likeness("a", "b").alias("likeness"))
    top = cut(j.orderBy(F.col("likeness").desc(), F.xxhash64("person_id_a", "person_id_b"), "person_id_a", "person_id_b").limit(count))
    if (n := top.count()) < count:
        raise ValueError(f"not enough pairs for hard negatives: {n} < {count}")
    return top.withColumn("pair_type", F.lit("hard_negative"))


def person_splits(people: DataFrame, seed: int = 99, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), index: str = "person_index") -> DataFrame:
    """(person_id, split) with exact counts: the order of the draws, cut at the whole numbers below each share.

    The rank is exact without one task holding all rows: draws are counted by bucket, buckets are ranked, then rows within buckets.
    """
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("the shares must sum to 1")
    t = people.select("person_id", F.col(index).alias("_i"), draw(seed, F.col(index), 31).alias("_d")).withColumn("_b", F.floor(F.col("_d") / F.lit(_M // 1024)))
    sizes = t.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 1025 rows
    total = sizes.agg(F.sum("_n").alias("_total"))
    t = t.join(F.broadcast(before), "_b").crossJoin(F.broadcast(total))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_d", "_i"))
    a, b = F.floor(F.col("_total") * shares[0]), F.floor(F.col("_total") * shares[1])
    return t.withColumn("_rank", rank).select("person_id", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "validation").otherwise("test").alias("split"))


def corruption_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("corruption_type").agg(F.count("*").alias("event_count"))


# Files that a reader must turn away or route, by name.
MALFORMED = {
    "empty_file.csv": b"",
    "header_only.csv": b"first_name,last_name,email,phone,city\n",
    "duplicate_header.csv": b"first_name,first_name,email\nAli,Veli,a@b.test\n",
    "missing_column_row.csv": b"first_name,last_name,email,phone,city\nAli,Kaya,a@b.test\n",
    "extra_column_row.csv": b"first_name,last_name,email,phone,city\nAli,Kaya,a@b.test,05321234567,Ankara,more\n",
    "broken_quotes.csv": b'first_name,last_name\n"Ali,Kaya\n',
    "semicolon_delimiter.csv": b"first_name;last_name\nAli;Kaya\n",
    "utf8_turkish.csv": "first_name,city\nŞule,İstanbul\n".encode(),
    "latin5_turkish.csv": b"first_name,city\nAli,Ankara\n",
}
