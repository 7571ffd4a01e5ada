"""Problem 1: the same postal address written differently."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.session import cut, lookup
from cleanloom.functions.text import fold_py
from cleanloom.llm.places import matchers, reference_entries, words
from cleanloom.llm.strings import corrections

# Words that mark a part of a Turkish address, folded.
STREET = ("sokagi", "sokak", "sok", "sk", "caddesi", "cadde", "cad", "cd", "bulvari", "bulvar", "bulv", "blv")
QUARTER = ("mahallesi", "mahalle", "mah", "mh")
HOUSE = ("apartmani", "apartman", "apt", "ap")
NUMBER = ("numara", "no", "n")
INSIDE = ("kat", "k", "daire", "d")
_PART = {w: part for part, ws in (("street", STREET), ("quarter", QUARTER), ("house", HOUSE), ("number", NUMBER), ("inside", INSIDE)) for w in ws}

#: Rarity, in natural logarithms of rows for each row with the word, that common words must reach together: one word of a quarter
#: has it, the name of a house that stands in every town has not.
ENOUGH = 4.0
#: A street may be taken for a slip of another one only if it is so many times rarer.
DOMINANCE = 4

#: A folded address as words, runs of digits and the marks / - #.
_TOKEN = re.compile(r"[a-z]+|[0-9]+|[/#-]")


def address_parts(address: str, places: frozenset[str]) -> tuple[str, str | None, str | None, str, str, str | None] | None:
    """(number, street, quarter, house, others, postcode) of a folded address, None if there is no number.

    number is the house number with its letter (``7b``), whatever its length: the first one with a mark, else the first one that is
    neither floor nor flat nor, with five digits, the postcode. street, quarter and house are the words before their marks. others
    are the remaining words that are none of ``places``, with a + before those that stand in front of the name of a house.
    """
    tokens = _TOKEN.findall(address)
    last = len(tokens) - 1
    number = bare = code = None
    at = [_PART.get(t) or (t.isalpha() and "free") for t in tokens]
    for i, t in enumerate(tokens):
        if not t.isdigit():
            continue
        before = at[i - 1] if i else None
        if before == "inside":
            continue
        marked = before == "number" or i and tokens[i - 1] == "#"
        if len(t) == 5 and not marked:
            code = code or t
            continue
        if number is not None or bare is not None and not marked:
            continue
        k = i + 2 if i < last and tokens[i + 1] in "/-" else i + 1
        letter = ""
        if k <= last and len(tokens[k]) == 1 and tokens[k].isalpha() and not (at[k] == "inside" and k < last and tokens[k + 1].isdigit()):
            letter = tokens[k]
        if marked:
            number = t + letter, k if letter else -1
        else:
            bare = t + letter, k if letter else -1
    if number is None and bare is None:
        return None
    number, used = number or bare
    if used >= 0:
        at[used] = "letter"
    street = quarter = house = None
    run = -1
    for i in range(1, last + 1):
        part = at[i]
        if at[i - 1] != "free" or part not in ("street", "quarter", "house"):
            continue
        word = tokens[i - 1]
        at[i - 1] = "used"
        if part == "street":
            street = street or word
        elif part == "quarter":
            quarter = quarter or word
        elif house is None:
            house, run = word, i - 2
    double = _double(places)
    others = [("+" if i == run else "") + t for i, t in enumerate(tokens) if at[i] == "free" and len(t) > 1 and t not in places and not (t in double and _phrase(tokens, i, places))]
    return number, street, quarter, house or "", " ".join(others), code


@lru_cache(8)
def _double(places: frozenset[str]) -> frozenset[str]:
    """The words of the names of places of two words."""
    return frozenset(w for p in places if p.count(" ") == 1 for w in p.split(" "))


def _phrase(tokens: list[str], i: int, places: frozenset[str]) -> bool:
    """Whether a word is part of the name of a place of two words."""
    return i + 1 < len(tokens) and f"{tokens[i]} {tokens[i + 1]}" in places or i > 0 and f"{tokens[i - 1]} {tokens[i]}" in places


PARTS = ("number", "street", "quarter", "house", "others", "postcode", "city_id")


def read_addresses(records: DataFrame, reference: DataFrame, aliases: DataFrame, columns: tuple[str, str, str] = ("address", "city", "district")) -> DataFrame:
    """The records with the parts of their address (address_parts) and the city it lies in; null where it names no building; no shuffle.

    A condition on the parts belongs behind cut(): the optimizer would put it below the worker and read every address twice.
    """
    entries = reference_entries(reference, aliases)
    t = records.withColumns({f"_in_{k}": F.col(c).cast("string") for k, c in zip("acd", columns)})
    usable = F.col("_in_a").rlike(r"\p{Nd}") & F.col("_in_a").rlike(r"\p{L}{2}")
    t = t.withColumn("_p", parts_udf(entries)("_in_c", "_in_d", F.when(usable, F.col("_in_a"))))
    return t.select(*records.columns, *(F.col(f"_p.{c}").alias(c) for c in PARTS))


def parts_udf(entries: dict[str, list[tuple[int, str, int | None]]]) -> Callable[[Column, Column, Column], Column]:
    """(city, district, address as typed) to the parts of the address and the city: of the city value, else the last one named in the address,
    else that of a district of one city."""

    @F.pandas_udf("number string, street string, quarter string, house string, others string, postcode string, city_id int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = matchers(entries)
        city, district = m["city"], m["district"]
        places = frozenset(city.ids) | frozenset(district.ids)
        typed = lru_cache(100_000)(city.resolve)

        def of_district(keys: Iterable[str]) -> int | None:
            for k in keys:
                homes = {district.parent[i] for i in district.ids[k]} - {None}
                if len(homes) == 1:
                    return homes.pop()
            return None

        def home(c: str | None, d: str | None, a: str) -> int | None:
            at = typed(c)
            if at:
                return at
            text = words(a)
            last = city.mentions(text)[-1:]
            return city.ids[last[0]][0] if last else (of_district(district.names(d)) if d is not None else None) or of_district(reversed(district.mentions(text)))

        for cs, ds, aa in parts:
            columns: tuple[list, ...] = tuple([None] * len(aa) for _ in PARTS)
            for i, (c, d, a) in enumerate(zip(cs, ds, aa)):
                p = address_parts(a := fold_py(a), places) if a is not None else None
                if p is not None:
                    for column, v in zip(columns, p):
                        column[i] = v
                    columns[-1][i] = home(c, d, a)
            out = pd.DataFrame(dict(zip(PARTS, columns)), dtype=object)
            out["city_id"] = out["city_id"].astype("Int32")
            yield out

    return run


def settle_addresses(t: DataFrame) -> DataFrame:
    """Addresses without a mark of a street get one, streets are corrected, and cities that only a postcode tells are filled in.

    A street without a mark is the first of the other words, but for one that mostly stands before the name of the house over all rows. Streets are
    corrected against the spellings of all rows (see corrections()). The city of a postcode is that of most rows with it. t is
    read several times, so it should be written.
    """
    named = t.where("contains(others, '+')").select("house", F.explode(F.split("others", " ")).alias("w")).where("startswith(w, '+')").groupBy("house", F.expr("substring(w, 2)").alias("word")).agg(F.count("*").alias("n"))
    houses = t.where("house <> ''").groupBy("house").agg(F.count("*").alias("m"))
    house_words = named.join(houses, "house").where("2 * n > m").agg(F.collect_set("word").alias("house_words"))
    t = t.crossJoin(lookup(house_words))  # one row: first words of the names of houses of two
    bare = F.get(F.array_except(F.filter(F.split(F.replace("others", F.lit("+"), F.lit("")), " "), lambda w: w != ""), F.col("house_words")), F.lit(0))
    t = t.withColumn("street", F.coalesce("street", F.when(F.col("street").isNull(), bare))).drop("house_words")
    codes = t.where("postcode IS NOT NULL AND city_id IS NOT NULL").groupBy("postcode", "city_id").count()
    codes = codes.groupBy("postcode").agg(F.max_by("city_id", F.struct("count", "city_id")).alias("code_city"))
    fixes = corrections(t.where("street IS NOT NULL").groupBy(F.col("street").alias("token")).agg(F.count("*").alias("n")))
    t = t.join(lookup(fixes.select(F.col("token").alias("street"), "fixed")), "street", "left").withColumn("street", F.coalesce("fixed", "street")).drop("fixed")
    return t.join(lookup(codes), "postcode", "left").withColumn("city_id", F.coalesce("city_id", "code_city")).drop("code_city")


def address_words(records: DataFrame, reference: DataFrame, aliases: DataFrame, id_col: str = "source_record_id", columns: tuple[str, str, str] = ("address", "city", "district")) -> DataFrame:
    """(id, number, street, city_id, quarter, words): one row per id with a usable address.

    The block of an address is its number tokens and its rare word, the street; words are the other ones (quarter, house and what
    else stands there). city_id is null where nothing tells it.
    """
    t = read_addresses(records.select(F.col(id_col).cast("string").alias("id"), *columns).where("id IS NOT NULL"), reference, aliases, columns)
    t = t.select("id", *PARTS).dropDuplicates(["id"]).where("number IS NOT NULL")
    t = settle_addresses(cut(t)).where("street IS NOT NULL")
    left = F.array_distinct(F.filter(F.concat(F.array("quarter", "house"), F.split(F.replace("others", F.lit("+"), F.lit("")), " ")), lambda w: (w != "") & (w != F.col("street"))))
    return t.select("id", "number", "street", "city_id", "quarter", left.alias("words"))


def slip_limit(a: Column, b: Column) -> Column:
    """Edits up to which one word may be a slip of the other: none below four letters, one below seven, two from there."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n < 4, 0).when(n < 7, 1).otherwise(2)


def building_classes(records: DataFrame, reference: DataFrame, aliases: DataFrame, id_col: str = "source_record_id", columns: tuple[str, str, str] = ("address", "city", "district")) -> DataFrame:
    """(id, building, records): the building that each usable address denotes, as text, and how many records denote it.

    Numbers first: addresses meet in blocks of their number tokens and one rare word, the street, or else the quarter; within a
    block, what stands in one city is compared as one, never record by record, so that a frequent building is one row. Of the words
    left the common ones (array_intersect) count by their rarity over all rows, and words that find no equal one are compared by
    Levenshtein distance:

    * in one city, streets of one block (number and quarter) that differ by a slip are one street, if one is far rarer;
    * an address without a city belongs to the building of its block with which its common words weigh ENOUGH or whose quarter
      differs by a slip only, if exactly one city is accepted so; else it stands with those of the same quarter.

    Null, blank and placeholder addresses give nothing; repeated ids count once; extra columns are ignored; an empty table gives an
    empty result.
    """
    k = cut(address_words(records, reference, aliases, id_col, columns))
    rarity = cut(k.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).crossJoin(F.broadcast(k.agg(F.count("*").alias("total")))).select("word", F.log(F.col("total") / F.col("n")).alias("weight")))  # total is one row
    block = ["number", "street", "city_id"]
    # the words of a building, each once, however many records it has
    seen = cut(k.where("city_id IS NOT NULL").select(*block, F.explode_outer(F.concat(F.transform("words", lambda w: F.struct(w.alias("word"), (w == F.col("quarter")).alias("is_quarter"))))).alias("w")).groupBy(*block, "w").agg(F.count("*").alias("n")).select(*block, "w.*", "n"))
    merged = street_slips(seen, k)
    k = k.join(lookup(merged), block, "left").withColumn("street", F.coalesce("main", "street")).drop("main")
    seen = seen.join(lookup(merged), block, "left").withColumn("street", F.coalesce("main", "street")).drop("main")
    known, lost = k.where("city_id IS NOT NULL"), k.where("city_id IS NULL AND quarter IS NOT NULL")
    buildings = seen.groupBy(*block).agg(F.array_compact(F.collect_set("word")).alias("theirs"), F.collect_set(F.when(F.col("is_quarter"), F.col("word"))).alias("quarters"))
    mine = cut(lost.groupBy("number", "street", "quarter", "words").agg(F.count("*").alias("n")).withColumn("mine", F.xxhash64("number", "street", "quarter", F.to_json("words"))))
    met = mine.join(buildings.withColumnRenamed("city_id", "near_city"), ["number", "street"]).withColumn("common", F.array_intersect("words", "theirs"))
    met = met.withColumn("slip", F.exists("quarters", lambda q: F.levenshtein(q, F.col("quarter")) <= slip_limit(q, F.col("quarter"))) & ~F.array_contains("common", F.col("quarter")))
    weights = met.select("mine", "near_city", F.explode_outer("common").alias("word"), "slip").join(lookup(rarity), "word", "left")
    met = weights.groupBy("mine", "near_city").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.max("slip").alias("slip")).where((F.col("weight") >= ENOUGH) | F.col("slip"))
    homes = met.groupBy("mine").agg(F.min("near_city").alias("home"), F.count("*").alias("cities")).where("cities = 1")
    homes = mine.join(homes, "mine").select("number", "street", "quarter", "words", "home")
    placed = lost.drop("city_id").join(homes, ["number", "street", "quarter", "words"], "left")
    where = F.coalesce(F.col("home").cast("string"), F.concat(F.lit("q:"), F.col("quarter")))
    at = known.select("id", "number", "street", F.col("city_id").cast("string").alias("at")).unionByName(placed.select("id", "number", "street", where.alias("at")))
    at = cut(at.select("id", F.concat_ws(" ", "street", "number", "at").alias("building")))
    return at.join(at.groupBy("building").agg(F.count("*").alias("records")), "building").select(F.col("id").alias(id_col), "building", "records")


def street_slips(seen: DataFrame, k: DataFrame) -> DataFrame:
    """(number, street, city_id, main): streets that are slips of another one with the same number and quarter in the same city."""
    n = k.groupBy("street").agg(F.count("*").alias("rows"))
    q = seen.where("is_quarter").join(n, "street").select("number", "city_id", "word", "street", "rows")
    far = q.select("number", "city_id", "word", F.col("street").alias("main"), F.col("rows").alias("main_rows"))
    met = q.join(far, ["number", "city_id", "word"]).where((F.col("street") != F.col("main")) & (F.col("main_rows") >= DOMINANCE * F.col("rows")))
    met = met.where(F.levenshtein("street", "main") <= slip_limit(F.col("street"), F.col("main")))
    return met.groupBy("number", "street", "city_id").agg(F.max_by("main", F.struct("main_rows", "main")).alias("main"))


def same_buildings(records: DataFrame, reference: DataFrame, aliases: DataFrame, id_col: str = "source_record_id") -> DataFrame:
    """Pairs of records whose addresses denote one building (building_classes): (source_record_id_a, source_record_id_b), a < b."""
    c = cut(building_classes(records, reference, aliases, id_col).where("records > 1").drop("records"))
    a, b = c.withColumnRenamed(id_col, f"{id_col}_a"), c.withColumnRenamed(id_col, f"{id_col}_b")
    return a.join(b, "building").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b")
