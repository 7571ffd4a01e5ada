"""Problem 4: the best representative of each duplicate group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.text import fold, present, strip
from cleanloom.llm.strings import PLACEHOLDERS

# An address as a usable e-mail, with a domain of at least two parts.
EMAIL = r"^[^@\s*]+@[^@\s.*]+(\.[^@\s.*]+)*\.[A-Za-z]{2,}$"


def no_placeholder(x: Column) -> Column:
    """Says something: not null, blank or one of the fixed placeholders, and has a letter or digit."""
    y = F.btrim(F.regexp_replace(fold(strip(x)), " +", " "), F.lit(" -._,;:!?*"))
    return F.coalesce(present(x) & (y != "") & ~y.isin(*PLACEHOLDERS), F.lit(False))


def email_key(x: Column) -> Column:
    """The e-mail in lower case, null unless usable: masked, cut-short and malformed ones are not."""
    y = F.lower(strip(x))
    return F.when(y.rlike(EMAIL), y)


def phone_key(x: Column) -> Column:
    """The ten digits of a phone number, null unless usable: masked ones (``*`` or ``X``) and those with other lengths are not."""
    d = F.regexp_replace(F.regexp_replace(x, r"\P{Nd}+", ""), r"^(?:00)?(?:90)?0?", "")
    return F.when(d.rlike(r"^[2-9][0-9]{9}$") & ~x.rlike(r"[*\p{L}]"), d)


def usable(field: str, x: Column) -> Column:
    if field == "email":
        return email_key(x).isNotNull()
    if field == "phone":
        return phone_key(x).isNotNull()
    if field == "address":
        return no_placeholder(x) & F.coalesce(x.rlike(r"\p{L}{2}") & x.rlike(r"\p{Nd}"), F.lit(False))
    return no_placeholder(x) & F.coalesce(F.length(strip(x)) > 2, F.lit(False))


#: Fields that are taken from one record together: (bundle, its leading field, the others). Order is the order of importance. A place
#: stands in where the surviving address record tells no city.
BUNDLES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("address", "address", ("city", "district")),
    ("email", "email", ()),
    ("phone", "phone", ()),
    ("company", "company", ()),
    ("place", "city", ("district",)),
    ("name", "last_name", ("first_name",)),
)
#: Functional dependencies between bundles, by a key that both have: where an address names a city, the place must be of that city.
DEPENDENCIES: tuple[tuple[str, str], ...] = (("address", "place"),)


def branch_and_bound(options: Sequence[Sequence[tuple[float, str | None]]], ties: Sequence[tuple[int, int]]) -> list[int | None]:
    """One option of each bundle, or none, of highest total trust, such that tied bundles have equal keys where both have one.

    options: for each bundle (trust, key), trust above 0. A branch ends where its trust plus the best of the bundles to come can't
    beat the best found. Of equal totals the first in order of options wins.
    """
    order = [sorted(range(len(o)), key=lambda i: (-o[i][0], i)) for o in options]
    ahead = [0.0] * (len(options) + 1)
    for k in range(len(options) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + max((t for t, _ in options[k]), default=0.0)
    best: tuple[float, list[int | None]] = (-1.0, [])
    chosen: list[int | None] = [None] * len(options)

    def fits(k: int, i: int) -> bool:
        for a, b in ties:
            if k in (a, b):
                other = a if k == b else b
                j = chosen[other] if other < k else None
                if j is not None and None not in (options[k][i][1], options[other][j][1]) and options[k][i][1] != options[other][j][1]:
                    return False
        return True

    def go(k: int, trust: float) -> None:
        nonlocal best
        if trust + ahead[k] <= best[0]:
            return
        if k == len(options):
            best = (trust, list(chosen))
            return
        for i in order[k]:
            if fits(k, i):
                chosen[k] = i
                go(k + 1, trust + options[k][i][0])
        chosen[k] = None
        go(k + 1, trust)

    go(0, 0.0)
    return best[1]


def survivors(groups: DataFrame, records: DataFrame, registry: DataFrame, reference: DataFrame, person_col: str = "person_id", id_col: str = "source_record_id") -> DataFrame:
    """One surviving record for each group: (person_id, <field>, <field>_record_id ...), a field being null if no value is usable.

    Candidates are whole bundles of fields of one record: an address with its city and district, a city with its district, a last name with
    its first name. Two functional dependencies hold. district -> city: a record whose district isn't one of its city offers neither
    of them, only its address. address -> city: the place that stands in for an address without a city must not contradict the city which
    that address's record is in by its district. The trust of a candidate is its rank in its bundle: later updated_at first
    (null last), then the more trusted source, then the smaller id. Branch and bound picks one candidate of each bundle with the highest
    total trust, a more important bundle outweighing all less important ones, among the choices in which all dependencies hold.

    Groups are reduced before they are gathered: of each person, bundle and city only the best candidate is kept, so one person's
    rows are at most one more than the reference has cities, however many records the group has. A record counts once although its
    id stands twice in a group or was delivered twice (the latest delivery counts). Ids without a record are passed over; a group
    without any usable value still gives a row.
    """
    g = groups.select(F.col(person_col).alias("person"), F.explode_outer(F.array_distinct("source_record_ids")).alias("id")).where("person IS NOT NULL").distinct()
    fields = sorted({f for _, lead, more in BUNDLES for f in (lead, *more)})
    rank = registry.groupBy("source_name").agg(F.min("trust_rank").alias("trust_rank"))
    r = records.select(F.col(id_col).alias("id"), "source_name", "updated_at", "ingested_at", *fields)
    t = g.join(r, "id", "left")
    latest = F.max_by(F.struct("source_name", "updated_at", *fields), F.coalesce("ingested_at", F.lit("0001-01-02").cast("timestamp")))
    t = t.groupBy("person", "id").agg(latest.alias("r")).select("person", "id", "r.*")
    # the registry of sources and the reference of places are fixed lists, and far below the broadcast limit that Spark checks itself
    t = t.join(rank, "source_name", "left")
    name = fold(strip(F.col("canonical_name")))
    cities = reference.where("kind = 'city'").groupBy(name.alias("city_key")).agg(F.collect_set("place_id").alias("city_ids"))
    districts = reference.where("kind = 'district'").groupBy(name.alias("district_key")).agg(F.array_compact(F.collect_set("parent_place_id")).alias("parents"))
    home = reference.where("kind = 'city'").select(F.col("place_id").alias("only"), name.alias("of_district"))
    t = t.withColumn("city_key", fold(strip(F.col("city")))).withColumn("district_key", fold(strip(F.col("district")))).join(cities, "city_key", "left").join(districts, "district_key", "left")
    t = t.withColumn("only", F.when(F.size("parents") == 1, F.col("parents")[0])).join(home, "only", "left")
    known, listed = F.col("city_ids").isNotNull(), F.col("parents").isNotNull()
    holds = ~(known & listed) | F.arrays_overlap("city_ids", "parents")
    # the city that the record is in: its own, or that of its district; none if the two contradict one another
    t = t.withColumn("holds", F.coalesce(holds, F.lit(True))).withColumn("city_key", F.when(F.col("holds"), F.coalesce(F.when(known, F.col("city_key")), F.col("of_district"))))
    trust = F.struct(
        F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))).alias("at"),
        F.coalesce(-F.col("trust_rank"), F.lit(-(2**31) + 1)).cast("long").alias("rank"),
    )
    told = F.col("holds") & F.coalesce(usable("city", F.col("city")), F.lit(False))
    best = []
    for name, lead, more in BUNDLES:
        ok = usable(lead, F.col(lead)) & F.col("id").isNotNull()
        if name == "place":
            ok = ok & known & F.col("holds")
        kept = lambda f: F.when(told, F.col(f)).alias(f) if name == "address" and f != lead else F.col(f)  # noqa: B023, E731
        value = F.struct(trust.alias("trust"), F.col("id"), *(kept(f) for f in (lead, *more)))
        # max_by is not settled among equals, so the smaller id is made to win by its place in the order
        best.append(F.min_by(F.when(ok, value), F.when(ok, F.struct((-trust["at"]).alias("a"), (-trust["rank"]).alias("b"), F.col("id").alias("c")))).alias(name))
    t = t.groupBy("person", "city_key").agg(*best)
    wide = t.groupBy("person").agg(F.collect_list(F.struct("city_key", *(b[0] for b in BUNDLES))).alias("rows"))
    schema = "person string, " + ", ".join(f"{f} string, {f}_record_id string" for f in fields)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"person": p} | survivor(rs) for p, rs in zip(part["person"], part["rows"])]
            yield pd.DataFrame(rows, columns=["person", *(c for f in fields for c in (f, f"{f}_record_id"))], dtype=object)

    return wide.mapInPandas(solve, schema).withColumnRenamed("person", person_col)


def survivor(rows: Sequence[dict]) -> dict[str, str | None]:
    """The chosen value and record of each field, from rows of a city_key and the best candidate of each bundle there."""
    names = [b[0] for b in BUNDLES]
    ties = [(names.index(a), names.index(b)) for a, b in DEPENDENCIES]
    cand = [sorted(((x[n], x["city_key"]) for x in rows if x[n] is not None), key=lambda c: (-c[0]["trust"]["at"], -c[0]["trust"]["rank"], c[0]["id"])) for n in names]
    options = [[(4.0 ** (len(names) - k) * (1 + 1 / (i + 1)), key) for i, (_, key) in enumerate(cs)] for k, cs in enumerate(cand)]
    out: dict[str, str | None] = {}
    for (_, lead, more), i, cs in zip(BUNDLES, branch_and_bound(options, ties), cand):
        for f in (lead, *more):
            if i is not None and out.get(f) is None:
                out[f], out[f"{f}_record_id"] = cs[i][0][f], cs[i][0]["id"] if cs[i][0][f] is not None else None
    return out


def survivor_records(survivors: DataFrame, fields: Sequence[str] = ("email", "phone", "company", "address"), person_col: str = "person_id", id_col: str = "source_record_id") -> DataFrame:
    """(person_id, field_name, source_record_id): which record's value survives; no row where none does."""
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_record_id").alias(id_col)) for f in fields))
    return survivors.select(person_col, F.inline(each)).where(F.col(id_col).isNotNull())
