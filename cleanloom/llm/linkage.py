"""Problem 7: one person in two tables without a common key, as a hinge-loss problem."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.session import cut, drop
from cleanloom.llm.addresses import read_addresses, settle_addresses
from cleanloom.llm.names import align_udf, name_parts, short_forms
from cleanloom.llm.survivors import email_key, phone_key

#: Weights of the rules. Each rule is a squared hinge: what it pulls a match towards (1 or 0) and how hard.
WEIGHTS = {
    "email": 6.0,  # equal e-mails: match
    "phone": 4.0,  # equal phones: match
    "home": 3.0,  # equal buildings: match
    "prior": 1.0,  # two records aren't one person until something says so
    "other_email": 1.2,  # two different usable e-mails: no match
    "other_phone": 0.5,  # two different usable phones: no match
    "doubt": 3.0,  # times the part of the given names that doesn't agree: no match
    "exclusive": 4.0,  # a record matches one of two people who aren't one another
    "transitive": 4.0,  # a record matches both of two records of one person, or neither
}
MATCH = 0.5
#: Alternating directions end where no copy differs from its mean, and no mean (times rho) from the one before, by more than this.
TOLERANCE = 1e-6
#: Steps after which an error is raised; the problem is strongly convex, so that they don't come to an end only on broken input.
MOST_STEPS = 100_000
#: Rules of one partner up to which they are gathered in one row; the rules of a larger one stay in tables.
GROUP_RULES = 200_000


def people_rows(records: DataFrame, columns: dict[str, str], side: str) -> DataFrame:
    """One layout for both tables: rid (the record id), side, first, last, email, phone, city, district, address."""
    cols = [F.col(columns[c]).cast("string").alias(c) for c in ("first", "last", "email", "phone", "city", "district", "address")]
    return records.select(F.col(columns["id"]).cast("string").alias("rid"), *cols).where("rid IS NOT NULL").withColumn("side", F.lit(side))


SOURCE = {"id": "source_record_id", "first": "first_name", "last": "last_name", "email": "email", "phone": "phone", "city": "city", "district": "district", "address": "address"}
PARTNER = {"id": "source_record_id", "first": "given_name", "last": "surname", "email": "email_address", "phone": "mobile", "city": "il", "district": "mahalle", "address": "street"}


def signatures(people: DataFrame, reference: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class table, membership): records that agree in every compared attribute are one class.

    The address of a row is read in one pass and shuffles nothing. Everything that costs a shuffle is done only for records that can
    match: partner records, source records that share a block (e-mail name, end of a phone, number and street) with one, and source
    records that share one with those. A row gets its number as it is written, and a class the least number of its rows.
    """
    t = people.select("side", "rid", "first", "last", email_key(F.col("email")).alias("email"), phone_key(F.col("phone")).alias("phone"), "address", "city", "district")
    t = read_addresses(t, reference, aliases).drop("address", "city", "district", "quarter")
    read = cut(t.withColumn("id", F.monotonically_increasing_id()))
    t = read.where("email IS NOT NULL OR phone IS NOT NULL OR number IS NOT NULL")
    house = F.when(F.col("street").isNotNull(), F.concat_ws(" ", "street", "number"))
    full = settle_addresses(t).select("id", "side", "rid", "first", "last", "email", "phone", house.alias("house"), F.when(F.col("street").isNotNull(), F.col("city_id")).alias("city_id"))
    # which rows can match is told by hashes of the blocks alone: an equal hash lets a row too many through, never one too few
    key = cut(full.select("id", "side", F.explode(F.array(*(F.when(k.isNotNull(), F.xxhash64(k)) for k in blocks()))).alias("key")).where("key IS NOT NULL"))
    mine, theirs = key.where("side = 'a'").select("id", "key"), key.where("side = 'b'").select("key").distinct()
    first = mine.join(theirs, "key", "left_semi").select("id").distinct()
    reached = mine.join(first, "id", "left_semi").select("key").distinct()
    second = mine.join(reached, "key", "left_semi").select("id").distinct()
    part = cut(full.where("side = 'a'").join(second, "id", "left_semi").unionByName(full.where("side = 'b' AND (email IS NOT NULL OR phone IS NOT NULL OR house IS NOT NULL)")))
    attrs = ["side", "surname", "givens", "email", "phone", "house", "city_id"]
    # the hash comes first, as a sort compares its first column by itself
    t = cut(name_parts(part, t.select("first", "last"), least=1).withColumn("cls", F.min("id").over(Window.partitionBy(F.xxhash64(*attrs), *attrs))))
    for past in (read, key, part):
        drop(past)
    return t.where("id = cls").select(*attrs, "cls"), t.select("cls", "side", "rid")


def blocks() -> tuple[Column, ...]:
    """The values under which records meet, or null: partly equal ones suffice (an e-mail name at any domain, the last seven digits, a house in any city)."""
    return F.concat(F.lit("e"), F.substring_index("email", "@", 1)), F.concat(F.lit("p"), F.substring("phone", 4, 7)), F.concat(F.lit("h"), F.col("house"))


def candidates(c: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """Pairs (u, v) of classes that share a block and a surname or full given name, with the agreement of their attributes.

    u is of side a; v is of side b, or of side a and then u < v: two of side b are never compared, as no rule speaks of them.

    A block is one value with one name, so a value shared by many people (a switchboard, a mall) falls apart by name.
    """
    k = c.withColumn("name", F.explode(F.concat(F.array(F.col("surname")), F.col("givens")))).where(F.length("name") > 1)
    k = k.withColumn("key", F.explode(F.array(*blocks()))).where("key IS NOT NULL").select("cls", "side", F.xxhash64("name", "key").alias("key"))
    a, b = k.where("side = 'a'").select("key", F.col("cls").alias("u")), k.select("key", F.col("cls").alias("v"), "side")
    pairs = a.join(b, "key").where("side = 'b' OR u < v").select("u", "v").distinct()
    side = lambda s: c.select(*[F.col(x).alias(f"{x}_{s}") for x in ("side", "surname", "givens", "email", "phone", "house", "city_id")], F.col("cls").alias(s))
    return agreements(pairs.join(side("u"), "u").join(side("v"), "v"), forms)


#: Agreement of values of which only the part that makes a block is equal.
PARTLY = 0.5


def agreements(p: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """email, phone and home: 1 equal, PARTLY, -1 different, 0 unknown; family and given: how well the names agree."""
    u, v = lambda x: F.col(f"{x}_u"), lambda x: F.col(f"{x}_v")
    graded = lambda x, part: F.when(u(x).isNull() | v(x).isNull(), 0.0).when(u(x) == v(x), 1.0).when(part(u(x)) == part(v(x)), PARTLY).otherwise(-1.0)
    city = F.coalesce(F.when(u("city_id") == v("city_id"), 1.0).when(u("city_id") != v("city_id"), -1.0), F.lit(PARTLY))
    home = F.when(u("house").isNull() | v("house").isNull(), 0.0).when(u("house") == v("house"), city).otherwise(-1.0)
    p = p.withColumn("email", graded("email", lambda x: F.substring_index(x, "@", 1))).withColumn("phone", graded("phone", lambda x: F.substring(x, 4, 7))).withColumn("home", home)
    p = p.withColumn("given", align_udf(forms)("givens_u", "givens_v"))
    missing = (F.col("surname_u") == "") | (F.col("surname_v") == "")
    near = F.when(missing, 0.5).when(F.col("surname_u") == F.col("surname_v"), 1.0).when(F.levenshtein("surname_u", "surname_v") <= 2, 0.9)
    # a surname typed among the given names, or changed: the given name alone then carries the pair
    return p.withColumn("family", F.coalesce(near, F.lit(0.0))).select("u", "v", "side_u", "side_v", "email", "phone", "home", "given", "family")


def unary() -> tuple[Column, Column]:
    """Sums of the weights that pull a candidate towards 1 and towards 0."""
    w = WEIGHTS
    name = F.col("given") * F.col("family")
    pull = lambda x, k: F.greatest(F.col(x), F.lit(0.0)) * w[k]
    push = lambda x, k: F.when((F.col(x) < 1) & (F.col(x) != 0), w[k]).otherwise(0.0)
    toward = (pull("email", "email") + pull("phone", "phone") + pull("home", "home")) * F.when(name > 0, 1.0).otherwise(0.0)
    away = F.lit(w["prior"]) + push("email", "other_email") + push("phone", "other_phone") + w["doubt"] * (1 - F.when(name > 0, name).otherwise(-2.0))
    return toward, away


def match_people(
    source: DataFrame,
    partner: DataFrame,
    reference: DataFrame,
    aliases: DataFrame,
    given_name_forms: DataFrame,
    columns: tuple[dict[str, str], dict[str, str]] = (SOURCE, PARTNER),
    rho: float = 4.0,
) -> DataFrame:
    """(source_record_id_a, source_record_id_b, confidence) of records of both tables that are one person, confidence in (0.5, 1].

    Soft logic: each candidate pair has a truth value in [0, 1]. Weighted rules pull it: equal e-mail, phone or building with
    agreeing names towards 1, other e-mails, phones or given names towards 0. Two source classes that are one person match a
    partner class both or neither (transitivity, by which pairs without a common attribute get their value); two that aren't share
    it (exclusivity). All rules are squared hinges, so the problem is convex; alternating directions solve it: every rule
    improves its own copies of the values by a closed form, then the copies of each value are averaged, until both residuals are
    within TOLERANCE. A rule couples values of one partner class, so the problem falls apart by partner and each part is solved
    whole. Candidates without a coupling rule have their optimum in closed form and take no part in the steps.

    Null, blank, masked and placeholder attributes say nothing; records without a name or without any of e-mail, phone and
    building match nothing; repeated rows count once; extra columns are ignored; empty tables give an empty result.
    """
    forms = short_forms(given_name_forms)
    people = people_rows(source, columns[0], "a").unionByName(people_rows(partner, columns[1], "b"))
    c, member = signatures(people, reference, aliases)
    pairs = cut(candidates(c, forms))
    both = pairs.unionByName(pairs.where("side_v = 'a'").select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("side_v").alias("side_u"), F.col("side_u").alias("side_v"), "email", "phone", "home", "given", "family"))
    toward, away = unary()
    direct = both.where("side_u = 'a' AND side_v = 'b'").select("u", "v", toward.alias("t"), away.alias("z"))
    link = both.where("side_u = 'a' AND side_v = 'a'").select("u", F.col("v").alias("w"), (toward / (toward + away)).alias("p"))
    # by transitivity a class reaches the partners of classes that are surely the same person
    reached = link.where("p >= 0.6").join(direct.where("t / (t + z) >= 0.6").select(F.col("u").alias("w"), "v"), "w").select("u", "v").distinct()
    x = reached.join(direct, ["u", "v"], "full").select("u", "v", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("z", F.lit(WEIGHTS["prior"] / 4)).alias("z"))
    x = cut(x.withColumn("var", F.monotonically_increasing_id()))
    # coupling rules of two values with one partner
    left, right = x.select("v", "u", F.col("var").alias("i")), x.select("v", F.col("u").alias("w"), F.col("var").alias("j"))
    tied = left.join(link, "u").join(right, ["v", "w"]).where("i < j")
    rules = cut(tied.select("v", "i", "j", F.when(F.col("p") >= MATCH, "same").otherwise("other").alias("kind"), F.col("p")))
    coupled = rules.select(F.explode(F.array("i", "j")).alias("var")).distinct()
    free = x.join(coupled, "var", "left_anti").select("var", "u", "v", (F.col("t") / (F.col("t") + F.col("z"))).alias("y"))
    mine = cut(x.join(coupled, "var").select("v", "var", "t", "z"))
    y = solve_groups(mine, rules, rho)
    solved = x.join(y, "var").select("var", "u", "v", "y")
    found = free.unionByName(solved).where(F.col("y") > MATCH)
    a, b = member.where("side = 'a'").select(F.col("cls").alias("u"), F.col("rid").alias("source_record_id_a")), member.where("side = 'b'").select(F.col("cls").alias("v"), F.col("rid").alias("source_record_id_b"))
    out = found.join(a, "u").join(b, "v")
    return out.groupBy("source_record_id_a", "source_record_id_b").agg(F.round(F.max("y"), 4).alias("confidence"))


def rule_weight() -> Column:
    return F.when(F.col("kind") == "same", WEIGHTS["transitive"] * F.col("p")).otherwise(WEIGHTS["exclusive"] * (1 - F.col("p")))


def solve_groups(values: DataFrame, rules: DataFrame, rho: float, largest: int = GROUP_RULES) -> DataFrame:
    """Values (v, var, t, z) with rules (v, i, j, kind, p) within a v to (var, y), the optimum of each v to TOLERANCE.

    The values and rules of a v are gathered and many v are solved at once, each until it settles; a v of more than ``largest``
    rules is solved over tables.
    """
    hot = cut(rules.groupBy("v").count().where(F.col("count") > largest).select("v"))
    none = F.lit(None).cast("long")
    rows = values.select("v", F.struct(F.lit(0).alias("kind"), F.col("var").alias("i"), none.alias("j"), F.col("t").alias("a"), F.col("z").alias("b")).alias("r")).unionByName(
        rules.select("v", F.struct(F.when(F.col("kind") == "same", 1).otherwise(2).alias("kind"), "i", "j", rule_weight().alias("a"), F.lit(0.0).alias("b")).alias("r"))
    )
    some = not hot.isEmpty()
    if some:
        rows = rows.join(hot, "v", "left_anti")
    y = rows.groupBy("v").agg(F.collect_list("r").alias("rs")).select("rs").mapInArrow(lambda batches: settle_batches(batches, rho), "var long, y double")
    if some:
        y = y.unionByName(solve(values.join(hot, "v", "left_semi").drop("v"), rules.join(hot, "v", "left_semi").drop("v"), MOST_STEPS, rho))
    return cut(y)


def settle_batches(batches: Iterator[pa.RecordBatch], rho: float) -> Iterator[pa.RecordBatch]:
    """Batches of rows rs, an array of the values (kind 0) and rules (1 same, 2 other) of one group, to (var, y)."""
    for batch in batches:
        lists = batch.column(0)
        r = lists.flatten()
        group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        col = lambda k: r.field(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        kind, first, a, b = col("kind"), col("i"), col("a"), col("b")
        value, rule = kind == 0, kind > 0
        order = np.argsort(first[value])
        var = first[value][order]
        second = r.field("j").fill_null(0).to_numpy(zero_copy_only=False)
        at = lambda ids: np.searchsorted(var, ids[rule])  # noqa: E731, B023
        y = settle(a[value][order], b[value][order], group[value][order], at(first), at(second), kind[rule] == 1, a[rule], rho)
        yield pa.RecordBatch.from_arrays([pa.array(var), pa.array(y)], names=["var", "y"])


def settle(t: np.ndarray, z: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray, same: np.ndarray, w: np.ndarray, rho: float) -> np.ndarray:
    """Consensus alternating directions as in solve(), over arrays: a group leaves them when both of its residuals are in TOLERANCE."""
    out = t / (t + z)
    mine, y = np.arange(len(t)), out.copy()
    di, dj = np.zeros(len(w)), np.zeros(len(w))
    for step in range(MOST_STEPS):
        vi, vj = y[i] - di, y[j] - dj
        gap = 2 * w / (rho + 4 * w) * np.where(same, vi - vj, np.maximum(vi + vj - 1, 0.0))
        xi, xj = vi - gap, np.where(same, vj + gap, vj - gap)
        n = np.bincount(i, minlength=len(y)) + np.bincount(j, minlength=len(y))
        s = np.bincount(i, xi + di, len(y)) + np.bincount(j, xj + dj, len(y))
        old, y = y, np.clip((2 * t + rho * s) / (2 * t + 2 * z + rho * n), 0.0, 1.0)
        di, dj = di + xi - y[i], dj + xj - y[j]
        if step % 5 < 4:
            continue
        off = np.zeros(group.max() + 1 if len(group) else 0)
        np.maximum.at(off, group, rho * np.abs(y - old))
        np.maximum.at(off, group[i], np.maximum(np.abs(xi - y[i]), np.abs(xj - y[j])))
        out[mine] = y
        stay = off[group] > TOLERANCE
        if not stay.any():
            return out
        if not stay.all():
            rules, place = stay[i], np.cumsum(stay) - 1
            i, j, same, w, di, dj = place[i[rules]], place[j[rules]], same[rules], w[rules], di[rules], dj[rules]
            t, z, group, mine, y = t[stay], z[stay], group[stay], mine[stay], y[stay]
    raise ArithmeticError(f"not settled after {MOST_STEPS} steps")


def solve(values: DataFrame, rules: DataFrame, steps: int, rho: float) -> DataFrame:
    """Consensus alternating directions: values (var, t, z) with rules (i, j, kind, p) to (var, y).

    The pull of a value's own rules, t towards 1 and z towards 0, is kept in the averaging step, which then has the closed form
    (2 t + rho * sum(copy + dual)) / (2 t + 2 z + rho * n). A rule minimises w * hinge(c . x + d)^2 + rho / 2 * |x - (y - dual)|^2.
    The steps end when both residuals are within TOLERANCE, at the latest after ``steps``.
    """
    exact = F.col("kind") == "same"
    w = rule_weight()
    y = values.select("var", (F.col("t") / (F.col("t") + F.col("z"))).alias("y"))
    r = rules.withColumn("w", w).withColumn("di", F.lit(0.0)).withColumn("dj", F.lit(0.0))
    for step in range(steps):
        r = r.join(y.select(F.col("var").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("var").alias("j"), F.col("y").alias("yj")), "j")
        if step:  # the duals follow the disagreement of the last copies with the new mean
            r = r.withColumn("di", F.col("di") + F.col("xi") - F.col("yi")).withColumn("dj", F.col("dj") + F.col("xj") - F.col("yj"))
        vi, vj = F.col("yi") - F.col("di"), F.col("yj") - F.col("dj")
        # same: (xi - xj)^2, both hinges of the equality; other: hinge(xi + xj - 1)^2
        move = 2 * F.col("w") / (rho + 4 * F.col("w"))
        gap = F.when(exact, vi - vj).otherwise(F.greatest(vi + vj - 1, F.lit(0.0)))
        r = r.select("i", "j", "kind", "p", "w", "di", "dj", (vi - move * gap).alias("xi"), F.when(exact, vj + move * gap).otherwise(vj - move * gap).alias("xj"))
        r = cut(r)
        copy = lambda k: F.struct(F.col(k).alias("var"), (F.col(f"x{k}") + F.col(f"d{k}")).alias("c"), F.col(f"x{k}").alias("x"))
        copies = r.select(F.inline(F.array(copy("i"), copy("j"))))
        s = copies.groupBy("var").agg(F.sum("c").alias("s"), F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        mean = (2 * F.col("t") + rho * F.col("s")) / (2 * F.col("t") + 2 * F.col("z") + rho * F.col("n"))
        old = y
        new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))
        off = F.greatest(F.abs(F.col("low") - F.col("new")), F.abs(F.col("high") - F.col("new")), rho * F.abs(F.col("new") - F.col("y")))
        y = cut(values.join(s, "var").join(old, "var").withColumn("new", new).select("var", F.col("new").alias("y"), off.alias("off")))
        for past in [old, last] if step else []:
            drop(past)
        last = r
        if not y.where(F.col("off") > TOLERANCE).take(1):
            break
    return y.select("var", "y")
