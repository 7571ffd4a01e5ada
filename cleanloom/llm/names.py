"""Problem 6: variant spellings of the names of people and organisations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.session import cut, lookup
from cleanloom.functions.text import fold, fold_py, present
from cleanloom.llm.strings import PLACEHOLDERS, corrections, delete_forms, edit_count, osa, reach, reach_forms

# Titles before Turkish and English names, folded.
TITLES = ("dr", "sn", "bay", "bayan", "sayin", "prof", "doc", "av", "muh", "mr", "mrs", "ms")
# Common lines of business in Turkish company names, folded; a value may cut them to three letters or more. Others are
# learned from the names themselves (business_lines).
SECTORS = (
    "mobilya", "sigortacilik", "tarim", "makina", "turizm", "ambalaj", "seramik", "kirtasiye", "gida", "elektrik", "tekstil", "denizcilik",
    "madencilik", "matbaacilik", "kimya", "peyzaj", "otomotiv", "nakliyat", "medikal", "hayvancilik", "reklamcilik", "plastik",
)
SECTOR_SHORT = {"elk": "elektrik"}
# Legal forms and other words that don't tell companies apart, folded.
LEGAL = "ltd|limited|sti|sirketi|anonim|as"
#: A short form of a given name has at most so many letters.
LONGEST_SHORT_FORM = 6


def name_tokens(x: Column) -> Column:
    """Folded words of a name as typed; hyphens join, titles go."""
    y = F.replace(fold(F.coalesce(x, F.lit(""))), F.lit("-"), F.lit(""))
    return F.filter(F.regexp_extract_all(y, F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(*TITLES))


def typed_names(people: DataFrame) -> DataFrame:
    """(name_no, first, last, n) written: each way a name is typed once, null being empty, with a number and how many rows have it."""
    t = people.groupBy(F.coalesce("first", F.lit("")).alias("first"), F.coalesce("last", F.lit("")).alias("last")).agg(F.count("*").alias("n"))
    return cut(t.withColumn("name_no", F.monotonically_increasing_id()))


def token_rows(names: DataFrame) -> DataFrame:
    """typed_names() to (name_no, n, pos, token, is_first); placeholders have no tokens."""
    tokens = lambda c: F.when(F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.array().cast("array<string>")).otherwise(name_tokens(F.col(c)))
    t = names.select("name_no", "n", tokens("first").alias("f"), tokens("last").alias("l"))
    t = t.select("name_no", "n", F.size("f").alias("firsts"), F.posexplode(F.concat("f", "l")).alias("pos", "token"))
    return t.select("name_no", "n", "pos", "token", (F.col("pos") < F.col("firsts")).cast("int").alias("is_first"))


def name_vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, fixed, n, given): each spelling with the one it is a slip of, that one's count and share among first names."""
    counts = cut(tokens.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_first")).alias("n_first")))
    fixes = corrections(counts.select("token", "n"), dominance=2)
    main = counts.select(F.col("token").alias("fixed"), F.col("n"), (F.col("n_first") / F.col("n")).alias("given"))
    return counts.select("token").join(fixes.select("token", "fixed"), "token", "left").withColumn("fixed", F.coalesce("fixed", "token")).join(main, "fixed")


def name_parts(people: DataFrame, everyone: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(first, last, any others) to (the others, surname, givens): a row for each row with at least ``least`` tokens, in whatever order
    they were typed.

    Names are taken apart once for each way they are typed, not for each row. Tokens are corrected against all tokens of ``everyone``
    (people, if not given). The surname is the token that, as corrected, is least often a first name; givens holds the other tokens
    in order, initials included. A single token that is mostly a first name stands in givens, and surname is empty.
    """
    mine = typed_names(people)
    v = name_vocabulary(token_rows(mine if everyone is None else typed_names(everyone)))
    # the least entry of a name is its surname: no initial, least often a first name, then the rarest, then the last one
    v = v.select("token", (F.length("fixed") < 2).alias("short"), F.round("given", 1).alias("share"), F.col("n").alias("often"), F.col("given") > 0.5, "fixed").toDF("token", "short", "share", "often", "mostly_given", "fixed")
    entry = F.struct("short", "share", "often", (-F.col("pos")).alias("place"), "fixed", "mostly_given")
    g = token_rows(mine).join(lookup(v), "token").groupBy("name_no").agg(F.collect_list(entry).alias("ts")).where(F.size("ts") >= least)
    g = g.withColumn("s", F.array_min("ts")).withColumn("alone", (F.size("ts") == 1) & F.col("s.mostly_given"))
    givens = F.transform(F.filter("ts", lambda x: F.col("alone") | (x["place"] != F.col("s.place"))), lambda x: x["fixed"])
    parts = g.select("name_no", F.when(F.col("alone"), "").otherwise(F.col("s.fixed")).alias("surname"), F.array_sort(givens).alias("givens")).where((F.length("surname") > 1) | (F.col("surname") == ""))
    parts = mine.join(parts, "name_no").select("first", "last", "surname", "givens")
    rows = people.withColumns({c: F.coalesce(c, F.lit("")) for c in ("first", "last")})
    return rows.join(lookup(parts), ["last", "first"]).drop("first", "last")


def short_form(long: str, short: str) -> bool:
    """Zeko for Zekeriya: begins alike and ends in a vowel or in s, as pet names do."""
    if not 3 <= len(short) <= LONGEST_SHORT_FORM or len(long) <= 3 or long[0] != short[0]:
        return False
    return len(short) <= 4 and short.endswith("o") or long[1] == short[1] and short.endswith(("o", "os", "is", "us", "as", "i", "ik"))


def same_given(a: str, b: str, nick: frozenset[tuple[str, str]]) -> float:
    """How well two tokens agree: 1 equal, less for slips, pet names, cut-off names and initials, 0 for none."""
    if a == b:
        return 1.0
    a, b = sorted((a, b), key=lambda x: (len(x), x))
    if len(a) == 1:
        return 0.6 if b[0] == a else 0.0
    if (b, a) in nick:
        return 0.9
    if len(a) >= 3 and b.startswith(a):
        return 0.8
    if osa(a, b, 1) <= 1 and len(a) >= 3 or osa(a, b, 2) <= min(2, reach(len(a))):
        return 0.9
    return 0.7 if short_form(b, a) else 0.0


#: Agreement of given names of which one is missing.
UNKNOWN = 0.3


def assignment(score: list[list[float]]) -> list[int]:
    """For each row the column that an assignment of highest total gives it (rows at most as many as columns), by shortest augmenting paths."""
    n, m = len(score), len(score[0]) if score else 0
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        best, back, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            done[at] = True
            row, step, to = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -score[row - 1][j - 1] - u[row] - v[j]
                    if cost < best[j]:
                        best[j], back[j] = cost, at
                    if best[j] < step:
                        step, to = best[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    best[j] -= step
            at = to
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def align(a: tuple[str, ...], b: tuple[str, ...], nick: frozenset[tuple[str, str]]) -> float:
    """Optimal assignment of the shorter list's tokens to the longer one's: the mean agreement, 0 if one token finds no partner."""
    a, b = sorted((a, b), key=len)
    if not a:
        return UNKNOWN
    score = [[same_given(x, y, nick) for y in b] for x in a]
    if len(a) == 1:
        return max(score[0])
    # a token without a partner costs more than all others can gain
    got = [s[j] for s, j in zip(score, assignment([[x or -float(len(a)) for x in s] for s in score]))]
    return sum(got) / len(got) if all(got) else 0.0


def align_udf(forms: list[tuple[str, str]]):
    """Column function (givens, givens) -> agreement; forms: (given name, short form)."""
    nick = frozenset((fold_py(a), fold_py(b)) for a, b in forms)

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = lru_cache(500_000)(lambda x, y: align(x, y, nick))
        for a, b in parts:
            yield pd.Series([score(tuple(x), tuple(y)) for x, y in zip(a, b)], dtype="float64")

    return run


def short_forms(given_name_forms: DataFrame, most: int = 100_000) -> list[tuple[str, str]]:
    rows = given_name_forms.select("given_name", "short_form").where("given_name IS NOT NULL AND short_form IS NOT NULL").distinct().take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} short forms")
    return sorted((r[0], r[1]) for r in rows)


def same_person_names(people: DataFrame, given_name_forms: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """(id, first, last), each id once, to pairs (a, b), a < b, of ids whose names mean one person.

    Spellings collapse into classes first; classes meet under the corrected surname and an initial, never as records. Two classes
    agree if the optimal assignment of their given names leaves none of the shorter name without a partner. A class of initials
    that agrees with classes of different names takes part in no pair but with its own like.
    """
    parts = cut(name_parts(people, everyone))
    roots = same_core(parts.select(F.col("surname").alias("core")).distinct()).withColumnRenamed("core", "surname")
    parts = cut(parts.join(lookup(roots), "surname").select("id", F.col("root").alias("surname"), "givens"))
    c = cut(parts.select("surname", "givens").distinct().withColumn("cls", F.monotonically_increasing_id()))
    letters = c.withColumn("letter", F.explode(F.array_distinct(F.transform("givens", lambda x: F.substring(x, 1, 1)))))
    a = letters.select("surname", "letter", F.col("cls").alias("ca"), F.col("givens").alias("ga"))
    b = letters.select("surname", "letter", F.col("cls").alias("cb"), F.col("givens").alias("gb"))
    near = a.join(b, ["surname", "letter"]).where("ca < cb").select("ca", "cb", "ga", "gb").distinct()
    near = cut(near.withColumn("s", align_udf(short_forms(given_name_forms))("ga", "gb")).where("s > 0").select("ca", "cb", "ga", "gb"))
    both = near.unionByName(near.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), F.col("gb").alias("ga"), F.col("ga").alias("gb")))
    # partners of a class of initials that share no full token with one another: the initials say nothing
    initials = lambda g: F.forall(g, lambda x: F.length(x) == 1)
    x = both.where(initials("ga") & ~initials("gb")).select("ca", F.col("cb").alias("p"))
    clash = x.join(x.withColumnRenamed("p", "q"), "ca").where("p < q").join(both.select(F.col("ca").alias("p"), F.col("cb").alias("q")), ["p", "q"], "left_anti")
    doubtful = cut(clash.select("ca").distinct())
    good = near.select("ca", "cb").join(doubtful, "ca", "left_anti").join(doubtful.withColumnRenamed("ca", "cb"), "cb", "left_anti")
    good = cut(good.unionByName(c.select(F.col("cls").alias("ca"), F.col("cls").alias("cb"))))
    return pairs_of_links(good, cut(parts.join(c, ["surname", "givens"]).select("id", "cls")))


def pairs_of_links(links: DataFrame, member: DataFrame) -> DataFrame:
    """Class links (ca, cb) and membership (id, cls) to distinct id pairs a < b."""
    p = links.join(member.select(F.col("id").alias("x"), F.col("cls").alias("ca")), "ca").join(member.select(F.col("id").alias("y"), F.col("cls").alias("cb")), "cb")
    return p.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def word_orders(words: Column) -> Column:
    """The words joined in other orders: every order of up to three words, beyond that those that turn or reverse the whole."""
    turned = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.concat(F.array_join(F.slice(w, i, F.size(w)), ""), F.array_join(F.slice(w, F.lit(1), i - 1), "")))
    return F.array_distinct(F.concat(turned(words), turned(F.reverse(words))))


def company_text(company: Column) -> Column:
    """Words of a company's name, folded, without what stands in brackets and without legal forms."""
    y = F.trim(F.regexp_replace(F.regexp_replace(fold(company), r"\([^)]*\)?", " "), "[^a-z0-9]+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(y, r"\bve dis tic(aret)?\b", " "), rf"\b(?:{LEGAL})\b|\ba s\b", " "))
    return F.when(~y.isin(*PLACEHOLDERS) & (F.length(y) > 2), bare)


#: A word is a line of business if so large a share of all names of several words end in it, at least so many, and it mostly stands there.
LINE_SHARE = 0.005
LINE_COUNT = 20


def business_lines(companies: DataFrame) -> list[str]:
    """Words that many companies' names end in, beside SECTORS. Each takes LINE_SHARE of the names, so there are at most 1 / LINE_SHARE."""
    t = companies.select(F.filter(F.split(company_text(F.col("company")), " +"), lambda w: w != "").alias("ws")).where("size(ws) > 1")
    w = t.select(F.posexplode("ws").alias("pos", "w"), F.size("ws").alias("n")).groupBy("w").agg(F.count("*").alias("all"), F.count_if(F.col("pos") == F.col("n") - 1).alias("last"))
    total = t.agg(F.count("*").alias("total"))
    found = w.crossJoin(F.broadcast(total)).where((F.length("w") > 3) & (F.col("last") >= LINE_COUNT) & (F.col("last") >= LINE_SHARE * F.col("total")) & (2 * F.col("last") > F.col("all")))  # total is one row
    return sorted({r.w for r in found.select("w").collect()} | set(SECTORS))


def company_parts(companies: DataFrame, lines: Sequence[str] = SECTORS) -> DataFrame:
    """(id, company) to (id, core, sector, orders): the words that are neither legal form nor line of business, joined as typed and in
    other orders; sector null if none."""
    y = F.col("y")
    t = companies.where(present(F.col("company"))).withColumn("y", company_text(F.col("company"))).where("y IS NOT NULL")
    sectors, short = F.array(*map(F.lit, lines)), F.create_map(*[F.lit(x) for kv in SECTOR_SHORT.items() for x in kv])
    slip = lambda s, w: (F.length(w) > 4) & (F.levenshtein(s, w) <= F.when(F.length(w) < 7, 1).otherwise(2))
    near = lambda w: F.transform(F.filter(sectors, lambda s: s.startswith(w) | slip(s, w)), lambda s: F.struct(F.when(s.startswith(w), 0).otherwise(F.levenshtein(s, w)).alias("edits"), s.alias("s")))
    known = lambda w: F.array_min(near(w))["s"]
    sector_of = lambda w: F.coalesce(F.try_element_at(short, w), F.when(F.length(w) >= 3, known(w)))
    t = t.withColumn("ws", F.transform(F.filter(F.split(y, " +"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), sector_of(w).alias("s"))))
    first = F.get(F.filter("ws", lambda x: x["s"].isNotNull()), F.lit(0))
    t = t.withColumn("sector", first["s"]).withColumn("ws", F.transform(F.filter("ws", lambda x: x["s"].isNull()), lambda x: x["w"])).withColumn("core", F.array_join("ws", ""))
    return t.where(F.length("core") > 2).select("id", "core", "sector", word_orders(F.col("ws")).alias("orders"))


def same_core(cores: DataFrame) -> DataFrame:
    """(core) distinct to (core, root): spellings that a chain of single slips connects get one root, however long the chain."""
    s = cut(cores.withColumn("node", F.monotonically_increasing_id()))
    forms = s.select("node", "core", F.explode(delete_forms(F.col("core"))).alias("form")).where(F.length("form") > 3)
    met = forms.join(forms.select(F.col("node").alias("y"), F.col("core").alias("other"), "form"), "form").where("node < y").select(F.col("node").alias("x"), "y", "core", "other").distinct()
    links = met.where(edit_count("core", "other") < 2).select("x", "y")
    names = s.select(F.col("node").alias("root"), F.col("core").alias("name"))
    roots = components(s.select("node"), links)
    return s.join(roots, "node").join(names, "root").select("core", F.col("name").alias("root"))


#: Links up to which components() follows them in one task; more of them are followed step by step over tables.
FEW_LINKS = 1_000_000


def components(nodes: DataFrame, links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node) and links (x, y) to (node, root): what links connect gets one root, its least node, however long the chains are."""
    links = cut(links.select("x", "y"))
    if links.count() <= few:
        roots = links.coalesce(1).mapInArrow(joined, "node long, root long")
        return cut(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    both = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    roots = nodes.select("node", F.col("node").alias("root"))
    moved = True
    while moved:
        least = both.join(roots.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("r")).withColumnRenamed("x", "node")
        roots = cut(roots.join(least, "node", "left").select("node", F.least("root", "r").alias("root"), (F.col("r") < F.col("root")).alias("moved")))
        moved = not roots.where("moved").isEmpty()
        roots = roots.select("node", "root")
    return roots


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of all links (x, y) to (node, root) of the nodes that they name."""
    parts = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root, old = np.arange(len(nodes)), None
    while old is None or (root != old).any():
        old, low = root, np.minimum(root[x], root[y])
        root = old.copy()
        np.minimum.at(root, old[x], low)
        np.minimum.at(root, old[y], low)
        while (root != (further := root[root])).any():
            root = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def same_organisations(spellings: DataFrame) -> DataFrame:
    """(core, sector) distinct, with or without orders, to (core, sector, root): the spellings of one organisation get one root.

    Cores, in any of the orders of one of both, meet under a form less as many characters as reach() allows edits, are verified by
    their edit distance, and link within one line of business. Spellings without one link among themselves; together they belong to
    the organisation nearest to them, if there is only one at that distance.
    """
    orders = F.array_union(F.array("core"), "orders") if "orders" in spellings.columns else F.array("core")
    s = cut(spellings.select("core", "sector", orders.alias("orders"), F.monotonically_increasing_id().alias("node")))
    form = lambda t: t.withColumn("form", F.explode(reach_forms(F.col("word")))).where((F.length("form") > 3) | (F.col("form") == F.col("word"))).withColumn("form", F.xxhash64("form"))
    a = form(s.select("node", "core", F.explode("orders").alias("word"), "sector")).select("form", F.col("node").alias("x"), "core", F.col("word").alias("word_x"), F.col("sector").alias("sector_x"))
    b = form(s.select("node", F.col("core").alias("word"), "sector")).select("form", F.col("node").alias("y"), F.col("word").alias("word_y"), F.col("sector").alias("sector_y"))
    met = a.join(b, "form").where("coalesce(sector_x = sector_y, true) AND (x < y OR x <> y AND word_x <> core)").drop("form", "core").distinct()
    met = met.withColumn("n", edit_count("word_x", "word_y")).where("n < 3")
    swap, bare = F.expr("sector_x IS NOT NULL AND sector_y IS NULL"), F.expr("(sector_x IS NULL) <> (sector_y IS NULL)")
    met = cut(met.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), "n", bare.alias("bare")))
    roots = components(s.select("node"), met.where("NOT bare"))
    x, y = roots.select(F.col("node").alias("x"), "root"), roots.select(F.col("node").alias("y"), F.col("root").alias("home"))
    at = met.where("bare").join(x, "x").join(y, "y").groupBy("root", "home").agg(F.min("n").alias("n"))
    nearest = at.groupBy("root").agg(F.min("n").alias("n")).join(at, ["root", "n"]).groupBy("root").agg(F.min("home").alias("home"), F.max("home").alias("other"))
    roots = roots.join(nearest.where("home = other").select("root", "home"), "root", "left").select("node", F.coalesce("home", "root").alias("root"))
    return s.join(roots, "node").select("core", "sector", "root")


def same_company_names(companies: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """(id, company) to pairs (a, b), a < b, of ids whose companies are one organisation.

    An organisation is its core name, whatever slips, order (see word_orders), spacing or legal form, within one line of business.
    Lines of business are those of SECTORS and those that the names of ``everyone`` show. A value without one belongs to the
    organisation of that core if there is only one. Initials of words find no partner.
    """
    p = cut(company_parts(companies, business_lines(companies if everyone is None else everyone)).dropDuplicates(["id"]))
    roots = same_organisations(p.groupBy("core", "sector").agg(F.array_distinct(F.flatten(F.collect_set("orders"))).alias("orders"))).select(F.col("core").alias("c"), F.col("sector").alias("s"), F.col("root").alias("cls"))
    p = cut(p.join(roots, (F.col("core") == F.col("c")) & F.col("sector").eqNullSafe(F.col("s"))).select("id", "cls"))
    return pairs_of_links(p.select(F.col("cls").alias("ca"), F.col("cls").alias("cb")).distinct(), p)


def variant_names(records: DataFrame, events: DataFrame, given_name_forms: DataFrame, id_col: str = "source_record_id") -> DataFrame:
    """(name_kind, source_record_id_a, source_record_id_b) among the records whose name (person) or company was typed in a variant.

    Records take part if an event names them on first_name or last_name (person) or on company; names are read from the records.
    Null or placeholder names give nothing, repeated ids and events count once, extra columns are ignored, and without events or
    records the result is empty.
    """
    e = events.where(F.col("field_name").isin("first_name", "last_name", "company") & F.col(id_col).isNotNull())
    e = e.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("field_name") != "company").alias("person"), F.max(F.col("field_name") == "company").alias("org"))
    r = records.select(F.col(id_col).cast("string").alias("id"), F.col("first_name").alias("first"), F.col("last_name").alias("last"), "company")
    r = cut(r.join(e, "id").dropDuplicates(["id"]))
    all_names = records.select(F.col(id_col).alias("id"), F.col("first_name").alias("first"), F.col("last_name").alias("last"))
    person = same_person_names(r.where("person").select("id", "first", "last"), given_name_forms, all_names)
    org = same_company_names(r.where("org").select("id", "company"), records.select("company"))
    out = person.withColumn("name_kind", F.lit("person")).unionByName(org.withColumn("name_kind", F.lit("company")))
    return out.select("name_kind", F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
