import datetime
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from cleanloom.functions.session import cut
from cleanloom.functions.text import fold_py
from cleanloom.llm import linkage, mixing, names, packing, places, splitting, survivors, tokens
from cleanloom.llm.addresses import address_parts, building_classes, same_buildings
from cleanloom.llm.strings import DeleteIndex, osa

REF = "place_id int, kind string, canonical_name string, parent_place_id int"
REC = "source_record_id string, source_name string, first_name string, last_name string, email string, phone string, company string, city string, district string, address string, updated_at timestamp, ingested_at timestamp"


@pytest.fixture(scope="module")
def ref(spark):
    rows = [(1, "city", "Yusedötepe", None), (2, "city", "Zilöpa", None), (11, "district", "Metinadere", 1), (12, "district", "Metinadere", 2), (13, "district", "Kicile", 1)]
    return spark.createDataFrame(rows, REF), spark.createDataFrame([("Bemuhisar", 1)], "alias string, place_id int")


def rec(spark, rows):
    base = dict.fromkeys(f.split()[0] for f in REC.split(", "))
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], REC)


def test_osa_against_brute_force():
    def brute(a, b):
        if not a or not b:
            return len(a) + len(b)
        out = min(brute(a[1:], b) + 1, brute(a, b[1:]) + 1, brute(a[1:], b[1:]) + (a[0] != b[0]))
        return min(out, brute(a[2:], b[2:]) + 1) if len(a) > 1 and len(b) > 1 and a[:2] == b[1::-1] else out

    rng = random.Random(1)
    ws = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(40)]
    assert all(osa(a, b, 9) == brute(a, b) for a, b in itertools.combinations(ws, 2))
    ix = DeleteIndex(["zuzenemtepe", "kicile"])
    assert ix.near("zuznemtepe") == [(1, "zuzenemtepe")] and ix.near("kiiclle") == [] or ix.near("kicle")


def test_places(ref):
    m = {k: places.PlaceMatcher(v) for k, v in places.reference_entries(*ref).items()}
    c = m["city"].resolve
    assert [c(x) for x in ("YUSEDOTEPE", "bemuhisar ili", "Yusdeotepe", "Yus.", "Zilöpa / Kicile", "Tokat", "yok", "", None, " ")] == [1, 1, 1, 1, 2, 0, 0, 0, 0, 0]
    assert m["district"].resolve("metinadere", [2]) == 12 and m["district"].resolve("metinadere") == 11


def test_map_places(spark, ref):
    r = rec(spark, [{"source_record_id": "a", "city": "ZILOPA", "district": "Metinadere."}] * 2 + [{"source_record_id": "b", "city": "Zilöpa", "district": " "}, {"source_record_id": "c"}]).withColumn("place_id", F.lit(9))
    assert {tuple(x) for x in places.map_places(r, *ref).collect()} == {("a", "city", 2), ("a", "district", 12)}
    assert places.map_places(r.limit(0), *ref).count() == 0


def test_address_parts():
    places = frozenset({"kicile", "yusedotepe", "yeni sehir"})
    of = lambda a: address_parts(fold_py(a), places)
    assert of("K.8 Daire 4, Fetuluk Mahalle, Nanofodüt Cad., NO:299/B, 64186") == ("299b", "nanofodut", "fetuluk", "", "", "64186")
    assert of("Pehezan Mahalle Yivüdüdam #40 Kicile/Yusedötepe") == ("40", None, "pehezan", "", "yivududam", None)
    assert of("Yivüdüdam Ak Köşk Apt 7 Yeni Şehir") == ("7", None, None, "kosk", "yivududam +ak", None)
    assert of("Nanofodüt Cad. No: 123456") == ("123456", "nanofodut", None, "", "", None)
    assert of("Nanofodüt Cad. No: 12345")[0] == "12345" and of("No7 D3 Nanofodüt Sk")[0] == "7" and of("") is None and of("x" * 100_000) is None and of("64186 Kicile") is None


def test_number_of_any_length(spark, ref):
    r = rec(spark, [{"source_record_id": i, "address": a, "city": "Zilöpa"} for i, a in [("a", "Nanofodüt Cad. No:123456"), ("b", "nanofodut cd no 123456"), ("c", "Nanofodüt Cad. No:12345")]])
    assert {tuple(x) for x in same_buildings(r, *ref).collect()} == {("a", "b")}


def test_rarity_and_slips_decide_buildings(spark, ref):
    town = [{"source_record_id": f"t{k:03}", "address": f"Sokak{chr(97 + k % 20)}{chr(97 + k // 20)} Sk. No:{k} Kervan Apt.", "city": "Zilöpa"} for k in range(120)]
    rows = [
        ("a", "Tuzlama Mah. Nanofodüt Cad. No:7 Kervan Apt.", "Yusedötepe"),
        ("b", "Tuzlama Mah. Nanofodüt Cad. No:7", None),  # the quarter is rare: its weight suffices
        ("c", "Tuzlma Mah. Nanofodüt Cad. No:7", None),  # the quarter is a slip
        ("d", "Nanofodüt Cad. No:7 Kervan Apt.", None),  # the house stands everywhere: too little
        ("e", "Başka Mah. Nanofodüt Cad. No:7 Kervan Apt.", None),
    ]
    r = rec(spark, town + [{"source_record_id": i, "address": a, "city": c} for i, a, c in rows])
    got = {tuple(x) for x in same_buildings(r, *ref).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


def test_a_street_with_two_slips_meets_by_its_quarter(spark, ref):
    rows = [{"source_record_id": f"m{k}", "address": f"Tuzlama Mah. Nanofodütme Cad. No:{k}", "city": "Zilöpa"} for k in range(7, 12)]
    r = rec(spark, [*rows, {"source_record_id": "x", "address": "Tuzlama Mah. Nonofodütne Cad. No:7", "city": "Zilöpa"}, {"source_record_id": "y", "address": "Tuzlama Mah. Kalabora Cad. No:7", "city": "Zilöpa"}])
    assert {tuple(x) for x in same_buildings(r, *ref).collect()} == {("m7", "x")}
    c = {x.source_record_id: x for x in building_classes(r, *ref).collect()}
    assert c["x"].building == c["m7"].building and c["x"].records == 2 and c["y"].records == 1


def test_buildings(spark, ref):
    rows = [("a", "Nanofodüt Cad. No:7 D:3", "Yusedötepe"), ("b", "nanofodut cd 7", "bemuhisar"), ("c", "Nanofodüt Cad. No:7/B", "Yusedötepe"), ("d", "Nanofodüt Cad. No:7", "Zilöpa"), ("e", "yok", "Zilöpa"), ("f", None, None), ("b", "nanofodut cd 7", "bemuhisar")]
    r = rec(spark, [{"source_record_id": i, "address": a, "city": c} for i, a, c in rows])
    assert {tuple(x) for x in same_buildings(r, *ref).collect()} == {("a", "b")}
    assert same_buildings(r.limit(0), *ref).count() == 0


def test_branch_and_bound_against_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        opts = [[(rng.random() * 4**k, rng.choice([None, "x", "y"])) for _ in range(rng.randint(0, 3))] for k in range(4)]
        ties = [(0, 1), (1, 3)]
        best = 0.0
        for pick in itertools.product(*[[None, *range(len(o))] for o in opts]):
            ok = all(pick[a] is None or pick[b] is None or None in (opts[a][pick[a]][1], opts[b][pick[b]][1]) or opts[a][pick[a]][1] == opts[b][pick[b]][1] for a, b in ties)
            if ok:
                best = max(best, sum(opts[k][i][0] for k, i in enumerate(pick) if i is not None))
        got = survivors.branch_and_bound(opts, ties)
        assert abs(sum(opts[k][i][0] for k, i in enumerate(got) if i is not None) - best) < 1e-9


def test_dependencies_of_survivors(spark, ref):
    g = spark.createDataFrame([("P", ["r1", "r2", "r3"]), ("Q", ["r4", "r5"]), ("R", None)], "person_id string, source_record_ids array<string>")
    at = [datetime.datetime(2024, 1, d) for d in range(1, 6)]
    home = "Nanofodüt Cad. No:7"
    r = rec(spark, [
        {"source_record_id": "r1", "city": "Zilöpa", "address": home, "updated_at": at[2]},
        {"source_record_id": "r2", "city": "Yusedötepe", "district": "Kicile", "updated_at": at[3]},
        {"source_record_id": "r3", "city": "Zilöpa", "district": "Metinadere", "updated_at": at[1]},
        {"source_record_id": "r4", "district": "Kicile", "address": home, "updated_at": at[2]},  # in Yusedötepe by its district
        {"source_record_id": "r5", "city": "Zilöpa", "district": "Kicile", "address": home, "updated_at": at[1]},  # contradicts itself
    ])
    reg = spark.createDataFrame([("crm", 1)], "source_name string, trust_rank int")
    got = {x.person_id: x for x in survivors.survivors(g, r, reg, ref[0]).collect()}
    assert (got["P"].address_record_id, got["P"].city, got["P"].city_record_id) == ("r1", "Zilöpa", "r1")
    assert got["Q"].address_record_id == "r4" and got["Q"].city is None and got["R"].address is None
    rows = [
        {"city_key": "a", "address": {"trust": {"at": 9, "rank": 0}, "id": "1", "address": "x", "city": None, "district": None}, "place": None},
        {"city_key": "b", "address": None, "place": {"trust": {"at": 8, "rank": 0}, "id": "2", "city": "B", "district": None}},
        {"city_key": "a", "address": None, "place": {"trust": {"at": 1, "rank": 0}, "id": "3", "city": "A", "district": "D"}},
    ]
    best = survivors.survivor([r | dict.fromkeys(("email", "phone", "company", "name")) for r in rows])
    assert (best["city"], best["city_record_id"], best["district"]) == ("A", "3", "D")  # the later place alone would be B


def test_names():
    nick = frozenset({("mustafa", "mistik")})
    ok = [(("k", "s"), ("kadriye", "serife")), (("mistik",), ("mustafa",)), (("zeko",), ("zekeriya",)), (("haliem",), ("halime",)), (("ilker",), ("bulent", "ilker"))]
    assert all(names.align(a, b, nick) > 0 for a, b in ok)
    # the best partner of one token may be needed by another, with any number of tokens
    assert names.align(("ali", "ali"), ("ali", "a", "x", "y", "z", "q", "w"), nick) == pytest.approx(0.8) and names.align(("ali", "ali"), ("ali", "b", "c", "d", "e", "f"), nick) == 0
    assert names.align(("filiz",), ("figen",), nick) == 0 and names.align(("c", "b"), ("ali",), nick) == 0


def test_assignment_against_all_orders():
    rng = random.Random(4)
    for _ in range(200):
        n, m = (k := sorted(rng.randint(1, 6) for _ in range(2)))[0], k[1]
        score = [[rng.choice([-3.0, 0.6, 0.8, 0.9, 1.0]) for _ in range(m)] for _ in range(n)]
        at = names.assignment(score)
        assert len(set(at)) == n and abs(sum(s[j] for s, j in zip(score, at)) - max(sum(s[j] for s, j in zip(score, o)) for o in itertools.permutations(range(m), n))) < 1e-9


def test_variant_names(spark):
    r = rec(spark, [{"source_record_id": i, "first_name": f, "last_name": l, "company": c} for i, f, l, c in [("a", "Kadriye", "Zezudurar", "Zayun Sefiro Mad. Ltd."), ("b", "ZEZUDURAR", "K.", "Madencilik ZayunSefiro"), ("c", "Ali", "Zezudurar", "Zayun Sefiro Gıda A.Ş."), ("d", None, None, "x")]])
    e = spark.createDataFrame([(i, f) for i in "abcd" for f in ("last_name", "company")] * 2, "source_record_id string, field_name string")
    f = spark.createDataFrame([], "given_name string, short_form string")
    assert {tuple(x) for x in names.variant_names(r, e, f).collect()} == {("person", "a", "b"), ("company", "a", "b")}


def test_companies_mistyped_in_two_places(spark):
    rows = [("a", "Huyom Virigf Plastik"), ("b", "Huyom Viriggi Plastik"), ("c", "Pezilhumafoo"), ("d", "Pezilhuzafo Matbaacılık"), ("e", "Huyom Virigf Gıda")]
    rows += [("f", "Bekado Tarım"), ("g", "Bekuda Tarım"), ("h", "Zovilupane"), ("i", "Zovilupane Kimya"), ("j", "Zovilupame Seramik"), (None, None), ("k", "yok"), ("k", "yok")]
    got = {tuple(x) for x in names.same_company_names(spark.createDataFrame(rows, "id string, company string")).collect()}
    assert got == {("a", "b"), ("c", "d"), ("h", "i")}  # e: another line of business; f, g: two edits in six letters


def test_lines_of_business_are_learned(spark):
    rows = [(f"m{k}", f"Firma{chr(97 + k)}an Magazacılık Ltd.") for k in range(24)] + [("x", "Yoğim Nutule Magazacılık"), ("y", "Yogim Nutule A.Ş."), ("z", "Yoğim Nutule Mabaacılık"), (None, None), ("n", "yok")]
    df = spark.createDataFrame(rows, "id string, company string")
    assert set(names.business_lines(df)) - set(names.SECTORS) == {"magazacilik"} and names.business_lines(df.limit(0)) == sorted(names.SECTORS)
    # a slip goes to the nearest line, and the name without a line has two to choose from
    got = {r.id: r.sector for r in names.company_parts(df, names.business_lines(df)).collect()}
    assert (got["x"], got["y"], got["z"]) == ("magazacilik", None, "matbaacilik")


def test_a_chain_of_slips_is_one_organisation(spark):
    cores = ["zovilupanekatu", "zovilupanekaxx", "zovilupanezzxx", "zoviluqqnezzxx", "zowwluqqnezzxx", "vvwwluqqnezzxx"]
    got = names.same_organisations(spark.createDataFrame([(c, "gida") for c in cores], "core string, sector string")).collect()
    assert len(got) == 6 and len({r.root for r in got}) == 1


@pytest.mark.parametrize("few", [0, names.FEW_LINKS])
def test_components_by_either_way(spark, few):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(2**40, 2**50)]
    root = {n: n for n in [*range(201), 2**40, 2**50, 7000]}
    while any(root[x] != root[y] for x, y in links):
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    nodes = spark.createDataFrame([(n,) for n in root], "node long")
    got = names.components(nodes, spark.createDataFrame(links, "x long, y long").repartition(3), few)
    assert {r.node: r.root for r in got.collect()} == root
    assert {r.node: r.root for r in names.components(nodes, spark.createDataFrame([], "x long, y long"), few).collect()} == {n: n for n in root}


def test_a_long_chain_takes_no_more_jobs(spark):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        nodes, links = spark.range(n).toDF("node"), spark.range(n - 1).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
        assert names.components(nodes, links).where("root = 0").count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}"))

    assert jobs(12) == jobs(3)


def test_companies_in_any_order_of_words(spark):
    rows = [("a", "Nutule Yoğim Gıda"), ("b", "Yoğim Nutule Gıda Ltd."), ("c", "YogimNutuel"), ("d", "Yoğim Nutule Kimya"), ("e", "Zofu Kadige Lomura Turizm"), ("f", "Lomura Kadgie Zofu Turizm")]
    got = {tuple(x) for x in names.same_company_names(spark.createDataFrame(rows[:2] + rows[3:], "id string, company string")).collect()}
    assert got == {("a", "b"), ("e", "f")}
    got = {tuple(x) for x in names.same_company_names(spark.createDataFrame(rows[:3], "id string, company string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


P7 = {"id": "id", "first": "first", "last": "last", "email": "email", "phone": "phone", "city": "city", "district": "district", "address": "address"}


def test_coupling_decides_matches(spark, ref):
    schema = ", ".join(f"{c} string" for c in P7)
    home = "Nanofodüt Cad. No:7"
    a = [("a1", "Kadriye", "Zezudurar", "kad1@x.test", "0599 111 22 33", "Zilöpa", None, None), ("a2", "Kadriye", "Zezudurar", None, "0599 111 22 33", None, None, None)]  # a2 is known only through a1
    a += [("a3", "Ayşegül", "Topavar", None, None, "Zilöpa", None, home), ("a4", "Ali", "Topavar", None, "0599 777 88 99", "Zilöpa", None, home)]  # two people of one initial in one home
    a += [("a5", "Veli", "Kuzubar", "vel9@old.test", "0599 444 55 66", None, None, None)]
    b = [("b1", "Kadriye", "Zezudurar", "kad1@x.test", None, None, None, None), ("b3", "A.", "Topavar", None, "0599 777 88 99", "Zilöpa", None, home), ("b5", "Veli", "Kuzubar", "vel9@new.test", None, None, None, None)]
    s, p, forms = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), spark.createDataFrame([], "given_name string, short_form string")
    got = {(r.source_record_id_a, r.source_record_id_b) for r in linkage.match_people(s, p, *ref, forms, (P7, P7)).collect()}
    assert got == {("a1", "b1"), ("a2", "b1"), ("a4", "b3"), ("a5", "b5")}
    most = linkage.WEIGHTS.copy()
    try:
        linkage.WEIGHTS.update(exclusive=1e-9, transitive=1e-9)
        alone = {(r.source_record_id_a, r.source_record_id_b) for r in linkage.match_people(s, p, *ref, forms, (P7, P7)).collect()}
    finally:
        linkage.WEIGHTS.update(most)
    assert alone == {("a1", "b1"), ("a5", "b5"), ("a3", "b3"), ("a4", "b3")}  # without coupling: one link lost, one false


def test_every_address_is_read_once(spark, ref, monkeypatch):
    plans, real = [], linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    t = spark.createDataFrame([("a1", "Ayşegül", "Topavar", None, None, "Zilöpa", None, "Nanofodüt Cad. No:7")], ", ".join(f"{c} string" for c in P7))
    c, member = linkage.signatures(linkage.people_rows(t, P7, "a").unionByName(linkage.people_rows(t, P7, "b")), *ref)
    assert plans[0].count("ArrowEvalPython") == 2  # once in each table
    assert {(r.side, r.house, r.city_id) for r in c.collect()} == {("a", "nanofodut 7", 2), ("b", "nanofodut 7", 2)} and member.count() == 2


def test_what_the_classes_are_made_of_is_deleted(spark, ref, monkeypatch):
    made = []
    monkeypatch.setattr(linkage, "cut", lambda df: made.append(x := cut(df)) or x)
    person = {"first_name": "Zuhal", "last_name": "Kodemir", "email": "zk@zz.example", "address": "Mukete Cd. No:52"}
    people = linkage.people_rows(rec(spark, [person | {"source_record_id": "a"}]), linkage.SOURCE, "a")
    people = people.unionByName(people.withColumn("side", F.lit("b")))
    classes, member = linkage.signatures(people, *ref)
    assert member.count() == 2
    left = [x for x in made if os.path.exists(x.inputFiles()[0].removeprefix("file://").removeprefix("file:"))]
    assert len(made) == 4 and left == made[-1:]


def test_alternating_directions_reach_the_optimum(spark):
    v = spark.createDataFrame([(1, 3.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 1.0)], "var long, t double, z double")
    r = spark.createDataFrame([(1, 2, "same", 1.0), (1, 3, "other", 0.0)], "i long, j long, kind string, p double")
    got = {x.var: x.y for x in linkage.solve(v, r, 40, 4.0).collect()}
    w = linkage.WEIGHTS

    def loss(a, b, c):
        return 3 * (1 - a) ** 2 + a * a + b * b + 2 * (1 - c) ** 2 + c * c + w["transitive"] * (a - b) ** 2 + w["exclusive"] * max(0, a + c - 1) ** 2

    steps = [k / 40 for k in range(41)]
    assert loss(got[1], got[2], got[3]) <= min(loss(*x) for x in itertools.product(steps, repeat=3)) + 1e-3


def slopes(values, rules, y):
    """Largest slope of the loss along which a value may still move."""
    w, g = linkage.WEIGHTS, {k: 2 * (t + z) * y[k] - 2 * t for k, t, z in values}
    for i, j, kind, p in rules:
        a, b = (2 * w["transitive"] * p * (y[i] - y[j]), -1) if kind == "same" else (2 * w["exclusive"] * (1 - p) * max(0, y[i] + y[j] - 1), 1)
        g[i], g[j] = g[i] + a, g[j] + a * b
    return max(abs(s) for k, s in g.items() if not (y[k] <= 0 and s > 0 or y[k] >= 1 and s < 0))


@pytest.mark.parametrize("largest", [linkage.GROUP_RULES, 3])
def test_large_groups_reach_the_optimum_with_production_parameters(spark, largest):
    rng = random.Random(2)
    values, rules = [(1, 1, 6.0, 1.0)] + [(1, k, 0.0, 0.25) for k in range(2, 7)], [(1, 1, k, "same", 0.8) for k in range(2, 7)]
    for g in range(2, 4 if largest == 3 else 40):
        ids = [100 * g + k for k in range(rng.randint(2, 9))]
        values += [(g, k, rng.choice([0.0, 3.0, 6.0, 13.0]), rng.choice([0.25, 1.0, 4.0])) for k in ids]
        rules += [(g, i, j, *rng.choice([("same", 0.8), ("same", 0.6), ("other", 0.1), ("other", 0.4)])) for i, j in itertools.combinations(ids, 2)]
    v = spark.createDataFrame(values, "v long, var long, t double, z double")
    r = spark.createDataFrame(rules, "v long, i long, j long, kind string, p double")
    got = {x.var: x.y for x in linkage.solve_groups(v, r, 4.0, largest).collect()}
    assert got.keys() == {x[1] for x in values} and got[1] > 0.68 and min(got[k] for k in range(2, 7)) > linkage.MATCH
    assert slopes([x[1:] for x in values], [x[1:] for x in rules], got) < 1e-3
    assert linkage.solve_groups(v.limit(0), r.limit(0), 4.0).count() == 0


def test_tokens():
    t = tokens.tokenizer(tokens.VOCABULARY)
    for s in ["a  b", "\r\n\r\n y", "çş\u001fğ  ü", "", " ", "a" * 5000, "\n\n\n", "x \n\n  y", "don't  's", "  x"]:
        assert t.ids(s) == t.exact.encode_ordinary(s)
        assert t.offsets(s)[-1] == len(s.encode())


@pytest.mark.parametrize("limit,overlap", [(16, 4), (64, 0)])
def test_pieces(limit, overlap):
    t = tokens.tokenizer(tokens.VOCABULARY)
    text = "# Baş\n\nSn. Ali geldi. Şule gitti!\r\n\r\n## İki\nuzun " + "kelime " * 200 + "ş" * 300
    raw, at = text.encode(), 0
    for _, _, _, start, n, _, _, body in splitting.split_text(text, t, [(limit, overlap)]):
        b = body.encode()
        assert n <= limit and len(t.exact.encode_ordinary(body)) <= limit and start <= at and raw[start : start + len(b)] == b
        at = start + len(b)
    assert at == len(raw)


def test_pieces_share_the_overlap_and_follow_the_hierarchy():
    t = tokens.tokenizer(tokens.VOCABULARY)
    text = "# Bir\n\n" + "Kısa cümle burada. " * 12 + "\n\n# İki\n\n" + "kelime " * 150 + "\n\n" + "z9" * 400
    p = list(splitting.split_text(text, t, [(64, 16)]))
    assert all(16 <= x[5] <= 19 for x in p[1:]) and [x[6] for x in p[:-1]].count("end") == 0 and p[-1][6] == "end"
    assert {"sentence", "word", "character"} <= {x[6] for x in p}
    # sections that fit are never cut
    small = "# A\n" + "bir iki " * 10 + "\n\n# B\n" + "üç dört " * 10 + "\n\n# C\n" + "beş " * 10
    q = list(splitting.split_text(small, t, [(80, 0)]))
    assert len(q) > 1 and all(x[6] in ("section", "end") for x in q)


def test_too_many_limits_are_an_error(spark):
    lim = spark.range(1, 1100).selectExpr("'piece' AS limit_kind", "CAST(id AS int) AS max_tokens", "0 AS overlap_tokens")
    with pytest.raises(ValueError):
        splitting.split_texts(docs(spark), lim)


def test_packing():
    rng = random.Random(5)
    sizes = [rng.randint(1, 400) for _ in range(300)]
    p = packing.evolve(sizes, 512, 1)
    used = [sum(n for n, k in zip(sizes, p.labels) if k == b) for b in range(len(p.free))]
    assert all(0 < u <= 512 for u in used) and used == [512 - f for f in p.free]
    assert len(used) <= -(-sum(sizes) // 512) + 3 and len(packing.evolve([], 512, 1).free) == 0


def test_lower_bound_and_evolution_against_all_packings():
    def least(sizes, capacity):
        best = [len(sizes)]

        def go(k, free):
            if len(free) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(free)
                return
            for j in range(len(free)):
                if free[j] >= sizes[k]:
                    go(k + 1, [f - sizes[k] * (i == j) for i, f in enumerate(free)])
            go(k + 1, [*free, capacity - sizes[k]])

        go(0, [])
        return best[0]

    rng = random.Random(6)
    for n in range(40):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        best = least(sizes, 40)
        assert packing.lower_bound(sizes, 40) <= best <= len(packing.evolve(sizes, 40, n).free)
    # best fit needs a bin more: the largest items should not stand together
    hard = [6, 5, 5, 4, 4, 3, 3] * 6 + [7, 7, 6, 4, 3, 3] * 4
    bins = []
    packing.best_fit(sorted(range(len(hard)), key=lambda i: -hard[i]), hard, 10, bins, [])
    assert len(packing.evolve(hard, 10, 1, generations=200).free) <= len(bins)


def docs(spark):
    return spark.createDataFrame([(i, "kelime " * (i % 50 + 1), "ab"[i % 2]) for i in range(200)] + [(900, None, "a"), (901, "", None), (902, "x" * 20_000, "b"), (1, "kelime kelime ", "b")], "doc_id long, text string, source string").dropDuplicates(["doc_id"])


def test_containers(spark):
    lim = spark.createDataFrame([("container", 64, 0)], "limit_kind string, max_tokens int, overlap_tokens int")
    c = packing.fill_containers(docs(spark), lim)
    assert c.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 64").count() == 0
    assert c.where("doc_id < 200").select("doc_id").distinct().count() == 200 and c.where("doc_id IN (900, 901)").count() == 0
    assert packing.fill_containers(docs(spark).limit(0), lim).count() == 0


def test_mixture(spark):
    t = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix_sources(docs(spark), t)
    r = {x.source: x for x in mixing.mixture_report(m, t).collect()}
    assert abs(r["a"].reached_share - 0.7) < 0.02 and r["a"].most_copies <= 2 and r["b"].most_copies <= 1
    assert mixing.mix_sources(docs(spark).limit(0), t).count() == 0
