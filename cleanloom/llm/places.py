"""Problem 3: typed places to the entries of a reference list."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.text import fold_py, present
from cleanloom.llm.strings import PLACEHOLDERS, DeleteIndex

#: A reference list longer than this isn't sent to the workers; places of a whole country are a few thousand.
MOST_NAMES = 200_000
SHORTEST_PREFIX = 3


class PlaceMatcher:
    """The reference of one kind: an automaton over names and aliases, and for the rest token sets with slips and cut-off ends.

    ``entries``: (place_id, name, parent or None). Names are compared folded. Unknown text and placeholders give 0.
    """

    def __init__(self, entries: Iterable[tuple[int, str, int | None]]):
        self.parent: dict[int, int | None] = {}
        self.ids: dict[str, list[int]] = {}
        for i, name, parent in entries:
            key = words(name)
            if not key:
                continue
            self.parent[i] = parent
            if i not in self.ids.setdefault(key, []):
                self.ids[key].append(i)
        for v in self.ids.values():
            v.sort()
        self.automaton = ahocorasick.Automaton()
        for key in self.ids:
            self.automaton.add_word(f" {key} ", key)
        if self.ids:
            self.automaton.make_automaton()
        self.index = DeleteIndex(t for key in self.ids for t in key.split())
        self.of_token: dict[str, set[str]] = {}
        for key in self.ids:
            for t in key.split():
                self.of_token.setdefault(t, set()).add(key)
        self.keys = sorted(self.ids)
        self.names = lru_cache(100_000)(self._names)

    def mentions(self, text: str) -> list[str]:
        """Names embedded in folded text at word ends: the longest first, none overlapping."""
        if not self.ids:
            return []
        found = [(end - len(key) - 1, end, key) for end, key in self.automaton.iter(f" {text} ")]
        taken: list[tuple[int, int, str]] = []
        for start, end, key in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(end <= s or start >= e for s, e, _ in taken):
                taken.append((start, end, key))
        return [key for _, _, key in sorted(taken)]

    def similar(self, text: str) -> list[str]:
        """Names that share most tokens with the text, counting slips and cut-off tokens; several if they tie."""
        tokens = text.split()
        score: dict[str, float] = {}
        for t in tokens:
            near = self.index.near(t)
            for k, w in near:
                if k == near[0][0]:
                    for key in self.of_token[w]:
                        score[key] = score.get(key, 0) + 1 - k / 10
            if not near and len(t) >= SHORTEST_PREFIX:
                for key in self._starting(t):
                    score[key] = score.get(key, 0) + 0.5
        full = {k: v / max(1, len(k.split())) for k, v in score.items()}
        best = max(full.values(), default=0)
        return sorted(k for k, v in full.items() if v == best) if best >= 0.5 else []

    def _starting(self, t: str) -> list[str]:
        at, out = bisect_left(self.keys, t), []
        while at < len(self.keys) and self.keys[at].startswith(t):
            out.append(self.keys[at])
            at += 1
        return out

    def _names(self, value: str) -> tuple[str, ...]:
        text = words(value)
        if not text or text in PLACEHOLDERS:
            return ()
        return tuple(self.mentions(text)[:1] or self.similar(text))

    def resolve(self, value: str | None, parents: Iterable[int] = ()) -> int:
        """The entry meant; among several, the one within ``parents``, then the first entry of the list; 0 for none."""
        if value is None:
            return 0
        keys = self.names(value)
        ids = sorted({i for k in keys for i in self.ids[k]})
        if len(ids) > 1:
            within = set(parents)
            ids = [i for i in ids if self.parent[i] in within] or ids
        return ids[0] if ids else 0



def words(value: str) -> str:
    """Folded runs of letters and digits, one blank between."""
    return " ".join(re.findall(r"[a-z0-9]+", fold_py(value)))


def reference_entries(reference: DataFrame, aliases: DataFrame) -> dict[str, list[tuple[int, str, int | None]]]:
    """Both lists on the driver, after their size is checked against MOST_NAMES."""
    cols = ("place_id", "kind", "name", "parent_place_id")
    ref = reference.select("place_id", "kind", F.col("canonical_name").alias("name"), "parent_place_id")
    also = aliases.join(F.broadcast(reference.select("place_id", "kind", "parent_place_id")), "place_id").select("place_id", "kind", F.col("alias").alias("name"), "parent_place_id")
    rows = ref.select(*cols).unionByName(also.select(*cols)).where("name IS NOT NULL AND place_id IS NOT NULL").distinct().take(MOST_NAMES + 1)
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the reference list has more than {MOST_NAMES} names")
    out: dict[str, list[tuple[int, str, int | None]]] = {"city": [], "district": []}
    for r in rows:
        out.setdefault(r.kind, []).append((int(r.place_id), r.name, None if r.parent_place_id is None else int(r.parent_place_id)))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in out.items()}


_MATCHERS: dict[int, dict[str, PlaceMatcher]] = {}


def matchers(entries: dict[str, list[tuple[int, str, int | None]]]) -> dict[str, PlaceMatcher]:
    """Built once in each Python worker."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(entries.items())))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = {k: PlaceMatcher(v) for k, v in entries.items()}
    return _MATCHERS[key]


def place_udf(entries: dict[str, list[tuple[int, str, int | None]]]) -> Callable[[Column, Column, Column], Column]:
    """(city, district, address) to struct(city_id, district_id); the address helps only where the other two leave a choice."""

    @F.pandas_udf("city_id int, district_id int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = matchers(entries)
        city, district = m["city"], m["district"]

        @lru_cache(200_000)
        def tail(address: str) -> int:
            found = city.mentions(words(address))
            return city.ids[found[-1]][0] if found else 0

        for c, d, a in parts:
            rows = []
            for x, y, z in zip(c, d, a):
                at = city.resolve(x)
                ids = {i for k in district.names(y) for i in district.ids[k]} if y is not None else set()
                where = [at] if at else []
                if len(ids) > 1 and not at and z is not None:
                    where = [tail(z)]
                rows.append((at, district.resolve(y, where)))
            yield pd.DataFrame(rows, columns=["city_id", "district_id"], dtype="int32")

    return run


def map_places(records: DataFrame, reference: DataFrame, aliases: DataFrame, id_col: str = "source_record_id") -> DataFrame:
    """Every typed city and district with the entry it means: (id, field_name, place_id), 0 standing for none.

    Names and aliases embedded in a value are found by one multi-pattern automaton, the longest winning; what is left goes to
    token-set similarity with slips and cut-off tokens. Values that are null, blank or exactly a canonical name of their kind
    are no work and give no row; the remaining ones go once through an Arrow worker with a bounded cache, without a shuffle.
    A district name found in two cities takes the one in the record's city, then in the city its address ends with, then the
    first of the list. Only the last step, distinct over small rows, shuffles. Repeated rows count once; extra columns are
    ignored; an empty table gives an empty result.
    """
    entries = reference_entries(reference, aliases)
    exact = {k: F.broadcast(reference.where(F.col("kind") == k).select(F.col("canonical_name").alias(f"_{k}")).distinct()) for k in ("city", "district")}
    t = records.select(F.col(id_col).cast("string").alias("id"), *(F.col(c).cast("string").alias(c) for c in ("city", "district", "address")))
    t = t.where(present(F.col("city")) | present(F.col("district")))
    for k, names in exact.items():
        t = t.join(names, F.col(k) == F.col(f"_{k}"), "left").withColumn(f"todo_{k}", F.col(f"_{k}").isNull() & present(F.col(k))).drop(f"_{k}")
    t = t.where("todo_city OR todo_district").withColumn("p", place_udf(entries)("city", "district", "address"))
    both = F.array(
        F.when(F.col("todo_city"), F.struct(F.lit("city").alias("field_name"), F.col("p.city_id").alias("place_id"))),
        F.when(F.col("todo_district"), F.struct(F.lit("district").alias("field_name"), F.col("p.district_id").alias("place_id"))),
    )
    out = t.select("id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("m"))
    return out.select(F.col("id").alias(id_col), "m.field_name", "m.place_id").distinct()
