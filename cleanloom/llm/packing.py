"""Problem 8: filling fixed-capacity containers with texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.session import cut
from cleanloom.llm.splitting import Cuts, full_points, wanted_limits
from cleanloom.llm.tokens import VOCABULARY

Bins = list[list[int]]

#: Items of a block on average. Blocks are packed by themselves, so at most one container of a block is badly filled.
BLOCK = 1000
#: A text larger than a container is cut at the strongest boundary beyond this share of the container, so that little room is lost.
NEAR_FULL = 0.96


def best_fit(items: Sequence[int], sizes: Sequence[int], capacity: int, bins: Bins, free: list[int]) -> None:
    """Each item in turn goes to the bin with the least room that holds it, else to a new one."""
    room = sorted((f, k) for k, f in enumerate(free))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            f, k = room.pop(at)
            bins[k].append(i)
        else:
            f, k = capacity, len(bins)
            bins.append([i])
            free.append(capacity)
        free[k] = f - sizes[i]
        if free[k]:
            insort(room, (free[k], k))


def lower_bound(sizes: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins: for each k, items above capacity - k stand alone, and those of k or more must find room beside those above half.

    All k that are the size of an item are tried, over sums by size.
    """
    order = sorted(sizes)
    sums = [0, *accumulate(order)]
    whole = -(-sums[-1] // capacity)
    half = bisect_right(order, capacity // 2)
    for k in sorted(set(order[:half])):
        low, high = bisect_left(order, k), bisect_right(order, capacity - k)
        beside = (high - half) * capacity - (sums[high] - sums[half])
        whole = max(whole, len(order) - half + max(0, -(-(sums[half] - sums[low] - beside) // capacity)))
    return whole


class Packing:
    """The bin of each item and the room left in each bin."""

    def __init__(self, labels: np.ndarray, free: np.ndarray):
        self.labels, self.free = labels, free

    @classmethod
    def of(cls, labels: Sequence[int], sizes: np.ndarray, capacity: int) -> Packing:
        at = np.asarray(labels, dtype=np.int64)
        return cls(at, capacity - np.bincount(at, sizes, int(at.max(initial=-1)) + 1).astype(np.int64))

    def worth(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then the mean square of how full they are: full bins beside emptier ones are preferred to bins half full."""
        return -len(self.free), float(np.mean((1 - self.free / capacity) ** 2)) if len(self.free) else 1.0


def cross(a: Packing, b: Packing, sizes: np.ndarray, rng: np.random.Generator, capacity: int) -> Packing:
    """Well-filled bins of b enter whole; bins of a that share an item with them go, and their other items are fitted in again.

    The emptiest bins of a are opened too, so that displaced items find more than the gaps left. Displaced items, the largest first,
    take the place of a smaller item where that fills a bin best; what is then left over goes by best fit.
    """
    full = np.argsort(b.free, kind="stable")[: max(1, len(b.free) // 2)]
    chosen = rng.choice(full, min(len(full), 1 + int(rng.integers(1 + len(b.free) // 25))), replace=False)
    enters = np.zeros(len(b.free), dtype=bool)
    enters[chosen] = True
    whole = enters[b.labels]
    goes = np.zeros(len(a.free), dtype=bool)
    goes[a.labels[whole]] = True
    k = max(1, len(a.free) // 50)
    goes[np.argpartition(a.free, len(a.free) - k)[-k:]] = True
    keep = np.flatnonzero(~goes)
    at_a, at_b = np.full(len(a.free), -1), np.full(len(b.free), -1)
    at_a[keep], at_b[chosen] = np.arange(len(keep)), len(keep) + np.arange(len(chosen))
    labels = np.where(whole, at_b[b.labels], at_a[a.labels])
    free = np.concatenate((a.free[keep], b.free[chosen]))
    loose = np.flatnonzero(labels < 0)
    rest = []
    for i in loose[np.argsort(-sizes[loose], kind="stable")]:
        gain = sizes[i] - sizes
        fits = (gain > 0) & (labels >= 0)
        fits[fits] = gain[fits] <= free[labels[fits]]
        j = int(np.argmax(np.where(fits, gain, 0))) if fits.any() else -1
        if j < 0:
            rest.append(i)
        else:
            labels[i], labels[j] = labels[j], -1
            free[labels[i]] -= gain[j]
            rest.append(j)
    new: list[int] = []
    for i in sorted(rest, key=lambda i: (-sizes[i], i)):
        room = np.where(free >= sizes[i], free, capacity + 1)
        j = int(np.argmin(room)) if len(room) else 0
        if not len(room) or room[j] > capacity:
            j, free = len(free), np.append(free, capacity)
        labels[i] = j
        free[j] -= sizes[i]
    return Packing(labels, free)


def evolve(sizes: Sequence[int], capacity: int, seed: int, start: Sequence[Sequence[int]] = (), population: int = 4, generations: int = 12) -> Packing:
    """A grouping genetic algorithm over one block: the best packing after some generations, never worse than those it starts from.

    start: labels of packings. It ends as soon as a packing has as many bins as lower_bound(), for then there is none with fewer.
    """
    size = np.asarray(sizes, dtype=np.int64)
    rng = np.random.default_rng(seed)
    people = [Packing.of(x, size, capacity) for x in start]
    least = lower_bound(sizes, capacity)
    while len(people) < population and not any(len(p.free) <= least for p in people):
        weight = size if not people else size * (0.8 + 0.4 * rng.random(len(size)))
        bins: Bins = []
        best_fit(np.argsort(-weight, kind="stable").tolist(), size.tolist(), capacity, bins, [])
        people.append(Packing.of(to_labels(bins, len(size)), size, capacity))
    scored = sorted(((*p.worth(capacity), -k, p) for k, p in enumerate(people)), reverse=True, key=lambda x: x[:3])
    for serial in range(generations):
        if -scored[0][0] <= least or len(scored) < 2:
            break
        a, b = rng.choice(len(scored), 2, replace=False)
        child = cross(scored[a][3], scored[b][3], size, rng, capacity)
        scored = sorted([*scored, (*child.worth(capacity), -len(people) - serial, child)], reverse=True, key=lambda x: x[:3])[:population]
    return scored[0][3]


def to_labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def text_items(documents: DataFrame, capacities: Sequence[int], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, max_tokens, piece_no, start_byte, n_tokens): the whole text where it fits, else its pieces at natural boundaries."""
    schema = f"{id_col} long, max_tokens int, piece_no int, start_byte long, n_tokens int"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cleanloom.llm.tokens import tokenizer

        t = tokenizer(vocabulary)
        for part in parts:
            rows: list[tuple] = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = text.encode("utf-8", "replace")
                if len(raw) <= capacities[0]:  # a token is at least a byte
                    size, offsets = t.count(text), None
                else:
                    offsets = t.offsets(text)
                    size = len(offsets) - 1
                cuts = None
                for c in capacities:
                    if size <= c:
                        rows.append((key, c, 0, 0, size))
                        continue
                    cuts = cuts or Cuts(offsets, raw)
                    rows += [(key, c, k, int(offsets[a]), b - a) for k, (a, b, _, _) in enumerate(full_points(cuts, c, NEAR_FULL))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    docs = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).where(f"{id_col} IS NOT NULL AND length({text_col}) > 0")
    return docs.mapInArrow(run, schema)


def fill_containers(
    documents: DataFrame,
    limits: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    islands: int = 3,
    epochs: int = 2,
    population: int = 4,
    generations: int = 12,
    block: int = BLOCK,
) -> DataFrame:
    """Every text in a container: (max_tokens, container_id, doc_id, piece_no, start_byte, n_tokens), for each container size of limits.

    limits: rows of limit_kind 'container'. A text is cut only where it is larger than the container, at natural boundaries.
    Items fall by hash into blocks of bounded size, whatever text or source is frequent; each block is packed by a grouping
    genetic algorithm on several islands, the islands of a block exchange their elites between the epochs, and the packing with
    the fewest containers, then the fullest ones, stands. Null and empty texts are in no container; a repeated id counts once;
    extra columns are ignored; empty tables give an empty result. The same input gives the same containers.
    """
    sizes = sorted({m for m, _ in wanted_limits(limits, "container")})
    items = cut(text_items(documents, sizes, id_col, text_col, vocabulary).dropDuplicates([id_col, "max_tokens", "piece_no"]))
    counts = {r[0]: r[1] for r in items.groupBy("max_tokens").count().collect()}  # a row for each container size
    blocks = F.coalesce(*(F.when(F.col("max_tokens") == c, F.lit(-(-n // block))) for c, n in counts.items()), F.lit(1)) if counts else F.lit(1)
    b = items.withColumn("block", F.pmod(F.xxhash64(id_col, "piece_no"), blocks))
    entry = F.struct(F.col(id_col).alias("d"), F.col("piece_no").alias("p"), F.col("start_byte").alias("s"), F.col("n_tokens").alias("n"))
    packed = cut(b.groupBy("max_tokens", "block").agg(F.array_sort(F.collect_list(entry)).alias("items")))
    # from here on a block is its sizes and the labels of its packings; documents join again at the end
    b = packed.select("max_tokens", "block", F.transform("items", lambda x: x["n"]).alias("sizes"), F.array().cast("array<array<int>>").alias("elites"))
    keep = "max_tokens int, block long, sizes array<int>"
    for epoch in range(epochs):
        every = b.withColumn("island", F.explode(F.sequence(F.lit(0), F.when(settled(), 0).otherwise(islands - 1)))).repartition("max_tokens", "block", "island")

        def run(parts: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for cap, blk, its, elites, island in zip(part["max_tokens"], part["block"], part["sizes"], part["elites"], part["island"]):
                    n = [int(x) for x in its]
                    # the island's own elite comes first, then that of its neighbour in the ring
                    start = [elites[(island + k) % len(elites)] for k in range(min(2, len(elites)))] if len(elites) else []
                    got = evolve(n, int(cap), (int(cap) * 1_000_003 + int(blk)) * 1000 + int(island) * 10 + epoch, start, population, generations)
                    bins, fit = got.worth(int(cap))
                    out.append((cap, blk, its, island, got.labels.tolist(), -bins, fit, -bins <= lower_bound(n, int(cap))))
                yield pd.DataFrame(out, columns=["max_tokens", "block", "sizes", "island", "labels", "bins", "fit", "least"])

        done = every.mapInPandas(run, f"{keep}, island int, labels array<int>, bins int, fit double, least boolean")
        best = F.max_by("labels", F.struct(-F.col("bins"), "fit", -F.col("island")))
        # a block with a packing that can't be beaten keeps that one only; the others exchange their elites
        b = cut(done.groupBy("max_tokens", "block").agg(
            F.first("sizes").alias("sizes"),
            F.when(F.max("least"), F.array(best)).otherwise(F.transform(F.array_sort(F.collect_list(F.struct("island", "labels"))), lambda x: x["labels"])).alias("elites"),
            best.alias("best"),
        ))
    z = packed.join(b.select("max_tokens", "block", "best"), ["max_tokens", "block"]).select("max_tokens", "block", F.inline(F.arrays_zip("items", "best")))
    return z.select("max_tokens", (F.col("block") * 2**20 + F.col("best")).alias("container_id"), F.col("items.d").alias(id_col), F.col("items.p").alias("piece_no"), F.col("items.s").alias("start_byte"), F.col("items.n").alias("n_tokens"))


def settled() -> Column:
    """A block whose one packing can't be beaten."""
    return F.size("elites") == 1


def container_report(containers: DataFrame) -> DataFrame:
    """(max_tokens, containers, items, tokens, fill): how full the containers are, fill being the share of their room in use."""
    c = containers.groupBy("max_tokens").agg(F.count_distinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return c.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6))
