"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.session import cut
from cleanloom.llm.tokens import VOCABULARY, token_count

#: Sources of a mixture; their sums go to the driver, one row a source.
MOST_SOURCES = 10_000
#: Steps of the table that places the rounding threshold of a source.
ROUNDING_BINS = 4096


def entropy_rates(sizes: DataFrame, targets: dict[str, float], caps: dict[str, int], steps: int = 60, close: float = 1e-9) -> dict[str, float]:
    """The multiplier of each source in the dual of entropy balancing, by Newton's method with sums over all documents.

    sizes: (source, n, k), k documents of n tokens. Rates stay as near to one copy as possible in relative entropy while the
    tokens of each source meet their target: rate = min(cap, exp(multiplier * n)). The dual is concave and falls apart by source,
    so each step is one aggregation for all sources; where a step overshoots, it is bisected within the bounds known so far.
    """
    spark = sizes.sparkSession
    x = {s: 0.0 for s in targets}
    low, high = {s: -math.inf for s in targets}, {s: math.inf for s in targets}
    open_ = set(targets)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, x[s], float(caps[s])) for s in open_], "source string, x double, cap double")
        w = F.least(F.col("cap"), F.exp(F.least(F.col("x") * F.col("n"), F.lit(700.0))))
        free = F.when(w < F.col("cap"), w).otherwise(0.0)
        rows = sizes.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(w * F.col("n") * F.col("k")).alias("g"), F.sum(free * F.col("n") * F.col("n") * F.col("k")).alias("h")).collect()
        for r in rows:
            s, miss = r.source, r.g - targets[r.source]
            if abs(miss) <= close * max(1.0, targets[s]):
                open_.discard(s)
                continue
            if miss < 0:
                low[s] = max(low[s], x[s])
            else:
                high[s] = min(high[s], x[s])
            step = x[s] - miss / r.h if r.h > 0 else (x[s] + (1e-6 if miss < 0 else -1e-6)) * 2
            if not low[s] < step < high[s]:
                if math.isfinite(low[s]) and math.isfinite(high[s]):
                    step = (low[s] + high[s]) / 2
                else:
                    step = x[s] * 2 + (1e-4 if miss < 0 else -1e-4)
            if step == x[s]:
                open_.discard(s)
            x[s] = step
        open_ &= {r.source for r in rows}
    return x


def mix_sources(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): how often each document stands in the mixture.

    targets: (source, target_share, max_repeats). The mixture holds ``total`` tokens, by default as many as the sources can give
    at their shares without exceeding max_repeats. Entropy balancing gives each document a rate (see entropy_rates); rates are
    rounded to copies by a fixed hash of the id against the fraction, and the threshold of each source is moved so that its
    tokens meet the target to within a few documents. Documents of other or null sources, without an id and without tokens get no
    copies. A repeated id counts once; shares are taken relative to their sum; a source without documents is left out of the
    shares; empty tables give an empty result. Only one row a source, and one for each of its rounding steps, reach the driver.
    """
    t = documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    t = cut(t.select("id", "source", token_count(vocabulary)(F.col("text")).alias("n")).dropDuplicates(["id"]))
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = documents.sparkSession
    plan = spark.createDataFrame([(r.source, float(r.share), int(r.cap)) for r in rows], "source string, share double, cap int")
    sizes = cut(t.where("n > 0").join(F.broadcast(plan.select("source")), "source").groupBy("source", "n").agg(F.count("*").alias("k")))
    have = {r.source: int(r.tokens) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("k")).alias("tokens")).collect()}
    shares = {r.source: float(r.share) for r in rows if r.source in have}
    caps = {r.source: int(r.cap) for r in rows if r.source in have}
    whole = sum(shares.values())
    shares = {s: v / whole for s, v in shares.items()}
    most = min((caps[s] * have[s] / v for s, v in shares.items()), default=0.0)
    size = min(most, total) if total else most
    want = {s: v * size for s, v in shares.items()}
    full = {s for s in want if want[s] >= caps[s] * have[s] * (1 - 1e-9)}
    x = entropy_rates(sizes, {s: v for s, v in want.items() if s not in full}, caps)
    solved = spark.createDataFrame([(s, caps[s], x.get(s, 0.0), s in full) for s in want], "source string, cap int, x double, full boolean")
    rate = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.exp(F.least(F.col("x") * F.col("n"), F.lit(700.0)))))
    r = t.join(F.broadcast(solved), "source", "left").withColumn("rate", F.when((F.col("n") > 0) & F.col("cap").isNotNull(), rate).otherwise(0.0))
    u = F.pmod(F.xxhash64("id"), F.lit(2**40)) / float(2**40)
    r = r.withColumn("base", F.floor("rate").cast("int")).withColumn("gap", F.col("rate") - F.floor("rate") - u)  # in (-1, 1)
    # a further copy where the gap lies above the source's threshold; the table of tokens by gap settles the threshold
    cell = F.floor((F.col("gap") + 1) / 2 * ROUNDING_BINS).cast("int")
    table = r.where("rate > 0 AND rate < cap").groupBy("source", cell.alias("cell")).agg(F.sum("n").alias("tokens"))
    base = {q.source: int(q.tokens) for q in r.where("rate > 0").groupBy("source").agg(F.sum(F.col("base") * F.col("n")).alias("tokens")).collect()}
    cells: dict[str, list[tuple[int, int]]] = {}
    for q in table.collect():  # at most ROUNDING_BINS rows a source
        cells.setdefault(q.source, []).append((q.cell, int(q.tokens)))
    cuts = []
    for s in want:
        miss, at, best = want[s] - base.get(s, 0), ROUNDING_BINS, (abs(want[s] - base.get(s, 0)), ROUNDING_BINS)
        for k, tokens in sorted(cells.get(s, []), reverse=True):
            miss, at = miss - tokens, k
            best = min(best, (abs(miss), at))
        cuts.append((s, best[1]))
    at = spark.createDataFrame(cuts, "source string, least int")
    more = ((F.col("rate") > 0) & (F.col("rate") < F.col("cap")) & (cell >= F.col("least"))).cast("int")
    r = r.join(F.broadcast(at), "source", "left")
    return r.select(F.col("id").alias(id_col), "source", F.col("n").alias("n_tokens"), F.round("rate", 6).alias("rate"), F.when(F.col("rate") > 0, F.col("base") + more).otherwise(0).alias("copies"))


def mixture_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, max_repeats, most_copies, documents, used_documents, tokens) for each target."""
    m = mixture.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("copies") > 0).alias("used_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    whole = mixture.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("whole"))
    t = targets.select("source", "target_share", "max_repeats").join(m, "source", "left").crossJoin(F.broadcast(whole))  # one row
    reached = F.coalesce(F.try_divide(F.col("tokens"), F.col("whole")), F.lit(0.0))
    return t.select("source", "target_share", F.round(reached, 6).alias("reached_share"), "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("most_copies", "documents", "used_documents", "tokens")))
