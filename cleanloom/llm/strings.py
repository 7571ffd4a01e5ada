"""Edit distance, the symmetric-delete index and the shared clean-up of typed tokens."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What people type when they have nothing to say; compared after folding, without punctuation at the ends.
PLACEHOLDERS = (
    "yok", "x", "xx", "xxx", "ayni", "adres", "null", "none", "nan", "n/a", "n.a", "na", "n a", "bilinmiyor", "belirtilmemis", "test", "asdf",
    "seciniz", "diger", "yurtdisi", "abc", "tel-yok", "bos", "-", "--", ".", "...", "?", "00", "unknown",
)


def osa(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; limit + 1 stands for anything above limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, older[j - 2] + 1)
            row.append(c)
        if min(row) > limit:
            return limit + 1
        older, last = last, row
    return min(last[-1], limit + 1)


def reach(token_length: int) -> int:
    """Edits allowed in a token: none below four letters, one below seven, two from there."""
    return 0 if token_length < 4 else 1 if token_length < 7 else 2


def deletes(token: str, n: int) -> set[str]:
    """The token with up to n characters left out."""
    out = {token}
    for k in range(1, min(n, len(token) - 1) + 1):
        out.update("".join(token[i] for i in keep) for keep in combinations(range(len(token)), len(token) - k))
    return out


class DeleteIndex:
    """Symmetric deletion: two words within n edits share a form with at most n characters left out of each."""

    def __init__(self, words: Iterable[str]):
        self.at: dict[str, set[str]] = {}
        for w in set(words):
            for v in deletes(w, reach(len(w))):
                self.at.setdefault(v, set()).add(w)

    def near(self, token: str) -> list[tuple[int, str]]:
        """(distance, word) in order of distance."""
        n = reach(len(token))
        seen = {w for v in deletes(token, n) for w in self.at.get(v, ())}
        found = ((osa(token, w, min(n, reach(len(w)))), w) for w in seen)
        return sorted((k, w) for k, w in found if k <= min(n, reach(len(w))))


def delete_forms(token: Column) -> Column:
    """The token itself and the token less one character, as an array: words one edit or one swap apart share a form."""
    cuts = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), cuts))


def reach_forms(token: Column) -> Column:
    """The token less as many characters as reach() allows edits: words within that many edits share a form."""
    once = delete_forms(token)
    return F.when(F.length(token) < 4, F.array(token)).when(F.length(token) < 7, once).otherwise(F.array_distinct(F.flatten(F.transform(once, delete_forms))))


@F.pandas_udf(T.IntegerType())
def edit_count(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between a and b; three stands for anything above what reach() allows the shorter one."""
    near = ((osa(x, y, k), k) for x, y, k in zip(a, b, (reach(min(len(x), len(y))) for x, y in zip(a, b))))
    return pd.Series([n if n <= k else 3 for n, k in near], dtype="int32")


def corrections(counts: DataFrame, dominance: int = 4, shortest: int = 6) -> DataFrame:
    """From (token, n) to (token, fixed, n_fixed): the spelling of which the token is most likely a slip.

    A spelling is taken as meant if both share a form less one character (one edit or one swap apart) and it occurs
    ``dominance`` times as often. The rule is relative, so it behaves alike at every size. Tokens that stand for themselves
    aren't listed. Works over distinct tokens only; the forms of a token are at most its length plus one,
    and a form is shared by few tokens, so the join stays near linear in the vocabulary.
    """
    c = counts.where(F.length("token") >= shortest)
    # forms meet by their hashes; whether two words really are near is settled below
    forms = c.select("token", "n", F.explode(F.transform(delete_forms(F.col("token")), lambda f: F.xxhash64(f))).alias("form"))
    b = forms.where(F.col("n") >= dominance).select("form", F.col("token").alias("fixed"), F.col("n").alias("n_fixed"))  # a token occurs once at least
    near = forms.join(b, "form").where((F.col("token") != F.col("fixed")) & (F.col("n_fixed") >= F.col("n") * dominance)).select("token", "fixed", "n_fixed").distinct()
    swap = F.array_sort(F.split("token", "")) == F.array_sort(F.split("fixed", ""))
    apart = F.levenshtein("token", "fixed")
    near = near.withColumn("apart", apart).where("apart <= 2").withColumn("edits", F.when(swap, 1).otherwise(F.col("apart")))
    best = near.groupBy("token").agg(F.max_by(F.struct("fixed", "n_fixed"), F.struct(-F.col("edits"), "n_fixed", "fixed")).alias("m"))
    return best.select("token", "m.fixed", "m.n_fixed")
