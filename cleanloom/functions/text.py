"""Text helpers as Column expressions; all stay inside the JVM except NFC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as white space (those that str.strip() removes).
WHITE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in WHITE) + "]"  # as a class of a Java pattern
NON_WS = "[^" + WS[1:]


# Turkish letters and the ASCII letters they fold to.
FOLD_FROM = "ÇĞIİÖŞÜçğıöşüÂâÎîÛû"
FOLD_TO = "cgiiosucgiosuaaiiuu"
_FOLD = {k: k for k in range(0x180)} | str.maketrans(FOLD_FROM, FOLD_TO)  # with the letters that stay: str.translate is slow where it finds none


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.btrim(x, F.lit(WHITE))


def collapse(x: Column) -> Column:
    """Stripped, each run of white space being one blank."""
    return F.regexp_replace(strip(x), WS + "+", " ")


def is_blank(x: Column) -> Column:
    """Null, empty or only white space; never null itself."""
    return F.coalesce(strip(x) == "", F.lit(True))


def present(x: Column) -> Column:
    return ~is_blank(x)


def digits(x: Column) -> Column:
    """Only the decimal digits, of any script, in order."""
    return F.regexp_replace(x, r"\P{Nd}", "")


def fold(x: Column) -> Column:
    """Lower case without Turkish or combining marks: what remains when a name is typed on a plain keyboard."""
    y = F.lower(F.translate(x, FOLD_FROM, FOLD_TO))
    return F.when(F.octet_length(y) == F.length(y), y).otherwise(F.regexp_replace(y, r"\p{M}+", ""))


def fold_py(x: str) -> str:
    """fold() for driver-side strings and Python workers."""
    x = x.translate(_FOLD).lower()
    return x if x.isascii() else "".join(c for c in x if unicodedata.category(c)[0] != "M")


@F.pandas_udf(T.StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def nfc(x: Column) -> Column:
    """Unicode NFC. Only values with a character above U+02FF can change, so the others reach the worker as null."""
    return F.coalesce(_nfc(F.when(x.rlike(r"[^\x{0000}-\x{02FF}]"), x)), x)


def title(x: Column) -> Column:
    """A capital after every non-letter, other letters small (initcap() looks at blanks only)."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")
