"""Delivered text files: rows that fail to parse (problem 2) and schemas that drift between files (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.session import cut, is_broadcast, lookup
from cleanloom.functions.text import WHITE, fold, strip
from cleanloom.plans.config import HEADER_ALIASES

# Delimiters that a file may use, in the order that settles a tie.
DELIMITERS = (",", ";", "\t", "|")
#: Fields of the one table that all files become: the canonical ones, then kinds of content that only what stands under a header tells.
FIELDS = ("first_name", "last_name", "email", "phone", "company", "city", "district", "address", "code", "consent", "balance", "joined", "score", "notes")
#: Fields whose values have a form that a cell can break.
CHECKED = ("email", "phone", "joined")
#: Fields that are told by the words of their values.
WORDED = ("first_name", "last_name", "company", "city", "district", "address")
# Words that stand for yes and no.
TRUE_FALSE = ("true", "false")
#: Share of the values under an unknown header that must have the form of a checked field.
ENOUGH = 0.8
#: Share of them that must have any other quality.
MOST = 0.5

_WSP = "".join(f"\\x{{{ord(c):04X}}}" for c in WHITE if c not in "\t")
_DAY = {"D": "(?:0?[1-9]|[12][0-9]|3[01])", "d30": "(?:0?[1-9]|[12][0-9]|30)", "d28": "(?:0?[1-9]|1[0-9]|2[0-8])"}
_YEAR = r"(?!0000)[0-9]{4}"
_LEAP = r"(?:(?!0000)[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"


def _dates() -> str:
    """A calendar date as year-month-day, or day and month before the year with dots or slashes."""
    months = [("(?:0?[13578]|1[02])", _DAY["D"]), ("(?:0?[469]|11)", _DAY["d30"]), ("0?2", _DAY["d28"])]
    parts = []
    for m, day in months:
        parts += [f"{_YEAR}-{m}-{day}", f"{day}\\.{m}\\.{_YEAR}", f"{day}/{m}/{_YEAR}"]
    parts += [f"{_LEAP}-0?2-29", f"29\\.0?2\\.{_LEAP}", f"29/0?2/{_LEAP}"]
    return "(?:" + "|".join(parts) + ")"


#: What a non-empty cell of a checked field must be. No alternative can match a quote, so the patterns also fit quoted cells.
VALUE = {
    "email": r"[^@\s\"]+@[^@\s\"]+\.[^@\s\"]+",
    "phone": r"\+?\(?[0-9](?:[ ().-]*[0-9]){9,13}\)?",
    "joined": _dates(),
}
#: What tells that a column holds a checked field: for dates their form, whether or not the calendar has the day.
FORM = {"email": VALUE["email"], "phone": VALUE["phone"], "joined": r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}"}


def header_key(h: Column) -> Column:
    """A header without case, Turkish marks, blanks, hyphens and underscores."""
    return F.regexp_replace(fold(h), f"[{_WSP}\t_-]+", "")


def unquoted(raw: Column) -> Column:
    """The text without its quoted parts, an open one going to the end."""
    return F.when(F.contains(raw, F.lit('"')), F.regexp_replace(raw, r'"[^"]*+(?:"|\z)', "")).otherwise(raw)


def count_cells(raw: Column, delimiter: Column) -> Column:
    """Cells of a line: delimiters outside quotes, plus one."""
    u = unquoted(raw)
    return F.length(u) - F.length(F.replace(u, delimiter, F.lit(""))) + 1


def cells(raw: Column, delimiter: Column) -> Column:
    """The cells of a line, without the quotes around them and with doubled quotes single; a line without quotes is only split."""
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    not_d = F.concat(F.lit("[^"), F.when(delimiter == "|", "\\|").otherwise(delimiter), F.lit("]*+"))
    pattern = F.concat(d, F.lit('("[^"]*+(?:""[^"]*+)*+(?:"'), not_d, F.lit("|\\z)|"), not_d, F.lit(")"))
    found = F.regexp_extract_all(F.concat(delimiter, raw), pattern, F.lit(1))
    quoted = F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(raw, F.lit('"')), quoted).otherwise(F.split(raw, F.concat(F.lit("\\"), delimiter), -1))


# --- patterns of a schema ---------------------------------------------------------------------------------------------


def any_cell(d: str) -> str:
    """Pattern of a cell of any content, d being the delimiter as in a class: a delimiter may stand only between two quotes.

    All quantifiers that could run over a long text are possessive: they neither backtrack nor nest calls.
    """
    return f'[^"{d}]*+(?:"[^"]*+"[^"{d}]*+)*+'


def cell_pattern(field: Column, d: Column) -> Column:
    """Pattern of one cell as it stands in the line: of a checked field blank or a value of it, quoted or not; else anything."""
    blank = f"[{_WSP}]*+"
    out = F.replace(F.lit(any_cell("DELIM")), F.lit("DELIM"), d)
    for f, value in VALUE.items():
        inner = value.replace(r"[^@\s\"]", r"[^@\s\"DELIM]")
        text = F.replace(F.lit(f"{blank}(?:{inner}{blank})?"), F.lit("DELIM"), d)
        quoted = f'"{blank}(?:{value}{blank})?"{blank}'
        out = F.when(field == f, F.concat(F.lit("(?:"), text, F.lit(f"|{quoted})"))).otherwise(out)
    return out


def prefix_pattern(cell_patterns: Column, quoted_d: Column) -> Column:
    """One pattern of all prefixes, each within the next: it matches as many fields from the left as fit, each up to a delimiter or the end."""
    field = F.transform(cell_patterns, lambda c: F.concat(c, F.lit("(?="), quoted_d, F.lit("|\\z)")))
    opening = F.concat(F.lit("(?:"), quoted_d)
    ends = F.repeat(F.lit(")?+"), F.size(cell_patterns) - 1)
    return F.concat(F.lit("\\A"), F.replace(F.array_join(field, "\x00"), F.lit("\x00"), opening), ends)


def schema_patterns(table: DataFrame) -> DataFrame:
    """(schema, row_pattern, shape_prefix, value_prefix, closed): the patterns of each delimiter and list of checked fields among the files."""
    s = table.select("schema", "delimiter", "checked").dropDuplicates(["schema"])
    d = F.concat(F.lit("\\"), F.col("delimiter"))
    quoted_d = F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))
    free = F.replace(F.lit(any_cell("DELIM")), F.lit("DELIM"), d)
    s = s.withColumn("value_cells", F.transform("checked", lambda f: cell_pattern(f, d))).withColumn("shape_cells", F.transform("checked", lambda f: free))
    row = F.concat(F.lit("\\A"), F.replace(F.array_join("value_cells", "\x00"), F.lit("\x00"), quoted_d), F.lit("\\z"))
    closed = F.concat(F.lit("\\A"), free, F.lit("(?:"), quoted_d, free, F.lit(")*+\\z"))
    return s.select("schema", row.alias("row_pattern"), prefix_pattern(F.col("shape_cells"), quoted_d).alias("shape_prefix"), prefix_pattern(F.col("value_cells"), quoted_d).alias("value_prefix"), closed.alias("closed"))


# --- what the headers mean --------------------------------------------------------------------------------------------


def known_headers(files: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(key, known): the field of headers that the labels or the aliases of the canonical schema tell; labels come first."""
    rows = [(h, f, 1) for f, hs in HEADER_ALIASES.items() for h in hs]
    t = files.sparkSession.createDataFrame(rows, "header string, field string, turn int")
    if labels is not None:
        t = t.unionByName(labels.where("canonical_field IS NOT NULL AND header IS NOT NULL").select("header", F.col("canonical_field").alias("field"), F.lit(0).alias("turn")))
    return t.groupBy(header_key(F.col("header")).alias("key")).agg(F.min_by("field", F.struct("turn", "field")).alias("known"))


def with_fields(table: DataFrame, meanings: DataFrame, name: str) -> DataFrame:
    """The files with an array ``name``: of each header the value that ``meanings`` (key, name) has for its key, null if none."""
    k = table.select("file_id", F.posexplode("keys").alias("pos", "key")).join(lookup(meanings), "key", "left")
    k = k.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(name).alias("m")))).alias("ms"))
    return table.join(k.select("file_id", F.transform("ms", lambda x: x["m"]).alias(name)), "file_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def with_delimiters(table: DataFrame, lines: DataFrame) -> DataFrame:
    """The files with their delimiter; an unknown one is that which fits most lines of the file."""
    open_ = table.where("delimiter IS NULL OR delimiter = ''")
    if open_.isEmpty():
        return table
    t = lines.select("file_id", "raw_text").join(lookup(open_.select("file_id", F.size("headers").alias("width"))), "file_id")
    fits = [F.count_if(count_cells(F.col("raw_text"), F.lit(d)) == F.col("width")).alias(f"d{k}") for k, d in enumerate(DELIMITERS)]
    best = t.groupBy("file_id").agg(*fits)
    top = F.greatest(*(F.col(f"d{k}") for k in range(len(DELIMITERS))))
    best = best.select("file_id", F.coalesce(*(F.when((F.col(f"d{k}") == top) & (top > 0), F.lit(d)) for k, d in enumerate(DELIMITERS))).alias("guess"))
    return table.join(best, "file_id", "left").withColumn("delimiter", F.coalesce(F.nullif("delimiter", F.lit("")), "guess", F.lit(DELIMITERS[0]))).drop("guess")


def header_contents(table: DataFrame, lines: DataFrame, words: bool) -> DataFrame:
    """(key, known, word, n and counts of forms): what stands under the headers, over all lines with as many cells as headers.

    Without ``words`` only unknown headers are looked at; with it also known ones, and values are counted by their first word. Cells
    shrink to counts of a header and word before anything moves.
    """
    f = lookup(table.select("file_id", "delimiter", "keys", "known"))
    t = lines.select("file_id", "raw_text").join(f, "file_id").select("keys", "known", cells(F.col("raw_text"), F.col("delimiter")).alias("cells")).where("size(cells) = size(keys)")
    t = t.select(F.inline(F.arrays_zip("keys", "known", "cells"))).select(F.col("keys").alias("key"), "known", strip(F.col("cells")).alias("v"))
    wanted = F.col("known").isNull() | F.col("known").isin(*WORDED) if words else F.col("known").isNull()
    t = t.where(wanted & (F.col("v") != ""))
    v, unknown = F.col("v"), F.col("known").isNull()
    digits = v.rlike(r"[0-9]")
    money = v.rlike(r"\A[+-]?[0-9]+[.,][0-9]{2}(?![0-9])|\A[+-]?[0-9]+(?:[.,][0-9]+)?\s*\p{L}{2,3}\z")
    code = v.rlike(r"\A[0-9]{4,}\z") | v.rlike(r"\A(?=[^0-9]*+[0-9])(?=[^\p{L}]*+\p{L})[\p{L}0-9/-]++\z")
    number = v.rlike(r"\A[+-]?[0-9]+(?:[.,][0-9]+)?\z")
    forms = {
        **{f: F.when(digits if f != "email" else F.contains(v, F.lit("@")), v.rlike(rf"\A(?:{p})\z")).otherwise(False) for f, p in FORM.items()},
        "balance": digits & money,
        "code": digits & code,
        "number": digits & number,
        "phrase": ~digits & v.rlike(r"\S\s+\S"),
    }
    counts = [F.count_if(unknown & c).alias(k) for k, c in forms.items()]
    word = F.regexp_extract(fold(v), r"([a-z]{2,})", 1) if words else F.lit("")
    return t.groupBy("key", "known", word.alias("word")).agg(F.count("*").alias("n"), *counts)


def header_meanings(contents: DataFrame) -> DataFrame:
    """(key, field) of the unknown headers by their contents.

    A header means e-mail, phone or date if most of its values have that form. Else it is the field that its words point to: each
    word stands for the known fields by how frequent it is in them, words of none for nothing. Else it is an amount, a code, another
    number, a phrase or a single word by what most values are.
    """
    c = cut(contents)
    total = c.where("known IS NULL").groupBy("key").agg(*(F.sum(x).alias(x) for x in ("n", *CHECKED, "balance", "code", "number", "phrase")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("known"))
    theirs = c.where("known IS NOT NULL AND word <> ''").groupBy("known", "word").agg(F.sum("n").alias("n")).select("word", F.col("known").alias("field"), share.alias("p"))
    theirs = theirs.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("word")))
    points = c.where("known IS NULL AND word <> ''").select("key", "word", "n").join(theirs, "word").groupBy("key", "field").agg(F.sum(F.col("n") * F.col("p")).alias("points"))
    best = points.groupBy("key").agg(F.max_by("field", F.struct("points", "field")).alias("worded"), F.max("points").alias("points"))
    t = total.join(best, "key", "left")
    much = lambda k, least: F.col(k) >= least * F.col("n")
    field = F.coalesce(
        *(F.when(much(f, ENOUGH), f) for f in CHECKED),
        F.when(much("points", MOST), F.col("worded")),
        F.when(much("balance", MOST), "balance"),
        F.when(much("code", MOST), "code"),
        F.when(much("number", MOST), "score"),
        F.when(much("phrase", MOST), "notes"),
        F.lit("consent"),
    )
    return t.select("key", field.alias("field"))


def file_table(lines: DataFrame, files: DataFrame, labels: DataFrame | None = None, words: bool = True) -> DataFrame:
    """The files, one row each, with delimiter, fields (what each header means, '' if nothing tells) and schema, the key of their patterns.

    Headers that labels and aliases don't know are told by their contents (header_meanings); ``words`` False tells only the checked
    fields among them, which is all that finding rejected rows needs.
    """
    f = files.where("file_id IS NOT NULL AND headers IS NOT NULL").dropDuplicates(["file_id"]).select("file_id", "feed_name", "covers_date", "headers", "delimiter", F.transform("headers", lambda h: F.coalesce(header_key(h), F.lit(""))).alias("keys"))
    f = cut(with_delimiters(with_fields(f, known_headers(files, labels), "known"), lines))
    told = with_fields(f, header_meanings(header_contents(f, lines, words)), "field")
    fields = F.transform(F.arrays_zip("known", "field"), lambda x: F.coalesce(x["known"], x["field"], F.lit("")))
    t = told.withColumn("fields", fields).withColumn("checked", F.transform("fields", lambda x: F.when(x.isin(*CHECKED), x).otherwise("")))
    t = t.withColumn("schema", F.concat_ws(" ", F.lit("d"), F.hex("delimiter"), F.array_join("checked", ",")))
    return cut(t.select("file_id", "feed_name", "covers_date", "headers", "keys", "fields", "delimiter", "checked", "schema"))


# --- rows ---------------------------------------------------------------------------------------------------------------


def once(lines: DataFrame) -> DataFrame:
    """The lines, each line_id once. Only ids are counted; text moves only for those that stand twice."""
    ids = lines.groupBy("line_id").agg(F.count("*").alias("n")).where("n > 1").select("line_id")
    t = lines.select("line_id", "file_id", "row_number", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    ids = cut(ids)
    if ids.isEmpty():
        return t
    twice = lookup(ids, written=True)
    return t.join(twice, "line_id", "left_anti").unionByName(t.join(twice, "line_id", "left_semi").dropDuplicates(["line_id"]))


def parsed_lines(lines: DataFrame, files: DataFrame, labels: DataFrame | None = None, words: bool = True) -> DataFrame:
    """(line_id, file_id, feed_name, row_number, raw_text, delimiter, headers, fields, reason_code, broken_field).

    files: as delivered, or what file_table() made of them. A whole row is matched against the anchored pattern of its file's
    schema. Rows that fail go through the prefixes of that pattern, and the first broken field gives the reason: if no prefix of
    cells of any content covers the row, a quote is left open there or the number of cells is wrong; else the first field whose value
    breaks the prefix is invalid. reason_code is null for loadable rows, else the first that holds of entirely_blank_row,
    unclosed_quote, inconsistent_column_count, invalid_value; broken_field is the number of the first broken field, from 1.

    The text of a line never moves: files and patterns come to it, by broadcast where their bytes allow. Lines of unknown files are
    left out; a null text is a blank row; the same line_id delivered twice counts once.
    """
    t = once(lines)
    f = files if "schema" in files.columns else file_table(t, files, labels, words)
    patterns, few = schema_patterns(f), f.select("file_id", "feed_name", "headers", "fields", "delimiter", "schema")
    p = lookup(patterns)
    t = t.join(lookup(few), "file_id").join(p, "schema") if is_broadcast(p) else t.join(lookup(few.join(p, "schema")), "file_id")
    raw, d = F.col("raw_text"), F.col("delimiter")
    bare = F.replace(F.regexp_replace(raw, f'["{_WSP}\t]+', ""), d, F.lit("")) == ""
    blank = F.when(raw.rlike(r"[\p{L}\p{N}]"), False).otherwise(bare)
    # regexp_instr keeps the compiled pattern while it stays the same; rlike would compile it for each row
    fits = F.expr("regexp_instr(raw_text, row_pattern)") > 0
    t = t.withColumn("state", F.when(blank, 1).when(fits, 0).otherwise(2))
    covered = F.expr("regexp_extract(raw_text, shape_prefix, 0)")
    shaped = (F.expr("regexp_instr(raw_text, shape_prefix)") > 0) & (F.length(covered) == F.length(raw)) & (count_cells(covered, d) == F.size("fields"))
    reason = (
        F.when(F.col("state") == 0, F.lit(None).cast("string")).when(F.col("state") == 1, "entirely_blank_row")
        .when(shaped, "invalid_value").when(F.expr("regexp_instr(raw_text, closed)") > 0, "inconsistent_column_count").otherwise("unclosed_quote")
    )
    good = lambda p: F.when(F.expr(f"regexp_instr(raw_text, {p})") > 0, count_cells(F.expr(f"regexp_extract(raw_text, {p}, 0)"), d)).otherwise(0)
    broken = F.when((F.col("state") > 0) & (F.size("fields") > 0), F.when(F.col("reason_code") == "invalid_value", good("value_prefix")).otherwise(good("shape_prefix")) + 1)
    t = t.withColumn("reason_code", reason).withColumn("broken_field", broken)
    return t.select("line_id", "file_id", "feed_name", "row_number", "raw_text", "delimiter", "headers", "fields", "reason_code", "broken_field")


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """(line_id, file_id, row_number, reason_code, broken_field, raw_values) of the rows that can't be loaded."""
    return parsed.where("reason_code IS NOT NULL").select("line_id", "file_id", "row_number", "reason_code", "broken_field", cells(F.col("raw_text"), F.col("delimiter")).alias("raw_values"))


def loaded_rows(parsed: DataFrame) -> DataFrame:
    """(line_id, file_id, feed_name, row_number, headers, fields, cells) of all others, empty cells being null."""
    c = F.transform(cells(F.col("raw_text"), F.col("delimiter")), lambda v: F.nullif(v, F.lit("")))
    return parsed.where("reason_code IS NULL").select("line_id", "file_id", "feed_name", "row_number", "headers", "fields", c.alias("cells"))


# --- schemas that drift -----------------------------------------------------------------------------------------------

#: The lattice of types: two types promote to the first in this order that both fit, text fitting everything.
TYPES = ("whole number", "decimal", "true/false", "date", "text")


#: Bits of a value for the lattice: a column has the first type whose bit all its values share.
BITS = {"whole number": 1, "decimal": 2, "true/false": 4, "date": 8}


def type_bits(v: Column) -> Column:
    """The bits of the types that a stripped, non-blank value is of; none for text."""
    whole = F.when(v.rlike(r"\A[+-]?[0-9]+\z"), BITS["whole number"] | BITS["decimal"]).when(v.rlike(r"\A[+-]?[0-9]+[.,][0-9]+\z"), BITS["decimal"])
    return F.when(v.rlike("[0-9]"), whole.when(v.rlike(f"\\A{VALUE['joined']}\\z"), BITS["date"]).otherwise(0)).when(F.lower(v).isin(*TRUE_FALSE), BITS["true/false"]).otherwise(0)


def column_types(parsed: DataFrame) -> DataFrame:
    """(file_id, pos, type): the least type of the lattice that holds every non-blank value of a column of loadable rows; null if there is none."""
    c = parsed.where("reason_code IS NULL").select("file_id", F.posexplode(cells(F.col("raw_text"), F.col("delimiter"))).alias("pos", "v"))
    c = c.select("file_id", "pos", strip(F.col("v")).alias("v")).where("v <> ''")
    # lines lie by file already, so this shrinks to a row for each file and column before anything moves
    g = c.groupBy("file_id", "pos").agg(F.bit_and(type_bits(F.col("v"))).alias("bits"))
    return g.select("file_id", "pos", F.coalesce(*(F.when(F.col("bits").bitwiseAND(b) > 0, n) for n, b in BITS.items()), F.lit(TYPES[-1])).alias("type"))


def file_schemas(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """(feed_name, file_id, covers_date, columns): columns in order, each with header, key, field and type. files: as for parsed_lines()."""
    types = column_types(parsed).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "type"))).alias("types"))
    f = files
    if "fields" not in files.columns:
        f = files.where("file_id IS NOT NULL AND headers IS NOT NULL").dropDuplicates(["file_id"]).join(parsed.groupBy("file_id").agg(F.first("fields").alias("fields")), "file_id", "left")
    f = f.select("feed_name", "file_id", "covers_date", "headers", "fields").join(types, "file_id", "left")
    column = F.transform(
        "headers",
        lambda h, i: F.struct(h.alias("header"), header_key(h).alias("key"), F.coalesce(F.nullif(F.get("fields", i), F.lit("")), F.concat(F.lit("?"), header_key(h))).alias("field"), F.try_element_at("types", i).alias("type")),
    )
    return f.select("feed_name", "file_id", "covers_date", column.alias("columns"))


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Ordered differences of each file to the one before of its feed: (feed_name, file_id, change_no, change_type, header).

    Files are taken by covers_date, then file_id. Columns are the same if their headers agree but for case, blanks, hyphens and
    underscores; renamed if only their field agrees; else added or removed. A column whose type differs is type_changed, unless
    one of the two files has no value in it. The window holds one small row for each file, none for their lines.
    """
    w = Window.partitionBy("feed_name").orderBy(F.col("covers_date").asc_nulls_first(), "file_id")
    t = schemas.withColumn("before", F.lag("columns").over(w)).where("before IS NOT NULL")
    at = lambda cs, name, x: F.get(F.filter(cs, lambda c: c[name] == x), F.lit(0))
    new = F.filter("columns", lambda c: ~F.exists("before", lambda b: b["key"] == c["key"]))
    old = F.filter("before", lambda b: ~F.exists("columns", lambda c: c["key"] == b["key"]))
    t = t.withColumn("new", new).withColumn("old", old)
    note = lambda kind, h: F.struct(F.lit(kind).alias("change_type"), h.alias("header"))
    renamed = F.filter("new", lambda c: F.exists("old", lambda b: b["field"] == c["field"]))
    added = F.filter("new", lambda c: ~F.exists("old", lambda b: b["field"] == c["field"]))
    removed = F.filter("old", lambda b: ~F.exists("new", lambda c: b["field"] == c["field"]))
    earlier = lambda c: F.coalesce(at(F.col("before"), "key", c["key"]), at(F.col("old"), "field", c["field"]))
    retyped = F.filter("columns", lambda c: F.coalesce(earlier(c)["type"] != c["type"], F.lit(False)))
    changes = F.concat(
        F.transform(added, lambda c: note("added", c["header"])),
        F.transform(removed, lambda c: note("removed", c["header"])),
        F.transform(renamed, lambda c: note("renamed", c["header"])),
        F.transform(retyped, lambda c: note("type_changed", c["header"])),
    )
    return t.select("feed_name", "file_id", F.posexplode(changes).alias("change_no", "c")).select("feed_name", "file_id", F.col("change_no").cast("int").alias("change_no"), "c.change_type", "c.header")


def unified_types(schemas: DataFrame) -> dict[str, str]:
    """The type of each field over all files: the fold of its columns' types through the lattice. One row a field reaches the driver."""
    c = schemas.select(F.inline("columns")).where("type IS NOT NULL AND NOT startswith(field, '?')")
    out = {}
    for r in c.groupBy("field").agg(F.collect_set("type").alias("types")).collect():
        out[r.field] = promote(r.types)
    return out


def promote(types: list[str]) -> str:
    """Least upper bound: whole numbers fit decimals, everything fits text."""

    def two(a: str, b: str) -> str:
        return a if a == b else "decimal" if {a, b} == {"whole number", "decimal"} else "text"

    return reduce(two, types)


def unified_table(parsed: DataFrame, types: dict[str, str]) -> DataFrame:
    """All loadable rows of all files with the same columns: line, file, feed, row number and one column for each canonical field.

    A field is cast to its union type (decimal(38,6), bigint, boolean, date or string); cells of unknown headers are kept in the
    map ``other`` by header. Where a file has two columns of one field, the first that isn't empty counts.
    """
    p = loaded_rows(parsed)
    value = lambda f: F.get(F.filter(F.transform("cells", lambda c, i: F.when(F.get("fields", i) == f, c)), lambda c: c.isNotNull()), F.lit(0))

    def cast(f: str) -> Column:
        v, kind = value(f), types.get(f, "text")
        if kind == "whole number":
            return strip(v).try_cast("bigint")
        if kind == "decimal":
            return F.replace(strip(v), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")
        if kind == "true/false":
            return F.lower(strip(v)).try_cast("boolean")
        if kind == "date":
            s = strip(v)
            return F.coalesce(F.try_to_date(s, "yyyy-M-d"), F.try_to_date(s, "d.M.yyyy"), F.try_to_date(s, "d/M/yyyy"))
        return v

    other = F.map_from_entries(F.array_distinct(F.filter(F.transform("headers", lambda h, i: F.when(F.get("fields", i) == "", F.struct(F.concat(h, F.lit("#"), i.cast("string")).alias("k"), F.get("cells", i).alias("v")))), lambda x: x.isNotNull())))
    return p.select("line_id", "file_id", "feed_name", "row_number", *(cast(f).alias(f) for f in FIELDS), other.alias("other"))
