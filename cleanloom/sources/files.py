"""Delimited and spreadsheet files as tables with strict row accounting.

A file is decoded and parsed where it lies, one task for each file: every row comes out either accepted or rejected with a reason.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cleanloom.operators.quality import row_accounting
from cleanloom.plans.config import IngestionConfig


class IngestionError(Exception):
    """A file that can't be read; ``code`` says why."""

    def __init__(self, code: str, message: str, **details: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    def __reduce__(self):
        return (_restore, (self.code, self.message, self.details))


def _restore(code: str, message: str, details: dict) -> IngestionError:
    return IngestionError(code, message, **details)


@dataclass(frozen=True)
class FileFacts:
    """What is known of a file before its rows are read."""

    path: str
    file_format: str
    size_bytes: int
    encoding: str | None
    delimiter: str | None
    worksheet: str | None
    worksheets: tuple[str, ...]
    headers: tuple[str, ...]


def detect_format(path: str, c: IngestionConfig) -> str:
    """csv or xlsx by the name's end, where enabled."""
    end = Path(path).suffix.lower()
    if end not in (".csv", ".xlsx"):
        raise IngestionError("unsupported_file_type", f"{end or 'no suffix'} isn't read")
    kind = end[1:]
    if not (c.csv_enabled if kind == "csv" else c.xlsx_enabled):
        raise IngestionError(f"{kind}_disabled", f"{kind} files are switched off")
    return kind


def read_bytes(path: str, c: IngestionConfig) -> bytes:
    p = Path(path)
    if not p.is_file():
        raise IngestionError("file_not_found", str(p))
    size = p.stat().st_size
    if size > c.max_bytes:
        raise IngestionError("file_too_large", f"{size} bytes; {c.max_bytes} are allowed", size=size)
    if size == 0 and c.empty_file == "error":
        raise IngestionError("empty_file", str(p))
    return p.read_bytes()


def decode(raw: bytes, c: IngestionConfig) -> tuple[str, str]:
    """(text, encoding): the first encoding of the list that fits."""
    for e in c.encodings:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    raise IngestionError("encoding_error", "no listed encoding fits")


def outside_quotes(line: str, mark: str) -> int:
    n, inside = 0, False
    for ch in line:
        if ch == '"':
            inside = not inside
        elif ch == mark and not inside:
            n += 1
    return n


def detect_delimiter(text: str, c: IngestionConfig) -> str:
    """The delimiter that stands equally often, and at least once, in each of the first non-blank lines; a tie is an error, none means the first."""
    lines: list[str] = []
    for line in io.StringIO(text):
        if line.strip():
            lines.append(line)
        if len(lines) == c.sample_lines:
            break
    fits = {d: outside_quotes(lines[0], d) for d in c.delimiters if lines and outside_quotes(lines[0], d) and len({outside_quotes(x, d) for x in lines}) == 1}
    if not fits:
        return c.delimiters[0]
    best = [d for d, n in fits.items() if n == max(fits.values())]
    if len(best) > 1:
        raise IngestionError("delimiter_detection_error", f"{best} fit equally well")
    return best[0]


def check_headers(row: list[str] | None, c: IngestionConfig) -> list[str]:
    if row is None:
        raise IngestionError("missing_header", "the file has no header")
    names = [h.strip() for h in row]
    if len(names) > c.max_columns:
        raise IngestionError("column_limit_exceeded", f"{len(names)} columns; {c.max_columns} are allowed")
    if not names:
        raise IngestionError("missing_header", "the header is empty")
    if c.blank_header_cell == "error" and not all(names):
        raise IngestionError("blank_header_cell", "a header cell is blank")
    seen: set[str] = set()
    twice = sorted({n for n in names if n in seen or seen.add(n)})
    if twice and c.duplicate_header == "error":
        raise IngestionError("duplicate_header", ", ".join(twice), headers=twice)
    return names


def open_quote(text: str) -> bool:
    """Whether a quote is open at the end, every quote counting and doubled ones closing themselves."""
    return text.count('"') % 2 == 1


Row = tuple[int, list[str | None], str | None, str | None]


def csv_rows(text: str, delimiter: str, width: int, c: IngestionConfig) -> Iterator[Row]:
    """(row_number, cells, reason_code, message) after the header; row numbers count records, the header being 1."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    try:
        next(reader, None)
        held: list[str] | None = None
        number = 1
        for row in reader:
            if held is not None:
                number += 1
                yield _route(number, held, width, False, c)
            held = row
            if number > c.max_rows:
                raise IngestionError("row_limit_exceeded", f"more than {c.max_rows} rows")
        if held is not None:
            if number + 1 > c.max_rows + 1:
                raise IngestionError("row_limit_exceeded", f"more than {c.max_rows} rows")
            yield _route(number + 1, held, width, open_quote(text), c)
    except csv.Error as e:
        raise IngestionError("csv_parse_error", str(e)) from e


def _route(number: int, row: list[str], width: int, is_open: bool, c: IngestionConfig) -> Row:
    if is_open:
        return number, list(row), "unclosed_quote", "a quote is never closed"
    if not any(x.strip() for x in row):
        return number, list(row), "entirely_blank_row", "no cell has content"
    if len(row) != width:
        if c.malformed_row != "reject":
            raise IngestionError("malformed_row", f"row {number} has {len(row)} cells, {width} are expected")
        return number, list(row), "inconsistent_column_count", f"{len(row)} cells, {width} expected"
    return number, [x or None for x in row], None, None


# --- spreadsheets -----------------------------------------------------------------------------------------------------

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Workbook:
    """Cell values of an .xlsx file, read from its XML parts; formulas give their last value."""

    def __init__(self, raw: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            raise IngestionError("workbook_error", str(e)) from e
        self.sheets = {s.get("name"): rels[s.get(f"{_R}id")] for s in book.iter(f"{_M}sheet")}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            root = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
            self.shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in root.iter(f"{_M}si")]

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        target = self.sheets[sheet]
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        last = 0
        with self.zip.open(name) as f:
            for _, el in ElementTree.iterparse(f):
                if el.tag != f"{_M}row":
                    continue
                at = int(el.get("r") or last + 1)
                for _ in range(last + 1, at):  # rows without cells aren't stored
                    yield []
                last = at
                cells: list[str | None] = []
                for cell in el.iter(f"{_M}c"):
                    ref = cell.get("r")
                    column = self._column(ref) if ref else len(cells)
                    cells += [None] * (column - len(cells))
                    cells.append(self._value(cell))
                yield cells
                el.clear()

    @staticmethod
    def _column(ref: str) -> int:
        n = 0
        for ch in ref:
            if not ch.isalpha():
                break
            n = n * 26 + ord(ch.upper()) - 64
        return n - 1

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in cell.iter(f"{_M}t"))
        else:
            v = cell.find(f"{_M}v")
            text = "" if v is None or v.text is None else v.text
            if kind == "s" and text:
                text = self.shared[int(text)]
            elif kind == "b" and text:
                text = "True" if text == "1" else "False"
        return text.strip() or None


def pick_sheet(book: Workbook, wanted: str | None, c: IngestionConfig) -> str:
    names = list(book.sheets)
    if wanted is None and c.worksheet_policy == "explicit":
        raise IngestionError("worksheet_not_found", "a worksheet must be named")
    if wanted is not None and wanted not in names or not names:
        raise IngestionError("worksheet_not_found", str(wanted), worksheets=names)
    return wanted or names[0]


def xlsx_rows(book: Workbook, sheet: str, width: int, c: IngestionConfig) -> Iterator[Row]:
    """As csv_rows(); here the width is looked at before blankness, and short rows are filled up with nulls."""
    accepted = 0
    for number, row in enumerate(book.rows(sheet), 1):
        if number == 1:
            continue
        while len(row) > width and row[-1] is None:
            row.pop()
        if len(row) > width:
            yield number, row, "inconsistent_column_count", f"{len(row)} cells, {width} expected"
        elif not any(row):
            yield number, row, "entirely_blank_row", "no cell has content"
        else:
            accepted += 1
            if accepted > c.max_rows:
                raise IngestionError("row_limit_exceeded", f"more than {c.max_rows} rows")
            yield number, row + [None] * (width - len(row)), None, None


def inspect(path: str, c: IngestionConfig, worksheet: str | None = None) -> FileFacts:
    """Format, encoding, delimiter or sheet, and checked headers."""
    c.check()
    if not Path(path).exists():
        raise IngestionError("file_not_found", path)
    kind = detect_format(path, c)
    raw = read_bytes(path, c)
    if kind == "xlsx":
        book = Workbook(raw)
        sheet = pick_sheet(book, worksheet, c)
        head = next(book.rows(sheet), None)
        while head and head[-1] is None:
            head.pop()
        return FileFacts(path, kind, len(raw), None, None, sheet, tuple(book.sheets), tuple(check_headers(None if not head else [x or "" for x in head], c)))
    text, encoding = decode(raw, c)
    if not text.strip():
        return FileFacts(path, kind, len(raw), encoding, c.delimiters[0], None, (), ())
    d = detect_delimiter(text, c)
    try:
        head = next(csv.reader(io.StringIO(text, newline=""), delimiter=d), None)
    except csv.Error as e:
        raise IngestionError("csv_parse_error", str(e)) from e
    return FileFacts(path, kind, len(raw), encoding, d, None, (), tuple(check_headers(head, c)))


def file_rows(facts: FileFacts, c: IngestionConfig) -> Iterator[Row]:
    raw = read_bytes(facts.path, c)
    if facts.file_format == "xlsx":
        yield from xlsx_rows(Workbook(raw), facts.worksheet or "", len(facts.headers), c)
    elif facts.headers:
        yield from csv_rows(raw.decode(facts.encoding or "utf-8"), facts.delimiter or ",", len(facts.headers), c)


class _Part(InputPartition):
    def __init__(self, facts: FileFacts):
        self.facts = facts


class _Reader(DataSourceReader):
    def __init__(self, facts: list[FileFacts], config: IngestionConfig):
        self.facts, self.config = facts, config

    def partitions(self):
        return [_Part(f) for f in self.facts]

    def read(self, partition):
        for number, cells, reason, message in file_rows(partition.facts, self.config):
            yield partition.facts.path, number, cells, reason, message


class RecordFiles(DataSource):
    """``spark.read.format("record_files").load(path)``: path, row_number, raw_values, reason_code, message. Option ``worksheet`` names a sheet; several paths are parted by a line break."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "path string, row_number int, raw_values array<string>, reason_code string, message string"

    def reader(self, schema):
        c = IngestionConfig()
        paths = [p for p in self.options["path"].split("\n") if p]
        return _Reader([inspect(p, c, self.options.get("worksheet")) for p in paths], c)


@dataclass
class ParsedDataset:
    """Accepted rows (row_number and a column for each header), rejected rows and parse issues of a file."""

    facts: FileFacts
    accepted: DataFrame
    rejected: DataFrame
    issues: DataFrame

    @property
    def headers(self) -> tuple[str, ...]:
        return self.facts.headers

    def accounting(self) -> DataFrame:
        return row_accounting(self.accepted, self.rejected)


def parse_file(spark: SparkSession, path: str, config: IngestionConfig | None = None, worksheet: str | None = None) -> ParsedDataset:
    """Reads a file; errors that concern the whole file are raised here, as IngestionError."""
    c = (config or IngestionConfig()).check()
    facts = inspect(path, c, worksheet)
    if config is None:
        spark.dataSource.register(RecordFiles)
        reader = spark.read.format("record_files")
        rows = (reader.option("worksheet", worksheet) if worksheet else reader).load(path).drop("path")
    else:
        schema = "row_number int, raw_values array<string>, reason_code string, message string"

        def read(parts):
            import pandas as pd

            for _ in parts:
                yield pd.DataFrame(list(file_rows(facts, c)), columns=["row_number", "raw_values", "reason_code", "message"])

        rows = spark.range(1, numPartitions=1).mapInPandas(read, schema)
    return from_rows(facts, rows)


def from_rows(facts: FileFacts, rows: DataFrame) -> ParsedDataset:
    ok = rows.where("reason_code IS NULL")
    accepted = ok.select("row_number", *(F.get("raw_values", F.lit(i)).alias(h) for i, h in enumerate(facts.headers)))
    rejected = rows.where("reason_code IS NOT NULL").select("row_number", "raw_values", "reason_code", "message")
    warn = rejected.where("reason_code <> 'entirely_blank_row'").select(F.col("reason_code").alias("code"), "message", F.lit("warning").alias("severity"), "row_number")
    return ParsedDataset(facts, accepted, rejected, warn)


def inline_dataset(spark: SparkSession, headers: list[str], rows: list[list[str | None]]) -> ParsedDataset:
    """A dataset of rows given in the program; row numbers begin at 2, short rows are filled up with nulls."""
    data = [(i, [*(r or []), *[None] * (len(headers) - len(r))], None, None) for i, r in enumerate(rows, 2)]
    df = spark.createDataFrame(data, "row_number int, raw_values array<string>, reason_code string, message string")
    return from_rows(FileFacts("", "inline", 0, None, None, None, (), tuple(headers)), df)
