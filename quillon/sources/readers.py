"""Readers: strict CSV, JSON and XLSX as text columns with row ids, samples, HTML tables, encoded payloads."""

from __future__ import annotations

import csv
import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ordered import marked, running, written

MAX_BYTES = 25 * 1024 * 1024


class Refused(ValueError):
    """The input breaks a stated rule; nothing of it is used."""


def headers(names: Sequence[str | None], rename: bool = False) -> list[str]:
    """Trimmed names; empty and repeated ones are refused, or renamed by place and count."""
    out: list[str] = []
    for place, raw in enumerate(names, 1):
        name = (raw or "").strip()
        if not name or name in out:
            if not rename:
                raise Refused(f"column {place} has {'no name' if not name else 'the name of another'}")
            base, k = name or f"column_{place}", 2
            name = base
            while name in out:
                name, k = f"{base}__{k}", k + 1
        out.append(name)
    return out


def number_rows(df: DataFrame) -> DataFrame:
    """Dense row ids from 1 in the table's order. The rows are written with their task and place in it first, so all later steps see the same."""
    return running(marked(df), F.lit(1)).withColumn("row_id", F.col("sum_") + 1).drop("chunk_", "at_", "sum_")


@dataclass(frozen=True)
class Csv:
    """Good rows (``row_id`` and text columns), rejects (``row_id, original, reason``) and counts of what was skipped."""

    table: DataFrame
    rejects: DataFrame
    blank_lines: int
    ragged_rows: int


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", ragged: str = "refuse", rename: bool = False) -> Csv:
    """Strict CSV in parallel: the separator is stated, never sniffed, and quotes may hold separators and line ends.

    Physical lines are read in splits and numbered. A line begins a record if an even number of quotes stands before it, which is
    a running sum; records are then parsed one by one. Blank records are skipped and counted, an empty cell is null, and a record
    with more or fewer cells than the header refuses the file, or is set aside with ``ragged="reject"``. Numbers count all records.
    """
    if ragged not in ("refuse", "reject"):
        raise ValueError("ragged is refuse or reject")
    lines = spark.read.option("encoding", encoding).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at_"))
    lines = written(lines.select("value", F.struct("file", "start").alias("chunk_"), "at_"))
    quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    wrong = lines.agg(F.count_if(~F.is_valid_utf8(F.col("value").cast("binary"))).alias("bytes"), F.count_if(F.contains("value", F.lit("\x00"))).alias("nul"), F.sum(quotes).alias("quotes")).first()
    if wrong["bytes"] or wrong["nul"]:
        raise Refused("the file is not text in the stated encoding")
    if (wrong["quotes"] or 0) % 2:
        raise Refused("a quote is not closed")
    parts = written(running(lines, quotes % 2).withColumn("begins", (F.col("sum_") % 2 == 0).cast("int")).drop("sum_"))
    numbered = running(parts, F.col("begins")).withColumn("record", F.col("sum_") + F.col("begins"))
    if parts.filter("begins = 0").isEmpty():
        records = numbered.select("record", F.col("value").alias("text"))
    else:
        records = numbered.groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_", "at_", "value"))), lambda p: p["value"]), "\n").alias("text"))
    records = written(records)
    first = records.filter("text <> ''").orderBy("record").first()
    if first is None:
        raise Refused("no header row")
    cells = next(csv.reader([first["text"]], delimiter=sep, strict=True)) if "\n" not in first["text"] else next(csv.reader(io.StringIO(first["text"], newline=""), delimiter=sep, strict=True))
    if len(cells) == 1 and sep == "," and any(c in cells[0] for c in ";\t"):
        raise Refused("the header is one cell with another separator in it; state the separator")
    names = headers(cells, rename)
    body = records.filter(F.col("record") > first["record"]).select((F.col("record") - first["record"]).alias("row_id"), "text")
    schema = ", ".join([*(f"`c{k}` string" for k in range(len(names))), "broken_ string"])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"}
    parsed = body.filter("text <> ''").withColumn("r", F.from_csv("text", schema, options))
    blank = body.filter("text = ''").count()
    bad = parsed.filter("r.broken_ is not null").select("row_id", F.col("text").alias("original"), F.lit("RAGGED_ROW").alias("reason"))
    n_bad = bad.count()
    if n_bad and ragged == "refuse":
        raise Refused("a row has more or fewer cells than the header")
    good = parsed.filter("r.broken_ is null").select("row_id", *[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])
    return Csv(good, bad, blank, n_bad)


def read_columns(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), most_rows: int = 1_000_000, most_chars: int = 10_000) -> DataFrame:
    """A CSV with all of the required columns and no others than the optional ones (null where absent); any other shape refuses the file."""
    table = read_csv(spark, path).table
    have = [c for c in table.columns if c != "row_id"]
    if absent := [c for c in required if c not in have]:
        raise Refused(f"no column {', '.join(absent)}")
    if other := [c for c in have if c not in (*required, *optional)]:
        raise Refused(f"unknown column {', '.join(other)}")
    found = table.agg(F.count("*").alias("n"), F.max(F.greatest(F.lit(0), *[F.length(F.coalesce(f"`{c}`", F.lit(""))) for c in have])).alias("longest"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"no_{k}") for k, c in enumerate(required)]).first()
    if not found["n"] or found["n"] > most_rows or found["longest"] > most_chars:
        raise Refused("no rows, too many rows, or a cell that is too long")
    if empty := [c for k, c in enumerate(required) if found[f"no_{k}"]]:
        raise Refused(f"{', '.join(empty)} lacks a value")
    return table.select("row_id", *required, *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in optional])


def _flat(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise Refused("a key occurs twice in an object")
    for k, v in pairs:
        if isinstance(v, dict | list):
            raise Refused(f"{k} holds a nested value")
        if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
            raise Refused(f"{k} is beyond 64 bits")
    return dict(pairs)


def parse_json_table(text: str) -> tuple[list[str], list[dict]]:
    """An array of flat objects: all keys in first-seen order, and the objects."""

    def refuse(x):
        raise Refused(f"{x} is not a JSON number")

    rows = json.loads(text, object_pairs_hook=_flat, parse_constant=refuse)
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise Refused("not an array of objects")
    return list(dict.fromkeys(k for r in rows for k in r)), rows


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One bounded file, checked on the way in."""
    text = _bounded(spark, path).decode("utf-8-sig")
    names, rows = parse_json_table(text)
    cells = [[None if r.get(n) is None else r[n] if isinstance(r[n], str) else json.dumps(r[n]) for n in names] for r in rows]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(cells, 1)], T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]))


def _bounded(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path).select("length", "path").first()
    if found["length"] > MAX_BYTES:
        raise Refused("the file is larger than the limit")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def check_archive(data: bytes, members: int = 1000, ratio: int = 200, total: int = 200 * 1024 * 1024) -> zipfile.ZipFile:
    """A zip that does not unfold beyond stated bounds and holds no macro."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    infos = archive.infolist()
    if len(infos) > members or sum(i.file_size for i in infos) > total:
        raise Refused("the archive is too large")
    for i in infos:
        if i.file_size > ratio * max(1, i.compress_size) or "vbaProject" in i.filename or i.filename.lower().endswith((".zip", ".xlsx")):
            raise Refused(f"{i.filename} is not allowed")
    return archive


def visible_sheets(archive: zipfile.ZipFile) -> list[str]:
    """The parts of the sheets that are not hidden, in the workbook's order."""
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    parts = {link.get("Id"): link.get("Target", "") for link in links}
    shown = [next((v for k, v in s.items() if k.endswith("}id")), "") for s in book.iter() if s.tag.endswith("}sheet") and s.get("state", "visible") == "visible"]
    found = [parts[i].lstrip("/") if parts[i].startswith("/") else f"xl/{parts[i]}" for i in shown if i in parts]
    if not found:
        raise Refused("no sheet is visible")
    return found


def workbook_notes(archive: zipfile.ZipFile) -> dict[str, int]:
    """What a reader should know: hidden sheets, merged ranges of the sheet read, and whether days count from 1904."""
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    sheet = ElementTree.fromstring(archive.read(visible_sheets(archive)[0]))
    states = [s.get("state", "visible") for s in book.iter() if s.tag.endswith("}sheet")]
    epoch = [p.get("date1904") in ("1", "true") for p in book.iter() if p.tag.endswith("}workbookPr")]
    return {"hidden_sheets": sum(s != "visible" for s in states), "merged_ranges": sum(m.tag.endswith("}mergeCell") for m in sheet.iter()), "from_1904": int(any(epoch))}


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first visible sheet's cached values as text."""
    archive = check_archive(_bounded(spark, path))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{space}si")]
    sheet = visible_sheets(archive)[0]
    table = []
    for row in ElementTree.fromstring(archive.read(sheet)).iter(f"{space}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{space}c"):
            letters = "".join(c for c in cell.get("r", "") if c.isalpha())
            place = 0
            for c in letters:
                place = place * 26 + ord(c) - 64
            place = place or max(cells, default=-1) + 2  # a cell without a reference follows the one before
            value, kind = cell.find(f"{space}v"), cell.get("t")
            inline = "".join(t.text or "" for t in cell.iter(f"{space}t"))
            cells[place - 1] = inline if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
        table.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    names = headers(table[0])
    width = len(names)
    rows = [(i, *(r + [None] * width)[:width]) for i, r in enumerate(table[1:], 1)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)]))


@dataclass(frozen=True)
class Opened:
    """A whole table, what it was read from, and what was set aside."""

    table: DataFrame
    name: str
    size_bytes: int
    sha256: str
    rejects: DataFrame | None = None
    blank_lines: int = 0


def open_table(spark: SparkSession, path: str, most: int = MAX_BYTES, **how) -> Opened:
    """By extension: CSV, JSON or XLSX of at most ``most`` bytes, with its digest; nothing is ever used in part."""
    name = path.rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind not in ("csv", "json", "xlsx"):
        raise Refused(f"{kind or 'no'} kind of file: csv, json or xlsx is read")
    files = spark.read.format("binaryFile").load(path)
    size = files.select("length").first()["length"]
    if size > most:
        raise Refused(f"{size} bytes are more than {most}")
    digest = files.select(F.sha2("content", 256).alias("d")).first()["d"]
    if kind == "csv":
        found = read_csv(spark, path, **how)
        return Opened(found.table, name, size, digest, found.rejects, found.blank_lines)
    return Opened({"json": read_json, "xlsx": read_xlsx}[kind](spark, path), name, size, digest)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed: those with the least keyed digests, in key order."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n).orderBy(key)


def open_within(df: DataFrame, key: str, whole: int, most: int, sample: int, seed: int = 0) -> tuple[DataFrame, str]:
    """The table itself up to ``whole`` rows, a uniform sample of it up to ``most``; beyond that it is refused."""
    rows = df.count()
    if rows > most:
        raise Refused("the table is larger than the limit")
    return (df, "whole") if rows <= whole else (uniform_sample(df, key, sample, seed), "sample")


def read_registry(spark: SparkSession, path: str, columns: Sequence[str], rules: dict[str, Column], key: str) -> DataFrame:
    """A CSV of rules or entries: exactly these columns, every row within every rule, no key twice; else refused."""
    rows = read_csv(spark, path).table.drop("row_id")
    if rows.columns != list(columns):
        raise Refused(f"the columns are not {', '.join(columns)}")
    broken = rows.select([F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    if named := [name for name in rules if broken[name]]:
        raise Refused(f"rows break {', '.join(named)}")
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise Refused(f"{key} occurs twice")
    return rows


class TableParser(HTMLParser):
    """Rows of cells of each table, each cell with whether it heads its column; nested or merged ones get a reason."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.row, self.cell, self.mute = [], [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            if self.open:
                self.open[-1]["reason"] = "NESTED"
            self.open.append({"rows": [], "reason": None})
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self.row = []
        elif self.row is not None and tag in ("td", "th"):
            if {"colspan", "rowspan"} & {k for k, v in attrs if v not in (None, "", "1")}:
                self.open[-1]["reason"] = self.open[-1]["reason"] or "MERGED"
            self.cell = (tag == "th", [])
        elif tag == "br" and self.cell is not None:
            self.cell[1].append(" ")

    def handle_data(self, data):
        if self.cell is not None and not self.mute:
            self.cell[1].append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif tag in ("td", "th") and self.cell is not None:
            if self.row is not None:
                self.row.append((self.cell[0], " ".join("".join(self.cell[1]).split())))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.open and self.row:
                self.open[-1]["rows"].append(self.row)
            self.row = None
        elif tag == "table" and self.open:
            self.open.pop()


def _why_not(rows: list[list[tuple[bool, str]]], longest: int = 10_000) -> str | None:
    """Why rows of cells are no usable table: a header row, then rows as wide as it."""
    if not rows:
        return "EMPTY"
    if not all(heads for heads, _ in rows[0]):
        return "NO_HEADER"
    names = [text for _, text in rows[0]]
    if "" in names:
        return "EMPTY_HEADER"
    if len(set(names)) < len(names):
        return "REPEATED_HEADER"
    if any(len(r) != len(names) for r in rows):
        return "RAGGED"
    if len(rows) == 1:
        return "NO_ROWS"
    return "LONG_CELL" if any(len(text) > longest for r in rows for _, text in r) else None


def tables_in(html: str, most: int = 200) -> list[dict]:
    """Each of the first ``most`` tables in the order of the page as ``rows`` (header first) and ``reason``: why it can't be used, or null."""
    parser = TableParser()
    parser.feed(html or "")
    parser.close()
    return [{"rows": [[text for _, text in r] for r in t["rows"]], "reason": t["reason"] or _why_not(t["rows"])} for t in parser.tables[:most]]


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """One row for each table of each page: ``page, table_index, n_rows, n_columns, reason, cells``."""
    schema = f"page {dict(pages.dtypes)[id_col]}, table_index int, n_rows int, n_columns int, reason string, cells array<array<string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (page, i, len(t["rows"]), max(map(len, t["rows"]), default=0), t["reason"], t["rows"])
                for page, html in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for i, t in enumerate(tables_in(html))
            ]
            yield pd.DataFrame(out, columns=["page", "table_index", "n_rows", "n_columns", "reason", "cells"])

    return pages.select(id_col, html_col).mapInPandas(run, schema)


def chosen_table(tables: DataFrame, index: int | None = None, most: int = 10) -> DataFrame:
    """One table of each page of ``html_tables``: the one with this index, or the only usable one; else ``reason`` says why none.

    A page has ``most`` tables at most in a choice; beyond that it must be by index.
    """
    usable = tables.filter(F.col("reason").isNull())
    if index is not None:
        return usable.filter(F.col("table_index") == index).select("page", "table_index", "n_rows", F.lit(None).cast("string").alias("reason"))
    found = tables.groupBy("page").agg(F.count_if(F.col("reason").isNull()).alias("n"), F.min_by("table_index", F.when(F.col("reason").isNull(), F.col("table_index"))).alias("at"), F.min_by("n_rows", F.when(F.col("reason").isNull(), F.col("table_index"))).alias("rows"))
    why = F.when(F.col("n") == 0, "NO_TABLE").when(F.col("n") > most, "TOO_MANY").when(F.col("n") > 1, "AMBIGUOUS")
    return found.select("page", F.when(why.isNull(), F.col("at")).alias("table_index"), F.when(why.isNull(), F.col("rows")).alias("n_rows"), why.alias("reason"))


def coded(df: DataFrame, column: str, codes: dict[str, int], into: str, keys: Sequence[str]) -> DataFrame:
    """The number that a stated code stands for; an unknown code, or a key that occurs twice, is an error."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    value = F.try_element_at(table, F.col(column))
    wrong = F.concat(F.lit("unknown code "), F.coalesce(F.col(column), F.lit("null")))
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise Refused(f"{', '.join(keys)} occurs twice: {twice[0]}")
    return df.withColumn(into, F.when(value.isNotNull(), value).otherwise(F.raise_error(wrong).cast("int")))


def unwrapped(document: Column) -> Column:
    """The one list that a JSON envelope holds, as JSON text; null if there is none, several, or no JSON object."""
    fields = F.from_json(document, "map<string,variant>")
    lists = F.filter(F.map_values(fields), lambda v: F.schema_of_variant(v).startswith("ARRAY"))
    return F.when(F.size(lists) == 1, F.to_json(F.get(lists, 0)))


#: Characters that stand in Python objects at a time.
PORTION = 1_000_000


def _by_portions(values: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """The function over all texts; only a portion of them stands in Python objects, and freed memory goes back to the system."""
    done, part, size = [], [], 0
    for value in values:
        part.append(None if (text := value.as_py()) is None else one(text))
        size += len(text or "")
        if size >= PORTION:
            done.append(pa.array(part, pa.string()))
            part, size = [], 0
    out = pa.concat_arrays([*done, pa.array(part, pa.string())])
    del done, part
    pa.default_memory_pool().release_unused()
    return out


def encode_payloads(df: DataFrame, column: str) -> DataFrame:
    """The inverse of ``decode_payloads``."""

    @F.arrow_udf("string")
    def deflate(values: pa.Array) -> pa.Array:
        return _by_portions(values, lambda text: zlib.compress(text.encode()).decode("latin-1"))

    return df.withColumn(column, deflate(F.col(column)))


def decode_payloads(df: DataFrame, column: str, most: int = 50 * 1024 * 1024) -> DataFrame:
    """Text whose characters are the bytes of a zlib stream, as the text inside; a bounded size each."""

    def one(text: str) -> str:
        stream = zlib.decompressobj()
        data = stream.decompress(text.encode("latin-1"), most)
        if stream.unconsumed_tail:
            raise Refused("the payload is larger than the limit")
        return data.decode()

    @F.arrow_udf("string")
    def inflate(values: pa.Array) -> pa.Array:
        return _by_portions(values, one)

    return df.withColumn(column, inflate(F.col(column)))
