"""Readers of the formats that the data arrives in. Files land in a folder first; nothing is fetched."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- rows of JSON and text -------------------------------------------------------------------


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; lines that aren't are kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def manifest_jsonl(spark: SparkSession, root: str, manifest: DataFrame, schema: str) -> DataFrame:
    """Chunks (gzip or plain) named by a manifest: path, sha256, rows. Raises if a hash or a count is wrong.

    Hashes are checked on the executors; only the names of faulty chunks come back, and
    the driver raises if there are any.
    """
    paths = [f"{root}/{r['path']}" for r in manifest.select("path").collect()]
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    named = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "rows")
    rows = jsonl(spark, paths, schema).withColumn("_name", F.col("_metadata.file_name"))
    counts = rows.groupBy(F.col("_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    bad = named.join(files, "name", "left").join(counts, "name", "left").where("NOT (sha256 <=> found) OR rows != coalesce(n, 0)").select("name").limit(20).collect()
    if bad:
        raise ValueError(f"chunks that don't match the manifest: {sorted(r['name'] for r in bad)}")
    return rows.drop("_name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number in their file, from 1.

    A file's blocks are numbered each by itself and begin where the blocks before them end,
    so a large file is never in one task.
    """
    from pyspark.sql import Window

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = text.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return inside.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("k")).cast("long").alias("line"), "value")


def ledger_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV ledger with a strict header: the columns, ``line_no``, ``line_hash`` (SHA-256 of the line) and ``bad``.

    ``bad`` marks lines that don't parse; empty fields are null, blank lines are left out.
    Raises if the first line of a file isn't the header as given.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    lines = numbered_lines(spark, path)
    wrong = lines.where("line = 1").where(F.regexp_replace(F.trim("value"), "^\ufeff", "") != ",".join(names)).limit(1).collect()
    if wrong:
        raise ValueError(f"unexpected header: {wrong[0]['value']}")
    body = lines.where("line > 1 AND trim(value) != ''")
    parsed = F.from_csv(F.col("value"), f"{columns}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return body.select(F.col("line").alias("line_no"), F.sha2("value", 256).alias("line_hash"), parsed.alias("r")).select("r.*", "line_no", "line_hash").withColumn("bad", F.col("_corrupt").isNotNull()).drop("_corrupt")


# ---- tables of public sources -----------------------------------------------------------------


def dated_csv(spark: SparkSession, path: str, *, value: str, date: str = "DATE", null: str = ".", pattern: str = "yyyy-MM-dd", keep: tuple[str, ...] = ()) -> DataFrame:
    """(date, value) of a CSV with a header; the sentinel for missing is null, other text is dropped.

    ``keep``: further columns, as those that the folders of many series are named by.
    """
    raw = spark.read.option("header", True).option("nullValue", null).csv(path)
    return raw.select(*keep, F.try_to_timestamp(F.col(f"`{date}`"), F.lit(pattern)).cast("date").alias("date"), F.col(f"`{value}`").try_cast("double").alias("value")).where("date IS NOT NULL")


def vix_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Daily index levels dated MM/DD/YYYY."""
    return dated_csv(spark, path, value="CLOSE", pattern="MM/dd/yyyy", keep=keep)


def ohlcv_csv(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Daily bars; rows without a date or a close are dropped, other text is null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*keep, F.col("Date").try_cast("date").alias("date"), *(F.col(c).try_cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume"))).where("date IS NOT NULL AND close IS NOT NULL")


def seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small dimension in CSV with the header and types given; a row of another shape fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def yields_xml(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Entries of a feed: ``NEW_DATE`` and the named yields."""
    raw = spark.read.format("xml").option("rowTag", "m:properties").schema("`d:NEW_DATE` string, " + ", ".join(f"`d:{tag}` string" for tag in fields.values())).load(path)
    return raw.select(F.to_date(F.substring("d:NEW_DATE", 1, 10)).alias("date"), *(F.col(f"`d:{tag}`").try_cast("double").alias(name) for name, tag in fields.items()))


def monthly_block(text: str, missing: float = -99.99) -> list[tuple[str, list[float | None]]]:
    """The monthly block of a factor file: six-digit rows up to the first row that is none; sentinels are null."""
    out, begun = [], False
    for line in text.splitlines():
        cells = [c.strip() for c in line.split(",")]
        if re.fullmatch(r"\d{6}", cells[0]):
            begun = True
            values = [float(c) for c in cells[1:] if c]
            out.append((f"{cells[0][:4]}-{cells[0][4:]}-01", [None if v <= missing else v for v in values]))
        elif begun:
            break
    return out


def zipped_factors(spark: SparkSession, path: str) -> DataFrame:
    """(path, date, values): monthly rows of the first CSV in each zip file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next(m for m in z.namelist() if m.lower().endswith(".csv"))
                    block = monthly_block(z.read(member).decode("latin-1"))
                yield pd.DataFrame({"path": name, "date": [d for d, _ in block], "values": [v for _, v in block]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, date string, values array<double>").withColumn("date", F.col("date").cast("date"))


# ---- nested JSON ---------------------------------------------------------------------------


def parallel_arrays(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """JSON with arrays side by side -> one row per position."""
    schema = "struct<" + ",".join(f"{k}:array<{v}>" for k, v in fields.items()) + ">"
    return df.withColumn("_j", F.from_json(text, schema)).select(*(c for c in df.columns if c != text), F.explode(F.arrays_zip(*(F.col(f"_j.{k}").alias(k) for k in fields))).alias("_r")).select(*(c for c in df.columns if c != text), "_r.*")


def company_facts(df: DataFrame, text: str, *, as_of: str, forms: tuple[str, ...] = ("10-Q", "10-K"), keep: int = 8) -> DataFrame:
    """The last revision of each period filed by ``as_of``, the ``keep`` latest periods per company."""
    from pyspark.sql import Window

    unit = "array<struct<start:string,end:string,val:double,form:string,filed:string,accn:string>>"
    rows = df.withColumn("_j", F.from_json(text, f"struct<cik:bigint,units:struct<USD:{unit}>>")).select("_j.cik", F.explode("_j.units.USD").alias("u")).select("cik", "u.*")
    seen = rows.where(F.col("form").isin(*forms) & (F.col("filed") <= as_of))
    last = seen.groupBy("cik", "start", "end").agg(F.max(F.struct("filed", "accn", "val", "form")).alias("r"))
    k = F.row_number().over(Window.partitionBy("cik").orderBy(F.col("end").desc(), F.col("start").desc()))
    return last.withColumn("_k", k).where(F.col("_k") <= keep).select("cik", "start", "end", "r.val", "r.form", "r.filed")


def tall(wide: DataFrame, ids: list[str], pattern: str, name: str) -> DataFrame:
    """Columns whose name matches -> rows with the matched part in ``name``; nulls give no row."""
    columns = [c for c in wide.columns if c not in ids and re.fullmatch(pattern, c)]
    long = wide.unpivot(ids, columns, name, "value")
    return long.withColumn(name, F.regexp_extract(name, pattern, 1)).where("value IS NOT NULL")


def vintages(wide: DataFrame, series: str) -> DataFrame:
    """ALFRED's wide form (date, SERIES_YYYYMMDD ...) -> observations with the period each vintage stood.

    A vintage stands until the day before the next one that has a value for the date.
    """
    from pyspark.sql import Window

    long = tall(wide, ["date"], rf"{re.escape(series)}_(\d{{8}})", "v").select("date", F.to_date("v", "yyyyMMdd").alias("realtime_start"), F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")
    return long.withColumn("realtime_end", F.date_sub(F.lead("realtime_start").over(Window.partitionBy("date").orderBy("realtime_start")), 1))


# ---- records in text files -------------------------------------------------------------------


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The ``key: value`` block between two ``---`` lines at the top, and the rest."""
    lines = text.lstrip("\ufeff").splitlines()
    if not lines or lines[0].strip() != "---":
        return {}, text
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if end is None:
        return {}, text
    pairs = (line.split(":", 1) for line in lines[1:end] if ":" in line and not line.startswith((" ", "#", "-")))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, "\n".join(lines[end + 1 :]).strip()


def parse_records(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, fields, body) of a column of texts with front matter; a null text has no fields and a null body."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [front_matter(t) if t is not None else ({}, None) for t in batch["value"]]
            yield pd.DataFrame({"path": batch["path"], "fields": [json.dumps(f, ensure_ascii=False) for f, _ in found], "body": [b for _, b in found]})

    raw = df.select(F.col(path).cast("string").alias("path"), F.col(text).alias("value"))
    return raw.mapInPandas(parse, "path string, fields string, body string").withColumn("fields", F.from_json("fields", "map<string,string>"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields, body) of text files with front matter; unknown keys are kept."""
    return parse_records(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")), "path", "value")


# ---- tables in pages ---------------------------------------------------------------------------


class _Cells(HTMLParser):
    """Collects the cells of each table of a page, by row; tables within cells count by themselves."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[str]]] = []
        self.open: list[tuple[int, list[str] | None]] = []
        self.seen, self.text = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append((self.seen, None))
            self.seen += 1
        elif tag == "tr" and self.open:
            self.open[-1] = (self.open[-1][0], [])
        elif tag in ("td", "th"):
            self.text = []

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.open and self.open[-1][1] is not None:
            self.open[-1][1].append(" ".join("".join(self.text).split()))
        elif tag == "tr" and self.open and self.open[-1][1]:
            self.rows.append((self.open[-1][0], self.open[-1][1]))
            self.open[-1] = (self.open[-1][0], None)
        elif tag == "table" and self.open:
            self.open.pop()


def table_cells(html: str) -> list[tuple[int, int, list[str]]]:
    """(table, row, cells) of a page, both counted from 0; entities are read, blanks are put together."""
    parser = _Cells()
    parser.feed(html)
    counts: dict[int, int] = {}
    out = []
    for table, cells in parser.rows:
        out.append((table, counts.get(table, 0), cells))
        counts[table] = counts.get(table, 0) + 1
    return out


def html_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, row, cells) of the tables in HTML files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = table_cells(bytes(content).decode("utf-8", "replace"))
                if found:
                    yield pd.DataFrame({"path": name, "table": [t for t, _, _ in found], "row": [r for _, r, _ in found], "cells": [c for _, _, c in found]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, table int, row int, cells array<string>")


# ---- workbooks and registries ------------------------------------------------------------------


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a worksheet (the first, or by name) as text; gaps are null."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{main}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        sheets = {s.get("name"): s.get(link) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        wanted = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        body = ElementTree.fromstring(z.read("xl/" + targets[wanted].lstrip("/").removeprefix("xl/")))
    out = []
    for row in body.iter(f"{main}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{main}c"):
            at = 0
            for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                at = at * 26 + ord(letter) - 64
            value = c.find(f"{main}v")
            text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{main}t")) or None
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            cells += [None] * (at - 1 - len(cells)) + [text]
        out.append(cells)
    return out


def workbook_bytes(rows: list[list], sheet: str = "data") -> bytes:
    """A workbook of one sheet; numbers as numbers, the rest as text, nulls as gaps."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def name(k: int) -> str:
        out = ""
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(at: str, value) -> str:
        if isinstance(value, int | float) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{name(k)}{n}", v) for k, v in enumerate(row, 1) if v is not None) + "</row>" for n, row in enumerate(rows, 1))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in parts.items():
            z.writestr(part, text)
    return buffer.getvalue()


def workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, row, cells) of the worksheets of .xlsx files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                cells = sheet_rows(content, sheet)
                if cells:
                    yield pd.DataFrame({"path": name, "row": range(len(cells)), "cells": cells})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row int, cells array<string>")


def registry(spark: SparkSession, path: str, schema: str, root: str = "questions") -> DataFrame:
    """The list under ``root`` of a YAML file, one row per entry; a small file, read on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML registries need the yaml package") from e
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    entries = (yaml.safe_load(text) or {}).get(root) or []
    text = spark.createDataFrame([(json.dumps(e, default=str, ensure_ascii=False),) for e in entries], "j string")
    return text.select(F.from_json("j", f"struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>").alias("r")).select("r.*")
