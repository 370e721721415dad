"""Source parsers and envelope checks: CSV and workbook tables, transcripts, page layout, speech, positioned text.

Parsing that must raise on malformed input is a plain function called in batches; envelopes are checked by column expressions.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

LIMITS = {"chars": 5_000_000, "rows": 100_000, "columns": 256, "cell": 32_767}
MOST_BYTES, MOST_RATIO = 200_000_000, 100.0


def csv_table(text: str, limits: dict[str, int] = LIMITS) -> tuple[list[str], list[list[str]]]:
    """Headers and rows; headers are trimmed, not empty and unique in any case, and every row is exactly as wide."""
    if len(text) > limits["chars"]:
        raise ValueError("too many characters")
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), strict=True) if any(c.strip() for c in r)]
    if not rows:
        raise ValueError("no header")
    headers = [h.strip() for h in rows[0]]
    if not all(headers) or len({h.lower() for h in headers}) != len(headers):
        raise ValueError("headers must be unique and not empty")
    if len(headers) > limits["columns"] or len(rows) - 1 > limits["rows"]:
        raise ValueError("too many columns or rows")
    for k, r in enumerate(rows[1:], 2):
        if len(r) != len(headers):
            raise ValueError(f"row {k} has {len(r)} cells, not {len(headers)}")
        if any(len(c) > limits["cell"] for c in r):
            raise ValueError(f"row {k} has a cell that is too long")
    return headers, rows[1:]


def csv_tables(docs: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """memory_id, text -> memory_id, n_columns, n_rows, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for memory, text in zip(pdf["memory_id"], pdf["text"], strict=True):
                try:
                    headers, body = csv_table(text or "", limits)
                    rows.append((memory, len(headers), len(body), None))
                except (ValueError, csv.Error) as e:
                    rows.append((memory, 0, 0, str(e)))
            yield pd.DataFrame(rows, columns=["memory_id", "n_columns", "n_rows", "error"])

    return docs.select("memory_id", "text").mapInPandas(run, "memory_id long, n_columns long, n_rows long, error string")


def safe_archive(data: bytes, most: int = MOST_BYTES, ratio: float = MOST_RATIO) -> zipfile.ZipFile:
    """The archive, if its directory promises no more than the limits."""
    z = zipfile.ZipFile(io.BytesIO(data))
    total = sum(i.file_size for i in z.infolist())
    if total > most or total > ratio * max(1, len(data)):
        raise ValueError("the archive grows beyond the limits")
    return z


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_tables(data: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """name, headers, rows of each sheet that is not empty; formulas by the results stored with them."""
    z = safe_archive(data)
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = rels[sheet.get(_REL)].lstrip("/")
        grid: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row:
                v, kind = c.find("m:v", _NS), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                at = 0
                for ch in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                    at = at * 26 + ord(ch) - 64
                cells[at - 1] = strings[int(text)] if kind == "s" and text else text
            if any(x.strip() for x in cells.values()):
                grid.append([cells.get(k, "") for k in range(max(cells) + 1)])
        if grid:
            width = len(grid[0])
            out.append((sheet.get("name"), [h.strip() for h in grid[0]], [(r + [""] * width)[:width] for r in grid[1:]]))
    return out


def line_blocks(items: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Positioned text to lines: from the top, each item joins the nearest line head within max(2, 0.35 height)."""
    lines: list[dict[str, Any]] = []
    for it in sorted(items, key=lambda i: (-i["y"], i["x"])):
        near = [ln for ln in lines if abs(ln["y"] - it["y"]) <= max(2.0, 0.35 * it["height"])]
        if near:
            min(near, key=lambda ln: abs(ln["y"] - it["y"]))["items"].append(it)
        else:
            lines.append({"y": it["y"], "items": [it]})
    out = []
    for ln in lines:
        own = sorted(ln["items"], key=lambda i: i["x"])
        box = (min(i["x"] for i in own), min(i["y"] for i in own), max(i["x"] + i["width"] for i in own), max(i["y"] + i["height"] for i in own))
        out.append({"text": " ".join(i["text"] for i in own), "bbox": box})
    return out


TRANSCRIPT = T.StructType([T.StructField("schema_version", T.LongType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField("turn_id", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("started_at", T.StringType()), T.StructField("ended_at", T.StringType())])))])
ROLES = ("user", "assistant", "system", "tool", "speaker")


def transcript_errors(docs: DataFrame) -> DataFrame:
    """memory_id, error of the first rule that a transcript (column text, JSON) breaks; null if none."""
    t = F.from_json("text", TRANSCRIPT)
    turns = F.col("t.turns")
    instant = lambda c: F.expr(f"try_to_timestamp({c})")
    n = F.size(turns)
    unique = lambda field: F.size(F.array_distinct(F.transform(turns, lambda x: x[field]))) == n
    late = F.exists(turns, lambda x: F.coalesce(F.try_to_timestamp(x["ended_at"]) < F.try_to_timestamp(x["started_at"]), F.lit(False)))
    bad_time = F.exists(turns, lambda x: x["started_at"].isNotNull() & F.try_to_timestamp(x["started_at"]).isNull())
    error = (
        F.when(F.col("t").isNull() | turns.isNull(), "not_json")
        .when(F.col("t.schema_version") != 1, "schema_version")
        .when(n == 0, "no_turns")
        .when(~unique("turn_id"), "repeated_turn_id")
        .when(~unique("sequence"), "repeated_sequence")
        .when(F.exists(turns, lambda x: ~x["role"].isin(*ROLES)), "role")
        .when(bad_time, "timestamp")
        .when(late, "ends_before_start")
    )
    return docs.select("memory_id", t.alias("t")).select("memory_id", error.alias("error"))


def sequence_errors(rows: DataFrame, key: str, sequence: str, start: str | None = None, end: str | None = None, limit: Column | None = None) -> DataFrame:
    """key, error: sequences must run 1, 2, 3, ...; starts must not fall; ends must not pass their starts' order or the limit."""
    w = W.Window.partitionBy(key).orderBy(sequence)
    checks = F.when(F.col(sequence) != F.row_number().over(w), "sequence_gap")
    if start:
        checks = checks.when(F.col(start) < F.lag(start).over(w), "start_falls")
    if start and end:
        checks = checks.when(F.col(end) < F.col(start), "ends_before_start")
    if end and limit is not None:
        checks = checks.when(F.col(end) > limit, "beyond_duration")
    return rows.select(key, checks.alias("error")).where("error is not null").groupBy(key, "error").agg(F.count(F.lit(1)).alias("n"))


def layout_errors(regions: DataFrame) -> DataFrame:
    """regions: doc, page, region_id, x0, y0, x1, y1, width, height, confidence. doc, error, n."""
    outside = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("width")) | (F.col("y1") > F.col("height")) | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    own = regions.select("doc", F.when(outside, "bbox").when(~F.col("confidence").between(0, 1), "confidence").alias("error")).where("error is not null")
    twice = regions.groupBy("doc", "page", "region_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", F.lit("repeated_region").alias("error"))
    return own.unionByName(twice).groupBy("doc", "error").agg(F.count(F.lit(1)).alias("n"))


def page_gaps(regions: DataFrame) -> DataFrame:
    """doc, first_missing: documents whose pages (doc, page) are not 1, 2, 3, ... without a gap."""
    each = regions.select("doc", "page").distinct().withColumn("_n", F.row_number().over(W.Window.partitionBy("doc").orderBy("page")))
    return each.where("page <> _n").groupBy("doc").agg(F.min("_n").cast("long").alias("first_missing"))


WORKBOOK = "path string, sheet string, n_columns long, n_rows long, error string"


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, n_columns, n_rows, error of the workbooks below a path; one that cannot be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for where, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(where, name, len(headers), len(body), None) for name, headers, body in workbook_tables(bytes(data))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((where, None, 0, 0, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "sheet", "n_columns", "n_rows", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, WORKBOOK)


def text_artifacts(spark: SparkSession, path: str, cited: DataFrame, most: int = 10_000_000) -> DataFrame:
    """Files as strict UTF-8 whose SHA-256 equals the citation (path, digest); others carry an error, those over `most` bytes `too_large`."""
    files = spark.read.format("binaryFile").load(path)
    known = files.select("path", (F.col("length") > most).alias("_large"))
    files = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("_sha"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    rows = cited.join(known, "path", "left").join(files, "path", "left")
    return rows.select("path", "text", F.when(F.col("_large"), "too_large").when(F.col("_sha").isNull(), "missing").when(F.concat(F.lit("sha256:"), "_sha") != F.col("digest"), "digest").when(F.col("text").isNull(), "encoding").alias("error"))


def markdown_corpus(spark: SparkSession, path: str, most: int = 200_000, exclude: str = "/(node_modules|dist)/") -> DataFrame:
    """Whole Markdown files below a path, with the label that the path gives."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.where((F.length("value") <= most) & ~F.col("path").rlike(exclude)).select("path", F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("label"), F.col("value").alias("text"))


def routed(strict: bool, *parsers: tuple[Column, Column], diagnostics: Column | None = None) -> Column:
    """The first parser whose condition holds; strict raises where none does, else the diagnostics stand."""
    out = None
    for holds, parsed in parsers:
        out = F.when(holds, parsed) if out is None else out.when(holds, parsed)
    return out.otherwise(F.raise_error(F.lit("no parser supports this source")) if strict else (F.lit(None) if diagnostics is None else diagnostics))


def watermark(scan: DataFrame) -> DataFrame:
    """Per tenant: SHA-256 over (updated_at, memory_id, version, digest) in scan order.

    Rows are hashed first and combined in blocks of ids, so the list that meets in one task is one hash a block.
    """
    row = F.sha2(F.to_json(F.struct(F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_at"), "memory_id", "version", "digest")), 256)
    blocks = scan.groupBy("tenant_id", F.floor(F.col("memory_id") / 4096).alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("memory_id", row.alias("h")))), lambda x: x["h"]), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("tenant_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), ""), 256).alias("watermark"), F.sum("n").alias("documents"))
