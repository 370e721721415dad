"""Binary objects, positioned PDF text, TypeScript outlines, parser fallbacks, remote parser answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

MOST_OBJECT = 64 << 20


def binary_objects(spark: SparkSession, path: str, cited: DataFrame, most: int = MOST_OBJECT) -> DataFrame:
    """path, content, error of cited objects (path, digest) in any store that Spark reads: content only where the SHA-256 is the cited one.

    Objects above `most` bytes carry an error of their own and are not read whole.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= most).select("path", "content", F.lit(None).cast("string").alias("_large"))
    large = files.where(F.col("length") > most).select("path", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("_large"))
    rows = cited.join(small.unionByName(large), "path", "left")
    error = F.when(F.col("_large").isNotNull(), F.col("_large")).when(F.col("content").isNull(), "missing").when(F.concat(F.lit("sha256:"), F.sha2("content", 256)) != F.col("digest"), "digest")
    return rows.select("path", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


# --- positioned text ---


def line_blocks(items: DataFrame, tolerance: float = 3.0, gap: float = 1.8) -> DataFrame:
    """doc, page, block, text, x0, y0, x1, y1 of positioned text (doc, page, text, x, y, width, height), y growing upwards.

    Items whose baselines differ by at most `tolerance` from the one above are a line, read from left to right; lines that are further apart than `gap`
    times their height begin a new block. All by windows inside a page, so a document of any number of pages is spread.
    """
    down = W.Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x", "text")
    rows = items.where(F.trim("text") != "").withColumn("_new", F.coalesce((F.lag("y").over(down) - F.col("y") > tolerance).cast("int"), F.lit(1)))
    rows = rows.withColumn("_line", F.sum("_new").over(down.rowsBetween(W.Window.unboundedPreceding, 0)))
    lines = rows.groupBy("doc", "page", "_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: F.trim(i["text"])), " ").alias("text"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.max("height").alias("_h"),
    )
    over = W.Window.partitionBy("doc", "page").orderBy("_line")
    far = F.coalesce((F.lag("y0").over(over) - F.col("y0") > gap * F.greatest("_h", F.lag("_h").over(over))).cast("int"), F.lit(1))
    lines = lines.withColumn("_far", far).withColumn("block", F.sum("_far").over(over.rowsBetween(W.Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("doc", "page", "block").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def native_or_recognised(native: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc, text, parser: native text; documents that have none go to `recognise` (doc -> doc, text). Other native errors stay errors.

    native: doc, text, error; only the error `no_extractable_text` asks for recognition.
    """
    empty = native.where(F.col("error") == "no_extractable_text").select("doc")
    read = recognise(empty).select("doc", "text", F.lit("recognised").alias("parser"), F.lit(None).cast("string").alias("error"))
    kept = native.where(F.col("error").isNull() | (F.col("error") != "no_extractable_text")).select("doc", F.when(F.col("error").isNull(), F.col("text")).alias("text"), F.lit("native").alias("parser"), "error")
    lost = empty.join(read, "doc", "left_anti").select("doc", F.lit(None).cast("string").alias("text"), F.lit("recognised").alias("parser"), F.lit("no_extractable_text").alias("error"))
    return kept.unionByName(read).unionByName(lost)


# --- outline of TypeScript and JavaScript ---

_DECLARED = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|enum|type|namespace|module|const|let|var)\b\s*\*?\s*([A-Za-z_$][\w$]*|\"[^\"]*\"|'[^']*')?")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set|declare)\s+)*(#?[A-Za-z_$][\w$]*|\"[^\"]*\"|'[^']*'|\[[^\]]*\])\s*[?!]?\s*(?=[(:=<;]|$)")
_CONTAINERS = ("class", "interface", "namespace", "module", "enum")
MOST_SIGNATURE = 1024


def _blanked(source: str) -> str:
    """The source with comments, strings and templates overwritten by blanks, line ends kept, so that braces count."""
    pattern = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*(?:`|\Z)", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _statements(blank: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Begin and end of what stands between semicolons, commas aside, and closing braces, at one level of braces."""
    out, depth, first = [], 0, None
    for i in range(begin, end):
        c = blank[i]
        if first is None and not c.isspace() and c not in ";,}":
            first = i
        if c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
            rest = blank[i + 1 : end].lstrip(" \t")
            if depth == 0 and c == "}" and first is not None and not rest.startswith((")", ",", ";", ".", "=", "|", "&", "as ")):
                out.append((first, i + 1))
                first = None
        elif c == ";" and depth == 0 and first is not None:
            out.append((first, i + 1))
            first = None
    if first is not None and blank[first:end].strip():
        out.append((first, begin + len(blank[begin:end].rstrip())))
    return out


def outline(source: str, language: str = "typescript") -> list[dict[str, Any]]:
    """Top-level declarations, and the members of classes, interfaces, enums and modules: language, root_index, depth, kind, name, signature, text, lines.

    A light scanner by braces, not a compiler: it reads declarations as people write them, and never fails on what it does not know.
    """
    blank, out = _blanked(source), []
    line = lambda at: source.count("\n", 0, at) + 1

    def add(root: int, depth: int, kind: str, name: str, a: int, z: int) -> None:
        brace = blank.find("{", a, z)
        signature = " ".join(source[a : brace if brace >= 0 else z].split())[:MOST_SIGNATURE]
        out.append({"language": language, "root_index": root, "depth": depth, "kind": kind, "name": name.strip("\"'"), "signature": signature, "text": source[a:z], "start_line": line(a), "end_line": line(z - 1)})

    root = 0
    for a, z in _statements(blank, 0, len(blank)):
        m = _DECLARED.match(source, a)
        if not m or not m[2] and "default" not in source[a : m.end()]:
            continue
        add(root, 0, m[1], m[2] or "default", a, z)
        brace = blank.find("{", a, z)
        if m[1] in _CONTAINERS and brace >= 0:
            for b, e in _statements(blank, brace + 1, blank.rfind("}", brace, z)):
                inner = _DECLARED.match(source, b) if m[1] in ("namespace", "module") else None
                member = inner or _MEMBER.match(source, b)
                if member:
                    add(root, 1, inner[1] if inner else "member", (inner[2] or "default") if inner else member[1], b, e)
        root += 1
    return out


# --- answers of a remote parser ---

#: Media types that may be sent to a remote parser.
MEDIA_TYPES = ("application/pdf", "text/csv", "image/png", "image/jpeg", "audio/wav", "audio/mpeg")


def remote_parse(send: Callable[[bytes, str], bytes], content: bytes, media_type: str, most: int = 8 << 20) -> dict[str, Any]:
    """What an injected transport answers, checked: a known media type, a bounded answer, a JSON object with schema_version 1 and text or pages."""
    if media_type not in MEDIA_TYPES:
        raise ValueError(f"media type {media_type} is not allowed")
    answer = send(content, media_type)
    if len(answer) > most:
        raise ValueError("the parser's answer is too large")
    doc = json.loads(answer.decode("utf-8"))
    if not isinstance(doc, dict) or doc.get("schema_version") != 1 or not (isinstance(doc.get("text"), str) or isinstance(doc.get("pages"), list)):
        raise ValueError("the parser's answer is malformed")
    return doc


# --- chunks of a fallback ---


def locator(base: Column, **more: Column) -> Column:
    """A locator map with entries added; later ones win."""
    extra = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k), v.cast("string")) for k, v in more.items())), lambda e: e["col2"].isNotNull()))
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*more))
    return F.map_concat(kept, extra)


def degraded_chunks(paragraphs: DataFrame, expected: str, diagnostic: Column | None = None) -> DataFrame:
    """Paragraph chunks whose locator says that the structure they should have come from was not there."""
    base = F.col("locator") if "locator" in paragraphs.columns else F.lit(None).cast("map<string,string>")
    marks = {"parser_mode": F.lit("degraded"), "degradation": F.lit("parser-unavailable"), "expected_structure": F.lit(expected), "parser_diagnostic": diagnostic if diagnostic is not None else F.lit(None).cast("string")}
    return paragraphs.withColumn("locator", locator(base, **marks))
