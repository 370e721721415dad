"""Structure-aware chunking: plain text, Markdown, tables, conversations, page layout, code; identities and checks.

Chunkers that need a running state are plain functions over one document, called in Arrow batches by mapInPandas; the plain-text
chunker and identities are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

PARENT, CHILD, TABLE_ROWS = 4800, 1200, 1200
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")

Draft = dict[str, Any]  # level, ordinal, parent (ordinal or None), path, content, locator


def paragraphs(docs: DataFrame, most: int = CHILD) -> DataFrame:
    """memory_id, ordinal, content: paragraphs, cut at `most` characters, in order."""
    blocks = F.filter(F.transform(F.split("text", "\\r?\\n\\s*\\r?\\n"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(blocks, lambda p: T.split_long(p, most)))
    return docs.select("memory_id", F.posexplode(pieces).alias("ordinal", "content")).select("memory_id", F.col("ordinal").cast("long").alias("ordinal"), "content")


def pack(blocks: list[str], most: int, gap: int = 2) -> list[list[str]]:
    """Next-fit: a block that does not fit the running group opens a new one; longer blocks are cut first."""
    cut = [p for b in blocks for p in ([b] if len(b) <= most else (b[i : i + most].strip() for i in range(0, len(b), most))) if p]
    groups: list[list[str]] = []
    room = -1
    for b in cut:
        need = len(b) + (gap if groups and room >= 0 else 0)
        if not groups or need > room:
            groups.append([])
            room, need = most, len(b)
        groups[-1].append(b)
        room -= need
    return groups


def sections(text: str) -> list[tuple[list[str], str, list[str]]]:
    """Heading path, heading line and paragraphs of each section of a Markdown text; a heading closes all deeper ones."""
    out: list[tuple[list[str], str, list[str]]] = []
    stack: dict[int, str] = {}
    path, heading, lines = ["document"], "", []

    def close() -> None:
        blocks = [b for b in (p.strip() for p in re.split(r"\n\s*\n", "\n".join(lines))) if b]
        if blocks:
            out.append((path, heading, blocks))
        lines.clear()

    for line in re.split(r"\r?\n", text):
        m = _HEADING.match(line)
        if not m:
            lines.append(line if line.strip() else "")
            continue
        close()
        level = len(m[1])
        stack = {k: v for k, v in stack.items() if k < level} | {level: m[2].strip()}
        path, heading = [stack[k] for k in sorted(stack)], f"{m[1]} {m[2].strip()}"
    close()
    return out


def _families(groups: Iterator[tuple[list[str], str, list[str]]] | list, parent: int, child: int) -> list[Draft]:
    """A parent for each group of blocks, and children cut from it; short headings go before every child."""
    out: list[Draft] = []
    for path, heading, blocks in groups:
        lead = f"{heading}\n" if heading and len(heading) + 1 < child / 2 else ""
        for part, group in enumerate(pack(blocks, parent)):
            head = len(out)
            out.append({"level": "parent", "ordinal": head, "parent": None, "path": path, "content": "\n\n".join(([heading] if heading else []) + group), "locator": f"{' > '.join(path)}#{part}"})
            for k, inner in enumerate(pack(group, child - len(lead))):
                out.append({"level": "child", "ordinal": len(out), "parent": head, "path": path, "content": lead + "\n\n".join(inner), "locator": f"{' > '.join(path)}#{part}.{k}"})
    return out


def markdown(text: str, parent: int = PARENT, child: int = CHILD) -> list[Draft]:
    return _families(sections(text), parent, child)


def contextual(text: str, label: str = "", least: int = 120, most: int = 700) -> list[str]:
    """For evaluation: paragraphs gathered to between `least` and `most` characters, each with its document and heading path before it."""
    out = []
    for path, _, blocks in sections(text):
        held = ""
        for b in blocks:
            for piece in (b[i : i + most] for i in range(0, len(b), most)):
                if held and len(held) + 2 + len(piece) > most:
                    out.append((path, held))
                    held = ""
                held = f"{held}\n\n{piece}" if held else piece
        if len(held) >= least or (held and not out):
            out.append((path, held))
    return ["\n".join(x for x in (label, " > ".join(p), t) if x) for p, t in out]


def whole_or_paragraphs(text: str, most: int = 6000, least: int = 200) -> list[str]:
    """The prototype's chunker: short texts whole; of others, runs of paragraphs.

    A run ends before the paragraph that would take its text past `most`, but never while it holds fewer than `least` characters.
    Where runs end follows from the paragraphs' lengths alone, so those are folded first and the text is cut afterwards.
    """
    if len(text) <= most:
        return [text]
    paragraphs = [p for p in text.split("\n\n") if p.strip()]

    def place(state: tuple[int, int], size: int) -> tuple[int, int]:
        run, length = state
        return (run + 1, size) if least <= length and length + size > most else (run, length + size + 2 * (length > 0))

    runs = [run for run, _ in accumulate(map(len, paragraphs), place, initial=(0, 0))][1:]
    joined = ("\n\n".join(p for _, p in own).strip() for _, own in groupby(zip(runs, paragraphs, strict=True), key=itemgetter(0)))
    return [c for c in joined if c]


def table(name: str, headers: list[str], rows: list[list[str]], most: int = TABLE_ROWS) -> list[Draft]:
    """A parent with the whole table; children repeat the header and hold as many rows as fit; an empty table is its header."""
    head = " | ".join(headers)
    lines = [" | ".join(f"{h}={v}" for h, v in zip(headers, r, strict=True)) for r in rows]
    out: list[Draft] = [{"level": "parent", "ordinal": 0, "parent": None, "path": [name], "content": "\n".join([head, *lines]), "locator": f"{name}!1-{max(1, len(lines))}"}]
    first = 0
    for g in pack(lines, most - len(head) - 1, gap=1) or [[]]:
        out.append({"level": "child", "ordinal": len(out), "parent": 0, "path": [name], "content": "\n".join([head, *g]), "locator": f"{name}!{first + 1}-{max(first + 1, first + len(g))}"})
        first += len(g)
    return out


def turn_line(speaker: str, role: str, sequence: int, text: str) -> str:
    return f"[{speaker}/{role} #{sequence}] {text}"


def conversation(turns: list[dict[str, Any]], parent: int = PARENT) -> list[Draft]:
    """Turns by sequence, grouped to parents, a child for each turn; sequences must be unique."""
    turns = sorted(turns, key=lambda t: t["sequence"])
    if len({t["sequence"] for t in turns}) != len(turns):
        raise ValueError("a turn sequence repeats")
    out: list[Draft] = []
    group: list[dict[str, Any]] = []

    def close() -> None:
        if not group:
            return
        head = len(out)
        where = f"turns {group[0]['sequence']}-{group[-1]['sequence']}"
        out.append({"level": "parent", "ordinal": head, "parent": None, "path": ["conversation"], "content": "\n\n".join(t["line"] for t in group), "locator": where})
        out.extend({"level": "child", "ordinal": head + 1 + k, "parent": head, "path": ["conversation"], "content": t["line"], "locator": f"turn {t['sequence']}"} for k, t in enumerate(group))
        group.clear()

    size = 0
    for t in turns:
        t = t | {"line": turn_line(t.get("speaker", t["role"]), t["role"], t["sequence"], t["text"])}
        if group and size + 2 + len(t["line"]) > parent:
            close()
            size = 0
        size += len(t["line"]) + (2 if group else 0)
        group.append(t)
    close()
    return out


def layout(pages: list[dict[str, Any]], parent: int = PARENT, child: int = CHILD) -> list[Draft]:
    """Pages of blocks (kind, text, heading_level): headings make the path across pages; each page's blocks are grouped under it."""
    stack: dict[int, str] = {}
    groups: list[tuple[list[str], str, list[str]]] = []
    for page in sorted(pages, key=lambda p: p["page"]):
        key = None
        for b in page["blocks"]:
            if b.get("kind") == "heading":
                level = b.get("heading_level") or 1
                stack = {k: v for k, v in stack.items() if k < level} | {level: b["text"].strip()}
                continue
            path = [f"page {page['page']}", *(stack[k] for k in sorted(stack))]
            if key != path:
                groups.append((path, "", []))
                key = path
            groups[-1][2].append(b["text"].strip())
    return _families(groups, parent, child)


def code(nodes: list[dict[str, Any]], child: int = CHILD) -> list[Draft]:
    """Flattened syntax nodes (root_index, depth, kind, name, text): each root is a parent, all below it are its children."""
    out: list[Draft] = []
    for root in [n for n in nodes if n["depth"] == 0]:
        head = len(out)
        out.append({"level": "parent", "ordinal": head, "parent": None, "path": [root["name"]], "content": root["text"], "locator": f"{root['start_line']}-{root['end_line']}"})
        below = [n for n in nodes if n["root_index"] == root["root_index"] and n["depth"] > 0] or [root]
        for n in below:
            for piece in (p for g in pack([n["text"]], child) for p in g):
                out.append({"level": "child", "ordinal": len(out), "parent": head, "path": [root["name"], n["name"]], "content": piece, "locator": f"{n['start_line']}-{n['end_line']}"})
    return out


DRAFTS = "memory_id long, ordinal long, level string, parent long, path string, content string, locator string"


def chunk(docs: DataFrame, chunker: Callable[[str], list[Draft]]) -> DataFrame:
    """memory_id, text -> drafts; where the chunker fails, paragraphs whose locator says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for memory, text in zip(pdf["memory_id"], pdf["text"], strict=True):
                try:
                    drafts = chunker(text or "")
                except (ValueError, KeyError, TypeError):
                    drafts = [{"level": "child", "ordinal": k, "parent": None, "path": ["document"], "content": p, "locator": "degraded"} for k, p in enumerate(x for x in (text or "").split("\n\n") if x.strip())]
                rows += [(memory, d["ordinal"], d["level"], d["parent"], " > ".join(d["path"]), d["content"], d["locator"]) for d in drafts]
            yield pd.DataFrame(rows, columns=["memory_id", "ordinal", "level", "parent", "path", "content", "locator"]).astype({"parent": "Int64"})

    return docs.select("memory_id", "text").mapInPandas(run, DRAFTS)


def identity(version: Column, memory: Column, ordinal: Column, digest: Column) -> Column:
    return F.concat(F.lit("chunk."), F.sha2(F.concat_ws("\n", version, memory.cast("string"), ordinal.cast("string"), digest), 256))


def identified(drafts: DataFrame, version: str) -> DataFrame:
    """Adds digest, chunk_id and the parent's chunk_id, by a join on (memory_id, ordinal)."""
    v = F.lit(version)
    rows = drafts.withColumn("chunk_digest", T.digest(F.col("content"))).withColumn("chunk_id", identity(v, F.col("memory_id"), F.col("ordinal"), F.col("chunk_digest")))
    parents = rows.where("level = 'parent'").select(F.col("memory_id").alias("_m"), F.col("ordinal").alias("_o"), F.col("chunk_id").alias("parent_chunk_id"))
    return rows.join(parents, (F.col("memory_id") == F.col("_m")) & (F.col("parent") == F.col("_o")), "left").drop("_m", "_o")


def gate(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """reason, n: why an index is not ready: documents without chunks, repeated ids, orphans, parents without children."""
    ids = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kids = chunks.where("level = 'child' and parent is not null").select("memory_id", F.col("parent").alias("ordinal")).distinct()
    parents = chunks.where("level = 'parent'").select("memory_id", "ordinal")
    count = lambda df, why: df.agg(F.lit(why).alias("reason"), F.count(F.lit(1)).alias("n"))
    out = count(docs.select("memory_id").join(chunks, "memory_id", "left_anti"), "document_without_chunks").unionByName(count(ids, "repeated_chunk_id"))
    return out.unionByName(count(kids.join(parents, ["memory_id", "ordinal"], "left_anti"), "orphan_child")).unionByName(count(parents.join(kids, ["memory_id", "ordinal"], "left_anti"), "childless_parent"))
