"""Licence scan in DataFrame operations only.

Headers: every line and sentence of a text, and licence files: the whole text, are compared with templates by the cosine of sparse TF-IDF
vectors. Inverse document frequencies of all words are counted over all texts, so that common words weigh little whether a template has
them or not, and scores do not drift with the size of the corpus. Telling words are the rarest ones of each template, as many as it takes until the others carry less of its
norm than the threshold: a text without enough telling words then cannot reach the threshold, so only lines and texts that hold them
are taken apart. A licence has a template for its notice and, where there is one, for its full text; whole texts of any length are
compared, and the norm keeps those out that hold much else.

Inheritance: a file whose whole text is a licence, or that is little else, is its directory's licence file. A file
without a header of its own takes the licence of the nearest ancestor directory that has a licence file, found by joining the
ancestors of all files' directories with the licensed directories.

Defined results: null or empty text has no licence of its own; a null path is the root; ties between templates go to the smaller
name, between licence files of one directory to the higher score and then the smaller doc_id; rows are told apart by doc_id, path and
a hash of the text, so repeated rows get equal results; rows without doc_id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

THRESHOLD = 0.6
UNIT = "\n|(?<=[A-Za-z]{2}[.]|[0-9][.]) "  # between lines, and between sentences of a line

#: The notices by which these licences ask to be named.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The notices, and full texts of the licences that have a file in license_texts.
TEMPLATES = {n: [t, *(f.read_text("utf-8") for f in [Path(__file__).parent / "license_texts" / f"{n}.txt"] if f.exists())] for n, t in NOTICES.items()}


def _words(s: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", s.lower())


def flat(templates: dict[str, str | list[str]]) -> dict[str, str]:
    """One entry for each text; see name()."""
    return {f"{n}\n{k}": t for n, ts in templates.items() for k, t in enumerate([ts] if isinstance(ts, str) else ts)}


def name(key: str) -> str:
    return key.rpartition("\n")[0]


def vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for t in templates.values() for w in _words(t)})


def document_frequency(texts: DataFrame) -> DataFrame:
    """word, n: in how many texts each word stands; the empty word stands in all."""
    words = F.array_distinct(F.array_append(F.split(F.lower("text"), "[^a-z0-9]+"), F.lit("")))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def counts_of(frequency: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """The counts of these words, and how many texts there are; only these reach the driver."""
    known = frequency.sparkSession.createDataFrame([(w,) for w in ["", *words]], "word string")
    df = {r["word"]: r["n"] for r in frequency.join(F.broadcast(known), "word").collect()}
    return df, df.pop("", 0)


def weigh(templates: dict[str, str], df: dict[str, int], n: int) -> dict[str, dict[str, float]]:
    """Unit vectors of the templates."""
    vectors = {}
    for key, t in templates.items():
        tf: dict[str, float] = {}
        for w in _words(t):
            tf[w] = tf.get(w, 0) + math.log((1 + n) / (1 + df.get(w, 0))) + 0.1
        norm = math.sqrt(sum(v * v for v in tf.values()))
        vectors[key] = {w: v / norm for w, v in tf.items()}
    return vectors


Signs = list[list[tuple[list[str], int]]]


def telling(vectors: dict[str, dict[str, float]], df: dict[str, int], threshold: float) -> Signs:
    """Of each template, sets of words and how many of each any text at the threshold holds.

    By Cauchy's inequality the words that a text shares with a template carry at least threshold**2 of the template's squared norm,
    however often they stand in the text; those left out of a set carry less than that, or than half of it.
    """
    out = []
    for v in vectors.values():
        sets = []
        for part in (1.0, 0.5):
            rest, own = sorted(v, key=lambda w: (-df.get(w, 0), w)), []
            while rest and sum(v[w] ** 2 for w in rest) >= part * threshold**2 - 1e-9:
                own.append(rest.pop())
            due, n = threshold**2 - 1e-9 - sum(v[w] ** 2 for w in rest), 0
            for x in sorted((v[w] ** 2 for w in own), reverse=True):
                if due <= 0:
                    break
                due, n = due - x, n + 1
            sets.append((sorted(own), n))
        out.append(sets)
    return out


def holds(text: Column, signs: Signs) -> Column:
    """Whether a text holds enough telling words of any template."""
    lits = lambda ws: F.array(*map(F.lit, ws))
    met = F.array_intersect(F.split(F.lower(text), "[^a-z0-9]+"), lits(sorted({w for sets in signs for ws, _ in sets for w in ws})))

    def enough(o: Column) -> Column:
        out = F.lit(False)
        for sets in signs:
            each = F.lit(True)
            for ws, n in sets:
                each = each & (F.size(F.array_intersect(o, lits(ws))) >= n)
            out = out | each
        return (F.size(o) > 0) & out

    return F.exists(F.array(met), enough)


def _matches(units: DataFrame, vectors: dict[str, dict[str, float]], frequency: DataFrame, n: int, threshold: float) -> DataFrame:
    """units: key columns and `line`; adds license and score of the best template at the threshold."""
    keys = [c for c in units.columns if c != "line"]
    spark = units.sparkSession
    of = spark.createDataFrame([(w, {k: v[w] for k, v in vectors.items() if w in v}) for w in sorted({w for v in vectors.values() for w in v})], "word string, of map<string,double>")
    words = units.select(*keys, F.explode(F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), 0)).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 0.1
    weighed = words.join(frequency, "word").join(F.broadcast(of), "word", "left").withColumn("x", F.col("tf") * idf)
    norm = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *(F.sum(F.when(F.col("of").isNotNull(), F.col("x") * F.coalesce(F.col("of")[n], F.lit(0.0))).otherwise(0.0)).alias(f"t{i}") for i, n in enumerate(sorted(vectors))))
    best = F.array_max(F.array(*(F.struct((F.round(F.col(f"t{i}") / F.col("norm"), 9)).alias("score"), F.lit(-i).alias("i")) for i in range(len(vectors)))))
    names = F.array(*(F.lit(name(n)) for n in sorted(vectors)))
    return norm.select(*keys, best.alias("b")).where(F.col("b.score") >= threshold).select(*keys, F.element_at(names, 1 - F.col("b.i")).alias("license"), F.col("b.score").alias("score"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, up to the root (an empty string), nearest first."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, path: Column, templates: dict[str, str | list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, own_score, is_license_file, license, inherited_from; one row per file."""
    templates = flat(templates or TEMPLATES)
    base = files.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(path.cast("string"), F.lit("")), "^/+", "").alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row = ["doc_id", "path", "hash"]  # rows that agree in these are repeated; so many of them change no cosine
    base = base.withColumn("hash", F.xxhash64("text")).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    frequency = spool(document_frequency(base), "frequency")
    df, n = counts_of(frequency, vocabulary(templates))
    vectors = weigh(templates, df, n)
    signs = telling(vectors, df, threshold)
    suspects = spool(base.where(holds(F.col("text"), signs)).select(*row, "directory", "text"), "suspects")
    lines = suspects.select(*row, "directory", F.posexplode(F.split("text", UNIT)).alias("at", "line")).where(holds(F.col("line"), signs))
    whole = spool(_matches(suspects.select(*row, "directory", F.col("text").alias("line")), vectors, frequency, n, threshold), "whole")
    header = _matches(lines.select(*row, "directory", "at", "line"), vectors, frequency, n, threshold).unionByName(whole.withColumn("at", F.lit(-1)))
    header = header.groupBy(*row).agg(F.max(F.struct("score", (-F.col("at")).alias("at"), "license")).alias("b")).select(*row, F.col("b.license").alias("own_license"), F.col("b.score").alias("own_score"))
    held = whole.groupBy("directory").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("o"), "license")).alias("b")).select("directory", F.col("b.license").alias("dir_license"))
    files_ = whole.select(*row).distinct().withColumn("is_license_file", F.lit(True))
    directories = base.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("up", "above"))
    nearest = directories.join(held.withColumnRenamed("directory", "above"), "above").groupBy("directory").agg(F.min(F.struct("up", "above", "dir_license")).alias("b")).select("directory", F.col("b.above").alias("above"), F.col("b.dir_license").alias("dir_license"))
    out = base.select(*row, "directory").join(header, row, "left").join(files_, row, "left").join(nearest, "directory", "left")
    own = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"), F.coalesce("own_license", "dir_license").alias("license"), F.when(~own, F.col("above")).alias("inherited_from"))
