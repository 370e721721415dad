"""Quality rules: a table of thresholds, compiled into one projection of ratios.

Each rule holds a ratio of two counts of the whole text between bounds, for texts of at least so many words. The counts are column
expressions as well (split, hash, distinct, sort of the text's own arrays), so no row leaves the JVM and nothing is shuffled.

Words are maximal runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return. Windows of eight words
are compared by 64-bit hashes of the 64-bit hashes of their words.

Defined results: null and empty text have no words and fail the base rules; a ratio over nothing is 0; rows without doc_id, repeated
rows and rows with extra columns are scored like all others, one result each.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "as", "for", "from", "in", "is", "of", "on", "that", "the", "this", "to", "was", "with",
    "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)


class Rule(NamedTuple):
    """least <= counts[over] / counts[per] <= most, for texts of at least `words` words."""

    name: str
    over: str
    per: str
    least: float
    most: float
    words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 1.5, 30.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.3),
    Rule("exclamations_per_word", "exclamations", "n_words", 0.0, 0.5),
    Rule("letters", "letters", "word_chars", 0.5, 1.0),
    Rule("capitals", "capitals", "letters", 0.0, 0.6),
    Rule("stop_words", "stop_words", "n_words", 0.02, 1.0, 100),
    Rule("repeated_lines", "n_dup_lines", "lines", 0.0, 0.5),
    Rule("line_length", "word_chars", "lines", 8.0, float("inf"), 100),
)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many of the words lie in a window of `size` words that stands in the array twice or more."""

    def of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(at, k + 1) - p, F.lit(size)))), F.lit(0), lambda s, x: s + x)

    def places(ordered: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        met = F.filter(ordered, lambda x, k: same(x, F.get(ordered, k - 1)) | same(x, F.get(ordered, k + 1)))
        return F.sort_array(F.transform(met, lambda x: x["at"]))

    def count(windows: Column) -> Column:
        keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(let(F.sort_array(keyed), lambda o: let(places(o), covered)))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(of(h), count))
    return F.when(F.size(words) <= size, 0).otherwise(some)


def counts(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Arrays of the text, and the counts as expressions over columns that are named as these arrays."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    arrays = {
        "_words": F.filter(F.split(t, SPACE + "+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    }
    words, lines = F.col("_words"), F.col("_lines")
    joined = F.array_join(words, "")
    found = lambda pattern: F.length(joined) - F.length(F.regexp_replace(joined, pattern, ""))
    plain = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?")))
    return arrays, {
        "n_words": F.size(words), "word_chars": F.length(joined), "n_symbols": found(SYMBOLS + "+"), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeated_words(words),
        "lines": F.size(lines), "exclamations": F.length(joined) - F.length(F.replace(joined, F.lit("!"), F.lit(""))), "letters": found("\\p{L}+"), "capitals": found("\\p{Lu}+"),
        "stop_words": F.size(F.filter(words, lambda w: plain(w).isin(*STOP_WORDS))),
    }


def holds(rule: Rule) -> Column:
    ratio = F.when(F.col(rule.per) > 0, F.col(rule.over) / F.col(rule.per)).otherwise(0.0)
    return (F.col("n_words") < rule.words) | ((ratio >= rule.least) & (ratio <= rule.most))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, all counts, base_failed, failed (names of the rules that do not hold), kept."""
    arrays, made = counts(F.col("text"))
    rows = docs.select("doc_id", *(e.alias(n) for n, e in arrays.items())).select("doc_id", *(e.cast("long").alias(n) for n, e in made.items()))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.filter(F.array(*(F.when(~holds(r), F.lit(r.name)) for r in rules)), lambda n: n.isNotNull())
    out = rows.select("*", base.alias("base_failed"), failed.alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
