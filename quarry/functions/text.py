"""Text functions as column expressions: terms, bigrams, query clean-up, redaction, normalisation, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that a query does not search for.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for", "from", "how", "i", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "use", "using", "was", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your",
)
TERM = "[a-z0-9][a-z0-9._-]*"
CJK = "[一-鿿㐀-䶿豈-﫿]+"
MOST_TERMS = 64


def tokens(text: Column) -> Column:
    """Document side: lower-case tokens, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def query_terms(query: Column) -> Column:
    """Query side: distinct tokens of two characters or more that are no stop words, the first 64."""
    return F.slice(F.filter(F.array_distinct(tokens(query)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)), 1, MOST_TERMS)


def cjk_bigrams(text: Column) -> Column:
    """Distinct bigrams of each run of Han characters; a single character stays as it is."""
    runs = F.regexp_extract_all(text, F.lit(CJK), 0)
    grams = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.slice(F.array_distinct(F.flatten(grams)), 1, MOST_TERMS)


def cjk_occurrences(text: Column) -> Column:
    """Document side: the bigrams of each run of Han characters, in order, with repeats."""
    runs = F.regexp_extract_all(text, F.lit(CJK), 0)
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))


def sanitise_query(query: Column) -> Column:
    """Runs of - or | and such signs standing alone are layout, not search operators."""
    q = F.regexp_replace(query, "[-|]{2,}", " ")
    q = F.regexp_replace(q, "(^|\\s)[-|](?=\\s|$)", " ")
    return F.trim(F.regexp_replace(q, "\\s+", " "))


def normalised_score(rank: Column) -> Column:
    return F.when(rank <= 0, 0.0).otherwise(rank / (1 + rank))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def bucket(value: Column, of: int = 100) -> Column:
    """The first four bytes of the SHA-256, big-endian, modulo."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long") % of


#: What may not stand in a stored error message, in the order of replacement.
REDACTIONS = (
    ("(?i)\\b[a-z][a-z0-9+.-]*://[^\\s:@/]+:[^\\s@/]+@", "[redacted-uri]@"),
    ("(?i)\\bBearer\\s+[\\w.~+/=-]+", "Bearer [redacted]"),
    ("(?i)\\b(?:sk|pk|rk|api[-_]?key|key|token|secret|password|passwd|pwd)[-_]?[a-z0-9]*\\s*[:=]\\s*[\\w.~+/=-]{6,}", "[redacted]"),
    ("(?i)\\b(?:sk|pk|rk)-[\\w.~+/=-]{8,}", "[redacted]"),
    ("\\b[A-Fa-f0-9]{32,}\\b", "[redacted]"),
    ("[\\x00-\\x1f\\x7f]", " "),
    ("\\s{2,}", " "),
)


def redact_error(message: Column, most: int = 1000) -> Column:
    for pattern, by in REDACTIONS:
        message = F.regexp_replace(message, pattern, by)
    message = F.trim(message)
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most - 3), F.lit("..."))).otherwise(message)


#: What cleaned text is without, in the order of replacement.
CLEAN = (("(?s)```.*?```", ""), ("(?s)<!--.*?-->", ""), ("\\r\\n", "\n"), ("\\n{3,}", "\n\n"), ("(?m)^\\s*[|\\-]+\\s*$", ""), ("https?://\\S+", ""))


def clean(text: Column) -> Column:
    """Without code fences, comments, table rules and bare links; line ends and blank lines made regular."""
    for pattern, by in CLEAN:
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def strip_markdown(text: Column) -> Column:
    """Without badges, links (their words stay) and inline marks."""
    for pattern, by in (("\\[!\\[[^\\]]*\\]\\([^)]*\\)\\]\\([^)]*\\)", " "), ("!?\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("[`*_#|]", " "), ("\\s+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def safe_key(value: Column) -> Column:
    """ASCII key with a short digest, so that different names never meet."""
    ascii_ = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._/:-]+", "-"), "^[^A-Za-z0-9]+", "")
    return F.concat(F.when(ascii_ == "", "key").otherwise(ascii_), F.lit("."), F.substring(F.sha2(value, 256), 1, 8))


def identifiers(text: Column, most: int = 10) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]+"), 0), 1, most)


def split_long(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, trimmed, empty ones left out."""
    n = F.greatest(F.ceil(F.length(text) / most), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substring(text, i * most + 1, F.lit(most))))
    return F.filter(F.when(F.length(text) <= most, F.array(text)).otherwise(pieces), lambda p: p != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for a zero vector."""
    product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return product(a, b) / F.nullif(F.sqrt(product(a, a) * product(b, b)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / 2, within 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (1 - cosine(a, b)) / 2))


def ordered_union(*ids: Column) -> Column:
    """The members of several arrays in the order in which they first come; null arrays and members count as none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(i.cast("array<string>"), none) for i in ids)), lambda x: x.isNotNull()))
