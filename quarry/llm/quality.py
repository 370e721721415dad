"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of each text are Spark columns; the classifier sees nothing else.
2. Shallow trees are grown on bootstrap samples of labelled rows; every path from a root to a node is a rule, a conjunction of
   thresholds.
3. A lasso-penalised logistic regression over the rules keeps few of them.
4. The rules kept are compiled into one Spark column expression, so that scoring is a projection without Python.

Training uses at most `sample` labelled rows, the first by a hash of doc_id, of those with crc32(doc_id) mod 5 other than 0; this
bound does not depend on the corpus. Everything else reads all rows.

Defined results: null and empty text get the score of an empty text, computed like any other; rows without doc_id are left out of
results and kept out of training; a document labelled more than once counts with its smallest label, labels other than 0 and 1 not
at all; without labels of both classes, or where no rule holds for some and not for others, every score is the share of label 1 (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, TREES, DEPTH, BINS, PENALTY, CUT = 20_000, 40, 3, 24, 0.002, 0.3
#: Columns that the fit scales at once.
COLUMNS = 32


def statistics(text: Column) -> dict[str, Column]:
    """Counts over the whole text, each in one pass of the JVM."""
    t = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    words = F.filter(F.split(t, "[ \\n\\t\\r]+"), lambda w: w != "")
    return {"chars": F.length(t), "lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1, "words": F.size(words), "kinds": F.size(F.array_distinct(words)), "upper": left("[^\\p{Lu}]+"), "digits": left("[^0-9]+"), "stops": left("[^.,;:?]+"), "marks": left("[\\p{L}\\p{N}\\s.,;:?'\"-]+"), "bars": F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))}


def features() -> dict[str, Column]:
    """Ratios of the counts, none of which depends on labels, language, source or id."""
    c = {k: F.col(f"_{k}").cast("double") for k in ("chars", "lines", "words", "kinds", "upper", "digits", "stops", "marks", "bars")}
    per = lambda a, b: c[a] / F.greatest(F.lit(1.0), c[b])
    return {
        "log_chars": F.log1p(c["chars"]), "log_words": F.log1p(c["words"]), "word_length": per("chars", "words"), "distinct": per("kinds", "words"),
        "distinct_root": c["kinds"] / F.greatest(F.lit(1.0), F.sqrt(c["words"])), "upper": per("upper", "chars"), "upper_words": per("upper", "words"), "digits": per("digits", "chars"),
        "stops": per("stops", "words"), "marks": per("marks", "words"), "bars": per("bars", "words"), "line_words": per("words", "lines"),
    }


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features; counts are computed once, below the ratios."""
    counts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *(e.alias(f"_{k}") for k, e in statistics(F.col("text").cast("string")).items()))
    return counts.select("doc_id", *(e.alias(k) for k, e in features().items()))


Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """score = sigmoid(bias + the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """One sum over a constant array of rules, so that plan and generated code do not grow with the rules."""
        names = sorted({name for rule, _ in self.rules for name, _, _ in rule})
        if not names:
            return F.lit(1 / (1 + float(np.exp(-self.bias))))
        value = F.array(*names)
        rules = ", ".join(f"named_struct('weight', {weight!r}D, 'parts', array({', '.join(f"named_struct('name', {names.index(name)}, 'upto', {str(op == '<=').lower()}, 'at', {at!r}D)" for name, op, at in rule)}))" for rule, weight in self.rules)
        holds = lambda r: F.forall(r["parts"], lambda p: (F.get(value, p["name"]) <= p["at"]) == p["upto"])
        return 1 / (1 + F.exp(-F.aggregate(F.expr(f"array({rules})"), F.lit(self.bias), lambda total, r: total + F.when(holds(r), r["weight"]).otherwise(0.0))))


def _holds(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, at in rule:
        v = x[:, names.index(name)]
        out &= v <= at if op == "<=" else v > at
    return out


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, rng: np.random.Generator) -> list[Rule]:
    """All paths of one tree; each node considers a random half of the features."""
    out: list[Rule] = []
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            out.append(path)
        own = y[rows]
        if len(path) >= depth or len(rows) < 20 or own.min() == own.max():
            continue
        best = (0.0, 0, 0.0)
        p = own.mean()
        for j in rng.choice(len(names), max(1, len(names) // 2), replace=False):
            v = x[rows, j]
            for at in cuts[j]:
                low = v <= at
                n = int(low.sum())
                if 5 <= n <= len(rows) - 5:
                    a, b = own[low].mean(), own[~low].mean()
                    gain = p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, int(j), float(at))
        if best[0] > 1e-6:
            low = x[rows, best[1]] <= best[2]
            todo += [(rows[low], (*path, (names[best[1]], "<=", best[2]))), (rows[~low], (*path, (names[best[1]], ">", best[2])))]
    return out


def _lasso(held: list[np.ndarray], y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient steps on scaled columns.

    The scaled columns are the only matrix of rows times rules that is held; they are filled in a few at a time.
    """
    z = np.ones((len(y), 1 + len(held)))
    mean, scale = np.zeros(len(held)), np.zeros(len(held))
    for i in range(0, len(held), COLUMNS):
        a, own = np.column_stack(held[i : i + COLUMNS]).astype(float), slice(i, i + COLUMNS)
        mean[own], scale[own] = a.mean(axis=0), np.maximum(a.std(axis=0), 1e-9)
        z[:, 1 + i : 1 + i + COLUMNS] = (a - mean[own]) / scale[own]
    rate = 4 / max(np.linalg.norm(z.T @ z / len(y), 2), 1e-9)
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-(z @ v))) - y) / len(y)
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - rate * penalty)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    weight = w[1:] / scale
    return float(w[0] - (weight * mean).sum()), weight


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 5) -> RuleEnsemble:
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    constant = RuleEnsemble(float(np.log(share / (1 - share))), ())
    if not len(y) or y.min() == y.max():
        return constant
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 2)[1:-1])) for j in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), 4000))
        rules.update(dict.fromkeys(_paths(x[rows], y[rows], names, cuts, depth, rng)))
    held = {r: _holds(r, x, names) for r in rules}
    held = {r: h for r, h in held.items() if 0.002 < h.mean() < 0.998}
    if not held:
        return constant
    bias, weight = _lasso(list(held.values()), y.astype(float), penalty)
    return RuleEnsemble(bias, tuple((r, float(w)) for r, w in zip(held, weight, strict=True) if abs(w) > 1e-4))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """Learns from at most `sample` labelled rows outside the held-out fifth; only they reach the driver, as features."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    rows = with_features(chosen).join(F.broadcast(own), "doc_id").orderBy("doc_id", *features()).toPandas()
    names = list(features())
    return fit_rules(rows[names].to_numpy(float), rows["quality"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleEnsemble, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    return with_features(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score")).withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleEnsemble, cut: float = CUT) -> DataFrame:
    """The rows whose text scores at least `cut`, with their own columns only.

    The ratios come out of a generator: a filter is not pushed below one, where each of its comparisons would hold, and compute, the statistics anew.
    """
    counts = docs.select(F.struct("*").alias("_row"), *(e.alias(f"_{k}") for k, e in statistics(F.col("text").cast("string")).items()))
    ratios = counts.select("_row", F.inline(F.array(F.struct(*(e.alias(k) for k, e in features().items())))))
    return ratios.where(model.column() >= cut).select("_row.*")
