"""Quality scores from a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees grown on a bounded labelled sample give
conjunctive rules (the paths to their nodes); a logistic regression with an L1 penalty keeps the few
rules that matter; the kept rules become one Spark column expression, so scoring is a projection
over the documents, without Python.

Edge cases: null and empty texts have all statistics 0 and are scored like any text; rows without a
label, or with a label other than 0 and 1, aren't learned from; without both labels in the training
rows the score is the share of label 1 (0.5 with no rows); repeated rows are each scored; a document
labelled more than once trains once for each label; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelattice.llm.common import crc_bucket

#: Bound on what is fitted: about so many labelled rows.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, MIN_LEAF, CUTS = 40, 3, 20, 24


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns and one row of statistics for each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    base = docs.select(*carry, text.alias("_t"), words.alias("_w"))
    # what is left of a text without the runs of other characters: one short copy a class
    only = lambda chars: F.length(F.regexp_replace("_t", f"[^{chars}]++", ""))
    counts = {"_n": F.size("_w"), "_c": F.greatest(F.length("_t"), F.lit(1)), "_upper": only("A-Z"), "_odd": only(r"#$%&*|!?<>{}\[\]=~^@/\\_+"), "_digit": only("0-9"), "_stop": only(".,;:"), "_u": F.size(F.array_distinct("_w"))}
    lines = F.split("_t", "\n")
    base = base.select(*carry, "_t", *[c.alias(k) for k, c in counts.items()], (F.size(lines) - 1).alias("_lines"), F.size(F.array_distinct(lines)).alias("_ul"))
    filled = F.length(F.trim("_t")) > 0
    zero = lambda c: F.when(filled, c).otherwise(F.lit(0.0)).cast("double")
    return base.select(
        *carry,
        zero(F.log1p("_n")).alias("log_words"),
        zero(F.col("_c") / F.col("_n")).alias("word_length"),
        zero(F.col("_upper") / F.col("_c")).alias("upper_share"),
        zero(F.col("_odd") / F.col("_c")).alias("symbol_share"),
        zero(F.col("_odd") / F.col("_n")).alias("symbols_a_word"),
        zero(F.col("_digit") / F.col("_c")).alias("digit_share"),
        zero(F.col("_stop") / F.col("_n")).alias("stops_a_word"),
        zero(F.col("_u") / F.col("_n")).alias("distinct_words"),
        zero(F.col("_n") / F.sqrt(F.col("_u").cast("double"))).alias("word_repeats"),
        zero(F.col("_ul") / (F.col("_lines") + 1)).alias("distinct_lines"),
        zero((F.col("_lines") + 1) / F.col("_n")).alias("lines_a_word"),
    )


@dataclass(frozen=True)
class Rule:
    """All of (feature, at most, cut) hold: feature <= cut if `at most`, else feature > cut."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, most, cut in self.terms:
            out = out & ((F.col(name) <= cut) if most else (F.col(name) > cut))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, most, cut in self.terms:
            out &= (x[name] <= cut) if most else (x[name] > cut)
        return out


def tree_paths(x: np.ndarray, residual: np.ndarray, names: list[str], rows: np.ndarray, cols: np.ndarray, depth: int) -> tuple[list[tuple], np.ndarray]:
    """Every path of a least-squares tree, and the tree's fit to the residual of all rows."""
    paths, fit = [], np.zeros(len(x))

    def grow(own: np.ndarray, everyone: np.ndarray, path: tuple, left: int) -> None:
        mean = residual[own].mean()
        best = None
        if left and len(own) >= 2 * MIN_LEAF:
            for j in cols:
                v = x[own, j]
                cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1]))
                order = np.argsort(v, kind="stable")
                sums, n = np.cumsum(residual[own][order]), len(own)
                k = np.searchsorted(v[order], cuts, "right")
                ok = (k >= MIN_LEAF) & (n - k >= MIN_LEAF)
                if ok.any():
                    k, cuts = k[ok], cuts[ok]
                    gain = sums[k - 1] ** 2 / k + (sums[-1] - sums[k - 1]) ** 2 / (n - k)
                    i = int(np.argmax(gain))
                    if best is None or gain[i] > best[0] + 1e-12:
                        best = (gain[i], j, cuts[i])
        if best is None or best[0] <= len(own) * mean**2 + 1e-9:
            fit[everyone] = mean
            return
        _, j, cut = best
        for most in (True, False):
            inside = lambda a: a[(x[a, j] <= cut) == most]  # noqa: B023, E731
            term = (names[j], most, float(cut))
            paths.append((*path, term))
            grow(inside(own), inside(everyone), (*path, term), left - 1)

    grow(rows, np.arange(len(x)), (), depth)
    return paths, fit


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def lasso(h: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = h.shape
    step = 4.0 / (np.linalg.norm(h, 2) ** 2 / n + 1)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    pw, pb, t = w.copy(), b, 1.0
    for _ in range(steps):
        error = sigmoid(h @ pw + pb) - y
        nw = pw - step * (h.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = pb - step * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        """The compiled ensemble: a column between 0 and 1 over the columns of statistics()."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score_arrays(self, x: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(next(iter(x.values()))), self.intercept)
        for rule, weight in self.rules:
            z += np.where(rule.holds(x), weight, 0.0)
        return 1 / (1 + np.exp(-z))


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, penalty: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Rules of boosted trees over half the rows each, weighed by the lasso."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        return RuleEnsemble((), float(np.log(p / (1 - p))))
    names = sorted(x)
    table, rng = np.column_stack([x[k] for k in names]), np.random.default_rng(seed)
    z, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(2, len(y) // 2), replace=False))
        cols = np.sort(rng.choice(len(names), max(1, (2 * len(names)) // 3), replace=False))
        paths, step = tree_paths(table, y - sigmoid(z), names, rows, cols, DEPTH)
        z = z + 2.0 * step
        for p in paths:
            rule = Rule(p)
            found.setdefault(rule.holds(x).tobytes(), rule)  # paths that hold for the same rows are one rule
    rules = [r for r in found.values() if 0 < r.holds(x).mean() < 1]
    if not rules:
        return fit({k: v[:0] for k, v in x.items()}, y[:0])
    h = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    center, scale = h.mean(axis=0), h.std(axis=0)
    w, b = lasso((h - center) / scale, y, penalty)
    w = w / scale
    kept = [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]
    return RuleEnsemble(tuple(kept), float(b - w @ center))


def train(docs: DataFrame, labels: DataFrame, bucket: int = 0, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """An ensemble from about `rows` labelled documents outside the held-out bucket, drawn by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (crc_bucket(F.col("doc_id")) != bucket))
    total = marked.count()
    share = min(1.0, rows / max(1, total))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < int(share * (1 << 20)))
    if drawn.count() <= 2 * TRAIN_ROWS:  # a larger sample, if one is asked for, is joined by a shuffle
        drawn = F.broadcast(drawn)
    found = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, "doc_id"), "doc_id", "_y").toPandas().sort_values(["doc_id", "_y"])
    x = {k: found[k].to_numpy(np.float64) for k in found.columns if k not in ("doc_id", "_y")}
    return fit(x, found["_y"].to_numpy(np.float64))


def score(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    table = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    table = table.select("doc_id", (crc_bucket(F.col("doc_id")) == 0).alias("held_out"), ensemble.score().alias("score"))
    return table.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
