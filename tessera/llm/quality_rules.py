"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees over labelled rows give candidate rules (the paths to their nodes), lasso
logistic regression keeps few of them, and these become one Spark column expression, so that scoring
all documents stays in generated code.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_SYMBOLS = "#$%&*+<=>@\\^_`{|}~/[]"

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold) and ...


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text as double columns; of an empty one for null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.length(t).cast("double")
    share = lambda chars: (n - F.length(F.translate(t, chars, ""))) / F.greatest(n, F.lit(1.0))
    words = F.split(F.trim(t), r"\s+")
    lines = F.split(t, "\n")
    n_words = F.when(F.trim(t) == "", 0.0).otherwise(F.size(words).cast("double"))
    return {
        "chars": n,
        "words": n_words,
        "word_length": n / F.greatest(n_words, F.lit(1.0)),
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1.0)),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_length": n / F.size(lines).cast("double"),
        "upper": share(_UPPER),
        "digits": share("0123456789"),
        "symbols": share(_SYMBOLS),
        "exclamations": share("!?"),
        "stops": share(".,;:"),
        "bars": share("|"),
    }


def _tree(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, least: int) -> tuple[list, np.ndarray]:
    """One regression tree on binned statistics: its nodes as paths of (statistic, above, cut), and its fit."""
    paths: list[tuple] = []
    fit = np.zeros(len(gradient))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        value = gradient[rows].sum() / (weight[rows].sum() + 1.0)
        fit[rows] = value
        if path:
            paths.append(path)
        if left == 0 or len(rows) < 2 * least:
            return
        best = (1e-9, None, None)
        for k in range(bins.shape[1]):
            if not len(cuts[k]):
                continue
            size = len(cuts[k]) + 1
            n = np.bincount(bins[rows, k], minlength=size)
            g = np.bincount(bins[rows, k], gradient[rows], size)
            h = np.bincount(bins[rows, k], weight[rows], size)
            nl, gl, hl = np.cumsum(n)[:-1], np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], k, at)
        _, k, at = best
        if k is None:
            return
        below = bins[rows, k] <= at
        grow(rows[below], (*path, (k, False, float(cuts[k][at]))), left - 1)
        grow(rows[~below], (*path, (k, True, float(cuts[k][at]))), left - 1)

    grow(np.arange(len(gradient)), (), depth)
    return paths, fit


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradients; the intercept is free."""
    n, k = x.shape
    step = 4.0 / max(float((np.linalg.norm(x, 2) ** 2) / n) + 1.0, 1e-9)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:k] + v[k], -30, 30)))
        g = np.append(x.T @ (p - y), (p - y).sum()) / n
        new = v - step * g
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return w[:k], float(w[k])


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002) -> tuple[list[tuple[Rule, float]], float]:
    """Weighted rules and an intercept from statistics x and labels y; only the log odds where y has one value or none."""
    if len(y) == 0 or y.min() == y.max():
        ones = float(y.sum())
        return [], float(np.log((ones + 1) / (len(y) - ones + 1)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 49))) for k in range(x.shape[1])]
    cuts = [c[(c < x[:, k].max())] for k, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    random = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        use = np.sort(random.choice(len(y), max(len(y) // 2, 1), replace=False))
        paths, _ = _tree(bins[use], cuts, (y - p)[use], (p * (1 - p))[use], depth, max(5, len(use) // 500))
        found.update(dict.fromkeys(paths))
        # the whole tree's step, taken by its leaves' rules
        leaves = [r for r in paths if len(r) == depth or not any(len(o) == len(r) + 1 and o[: len(r)] == r for o in paths)]
        for r in leaves:
            rows = _holds(r, x)
            if rows.any():
                score[rows] += 0.3 * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1)
    rules = list(found)
    m = np.stack([_holds(r, x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    w, intercept = _lasso(m, y, penalty)
    kept = [(tuple((names[k], above, cut) for k, above, cut in r), float(v)) for r, v in zip(rules, w, strict=True) if v]
    return kept, intercept


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > cut) if above else (x[:, k] <= cut) for k, above, cut in rule])


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble's probability as one expression over columns named as the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        holds = reduce(Column.__and__, [(F.col(s) > F.lit(cut)) if above else (F.col(s) <= F.lit(cut)) for s, above, cut in rule])
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(measured: DataFrame, label: str, rows: int = TRAIN_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """Rules from measured(doc_id, statistics, label), on the `rows` labelled rows of least hash of doc_id."""
    names = [c for c in measured.columns if c not in ("doc_id", label)]
    known = measured.where(F.col(label).isNotNull()).withColumn("train_hash", F.xxhash64("doc_id").cast("double"))
    n = known.count()
    if n > rows:  # a bound on the hash leaves a few more than that, so that tasks send no more
        known = known.where(F.col("train_hash") < F.lit((2 * 1.2 * rows / n - 1) * 2.0**63))
    picked = known.orderBy("train_hash", "doc_id", *names).limit(rows).select(*names, label).toPandas()
    return fit_rules(names, picked[names].to_numpy(np.float64), picked[label].to_numpy(np.float64))


def scored(measured: DataFrame, rules: list[tuple[Rule, float]], intercept: float) -> DataFrame:
    """measured with score (0 to 1) and predicted (1 from 0.5), which replace columns of their names.

    A condition on a null statistic does not hold. Repeated rows are kept, and an empty table gives an empty table.
    """
    out = measured.withColumn("score", compiled(rules, intercept))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
