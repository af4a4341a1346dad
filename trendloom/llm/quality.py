"""Quality: a sparse rule ensemble over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import fold, labelled_sample

#: Labelled documents that a model learns from at most, about.
SAMPLE_DOCS = 8192
#: Trees, their depth, rows in a leaf at least, candidate thresholds of a statistic, rules kept at most.
TREES, DEPTH, LEAF, CUTS, RULES = 40, 3, 20, 24, 80

Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, whether above it) and so on, all of which hold


def statistics(text: str = "text") -> dict[str, Column]:
    """Text statistics by name, none ever null; shares are of characters unless named otherwise."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    ws = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    lines = F.split(t, "\n")

    def only(chars: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{chars}]+", "")) / n

    words = F.size(ws).cast("double")
    return {
        "length": F.log1p(F.length(t).cast("double")),
        "word_length": F.length(t) / words,
        "upper": only("A-Z"),
        "digit": only("0-9"),
        "symbol": only("#$%&*@^~_=+"),
        "exclaim": only("!?"),
        "pipe": only("|"),
        "stop": only(".,"),
        "bracket": only(r"{}()\[\];<>"),
        "quote": only("\"'`"),
        "letter_word": F.size(F.filter(ws, lambda w: F.length(w) <= 3)) / words,
        "distinct_word": F.size(F.array_distinct(ws)) / words,
        "distinct_line": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(n / F.size(lines)),
        "other_script": F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")) / n,
    }


def _tree(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list[Rule]) -> None:
    """Grows a regression tree on residual, adding each node's path to out, parents first."""
    best = (1e-9, -1, 0.0)
    r = residual[rows]
    whole = r.sum() ** 2 / len(rows)
    if depth:
        for j, at in enumerate(cuts):
            if not len(at):
                continue
            slot = np.searchsorted(at, x[rows, j], side="left")  # slot k: x <= at[k] first holds
            n = np.cumsum(np.bincount(slot, minlength=len(at) + 1))[:-1]
            s = np.cumsum(np.bincount(slot, weights=r, minlength=len(at) + 1))[:-1]
            fits = (n >= LEAF) & (len(rows) - n >= LEAF)
            gain = np.where(fits, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(rows) - n, 1) - whole, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(at[k]))
    if best[1] < 0:
        return
    _, j, cut = best
    above = x[rows, j] > cut
    for side in (False, True):
        p = (*path, (j, cut, side))
        out.append(p)
        _tree(x, cuts, residual, rows[above == side], depth - 1, p, out)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Paths of the nodes of boosted trees, each grown on a random half of the rows; distinct, in order of growth."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    rng, rules = np.random.default_rng(seed), []
    margin = np.zeros(len(y))
    for _ in range(TREES if len(y) >= 2 * LEAF else 0):
        rows = np.sort(rng.choice(len(y), len(y) // 2, replace=False))
        found: list[Rule] = []
        _tree(x, cuts, y - 1 / (1 + np.exp(-margin)), rows, DEPTH, (), found)
        margin += 1.5 * _leaf_values(x, found, y, margin)
        rules += found
    return list(dict.fromkeys(tuple(sorted(p)) for p in rules))


def _leaf_values(x: np.ndarray, paths: list[Rule], y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """For each row, the mean residual of its leaf."""
    out, residual = np.zeros(len(y)), y - 1 / (1 + np.exp(-margin))
    for p in paths:  # deeper paths follow their parents and overwrite them
        at = covers(x, p)
        if at.any():
            out[at] = residual[at].mean()
    return out


def covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    """The rows where the rule holds."""
    return reduce(np.logical_and, ((x[:, j] > cut) == above for j, cut, above in rule), np.ones(len(x), dtype=bool))


def lasso_logistic(a: np.ndarray, y: np.ndarray, l1: float, tolerance: float = 1e-4, most: int = 3000) -> tuple[np.ndarray, float]:
    """Weights and intercept of mean logistic loss plus l1 * |w|, by accelerated proximal gradients.

    The step is 4 over the largest eigenvalue of the Gram matrix, ones included, which bounds
    the curvature; momentum restarts where it points uphill. Ends once no optimality
    condition (see gap()) is missed by more than ``tolerance``, or after ``most`` steps.
    """
    n, k = a.shape
    x = np.hstack([a, np.ones((n, 1))])
    w = np.zeros(k + 1)
    if not n:
        return w[:-1], 0.0
    rate = 4 / max(1e-12, float(np.linalg.eigvalsh(x.T @ x / n)[-1]))
    least = np.append(np.full(k, rate * l1), 0.0)
    v, t = w, 1.0
    for step in range(most):
        g = gradient(x, y, v)
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - least, 0)
        if (v - new) @ (new - w) > 0:
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
        if step % 25 == 24 and gap(x, y, w, l1) <= tolerance:
            break
    return w[:-1], float(w[-1])


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the mean logistic loss."""
    return x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - y) / len(y)


def gap(x: np.ndarray, y: np.ndarray, w: np.ndarray, l1: float) -> float:
    """The most by which w (the intercept last) misses a condition of the lasso's optimum: the gradient is -l1 * sign(w), or within l1 where w is 0."""
    g, penalty = gradient(x, y, w), np.append(np.full(len(w) - 1, l1), 0.0)
    miss = np.where(w != 0, np.abs(g + penalty * np.sign(w)), np.maximum(np.abs(g) - penalty, 0))
    return float(miss.max())


class RuleEnsemble:
    """Rules with weights; score() compiles them into one column."""

    def __init__(self, names: list[str], rules: list[Rule], weights: np.ndarray, intercept: float):
        self.names, self.rules, self.weights, self.intercept = names, rules, weights, intercept

    @classmethod
    def learn(cls, names: list[str], x: np.ndarray, y: np.ndarray, l1: float = 0.001, most: int = RULES) -> RuleEnsemble:
        """Fits twice: once to choose the heaviest rules, at most ``most``, and once to weigh those."""
        rules = extract_rules(x, y)
        if not len(y) or y.min() == y.max():
            odds = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
            return cls(names, [], np.zeros(0), float(odds))
        a = np.array([covers(x, r) for r in rules], dtype=float).T.reshape(len(y), len(rules))
        for _ in range(2):
            w, b = lasso_logistic(a, y, l1)
            top = np.sort(np.argsort(-np.abs(w), kind="stable")[:most])
            top = top[w[top] != 0]
            rules, a, w = [rules[i] for i in top], a[:, top], w[top]
        return cls(names, rules, w, b)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """What score() gives, in NumPy."""
        s = self.intercept + sum((w * covers(x, r) for w, r in zip(self.weights, self.rules, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-s))

    def score(self, stats: dict[str, Column]) -> Column:
        """sigmoid(intercept + the weights of the rules that hold)."""
        total = F.lit(self.intercept)
        for w, rule in zip(self.weights, self.rules, strict=True):
            holds = reduce(lambda p, q: p & q, ((stats[self.names[j]] > cut) if above else (stats[self.names[j]] <= cut) for j, cut, above in rule))
            total = total + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE_DOCS, seed: int = 41) -> RuleEnsemble:
    """Learns labels.quality of about ``sample`` labelled documents where ``keep`` holds; only their statistics reach the driver."""
    chosen, odds = labelled_sample(labels.select("doc_id", "quality"), "quality", keep, sample, seed)
    stats = statistics()
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *[c.alias(k) for k, c in stats.items()])
    got = rows.toPandas().sort_values(["doc_id", "y", *stats], kind="stable")
    model = RuleEnsemble.learn(list(stats), got[list(stats)].to_numpy(dtype=float), got["y"].to_numpy(dtype=float))
    model.intercept += odds if len(model.weights) else 0.0
    return model


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Labels of documents whose crc32(doc_id) mod parts is ``held`` aren't read. A null text has
    the statistics of an empty one. Without labels, or with one class only, every score is the
    smoothed share of that class (0.5 without any). Repeated rows score the same each; null
    labels and null ids in labels teach nothing; an id with several labels counts by the
    largest; other columns are ignored whatever their names; an empty table gives an empty one.
    """
    out = fold("doc_id", parts) == held
    model = fit(docs, labels, ~out)
    stats = statistics()
    with_stats = docs.select("doc_id", out.alias("held_out"), *[c.alias(k) for k, c in stats.items()])
    scored = with_stats.select("doc_id", "held_out", model.score({k: F.col(k) for k in stats}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
