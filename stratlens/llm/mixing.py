"""Mixing documents to target weights with soft domain membership, in DataFrame operations only.

1. A softmax regression is fitted on labelled documents, over the beginnings (up to five characters) of all
   their words, numbers included, and marks of length, symbols and repetition; all hashed to ``DIMS`` places,
   of which the clearest few hundred have weights.
   About ``per_domain`` rows of a domain are used, chosen by a hash: the bound is a parameter.
2. Every document gets its posterior over the domains, from its whole text, and its number of tokens.
3. Nonnegative rates are fitted so that the expected tokens of each domain, the sum of rate x tokens
   x posterior, meet the targets: projected gradient steps on the squared residuals, each one pass
   over the table; the step is scaled by the small matrix of domain cross moments, which only has
   the number of domains squared entries.  Steps end when the targets are met, or when residuals no
   longer shrink; if neither happens in ``rounds`` steps there is a warning with the residuals.

Defined results: null and empty texts have no tokens, and the posterior of a text without words; their
rate is fitted like any other.  Without labelled rows there is one domain ``all``.  Targets out of reach (a
domain without tokens) leave the closest nonnegative rates.  Rows with null or repeated ids are kept; equal
texts have equal posteriors and rates.  Columns other than ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

DIMS = 4096
TARGETS = {"good": 1.05, "poor": 0.5, "toxic": 0.1}


def marked(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep..., n_tokens and marks: the distinct places of a text's word beginnings and of the marks of its shape.

    The generators keep each costly expression from being computed anew wherever it is used.
    """
    rows = docs.select(*keep, F.explode(F.array(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))))).alias("_t"))
    parts = F.struct(
        F.transform(F.array_remove(F.split("_t", r"[^\p{L}\p{N}]+"), ""), lambda w: F.left(w, F.lit(5))).alias("begins"), F.regexp_count("_t", F.lit(r"[^\p{L}\s.,]")).alias("odd"),
        F.size(F.array_remove(F.split("_t", r"\s+"), "")).cast("long").alias("n"), (F.length("_t") + 1).alias("size"),
    )
    rows = rows.select(*keep, F.explode(F.array(parts)).alias("_p"))
    rows = rows.select(*keep, "_p", F.explode(F.array(F.array_distinct("_p.begins"))).alias("_d"))
    shape = F.array(
        F.concat(F.lit("#odd"), F.least(F.lit(9), F.floor(F.sqrt(F.col("_p.odd") / F.col("_p.size")) * 12)).cast("string")),
        F.concat(F.lit("#len"), F.floor(F.log2(F.col("_p.size").cast("double"))).cast("string")),
        F.concat(F.lit("#rep"), F.floor(F.size("_d") / (F.size("_p.begins") + 1) * 8).cast("string")),
    )
    place = F.transform(F.concat("_d", shape), lambda m: F.pmod(F.xxhash64(m), F.lit(DIMS)).cast("int"))
    return rows.select(*keep, F.col("_p.n").alias("n_tokens"), F.array_distinct(place).alias("marks"))


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the table of labels."""
    name = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor")
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(name).alias("domain"))


def fit(docs: DataFrame, labelled: DataFrame, per_domain: int = 1500) -> tuple[list[str], list[list[float]], list[float]]:
    """Domains, the weights of all places for each, and biases: a softmax regression on the sample."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}
    if not sizes:
        return ["all"], [], [0.0]
    names = sorted(sizes)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for d, n in sizes.items():
        share = F.when(F.col("domain") == d, F.lit(min(1.0, per_domain / n))).otherwise(share)
    # at most 1.2 * per_domain rows a domain, by construction: the one table that is broadcast
    most = int(1.2 * per_domain) * len(names)
    few = labelled.where(chance < share).orderBy(F.xxhash64("doc_id")).limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(most)
    seen = marked(sample, "domain").select("domain", F.array_join(F.col("marks").cast("array<string>"), " ").alias("marks")).collect()
    total = sum(sizes.values())
    w, bias = _softmax([(names.index(r["domain"]), np.array(r["marks"].split(), np.int64)) for r in seen], np.array([sizes[d] / total for d in names]))
    return names, w.T.tolist(), bias.tolist()


def _clearest(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The places whose shares of the domains' rows differ most; the others would only slow the fit and blur it."""
    rate = (y.T @ x + 0.5) / (y.sum(axis=0)[:, None] + 1)
    apart = np.abs(np.log(rate) - np.log(rate).mean(axis=0))
    gain = np.where((apart.max(axis=0) > 0.3) & (rate.max(axis=0) > 0.01), (apart * rate).max(axis=0), 0.0)
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(best[gain[best] > 0])


def _softmax(rows: list[tuple[int, np.ndarray]], share: np.ndarray, rounds: int = 400, penalty: float = 2e-4, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights (places, domains) and biases; rows count so that domains have their shares of the whole.
    Only the ``most`` clearest places have weights."""
    k = len(share)
    x, y = np.zeros((len(rows), DIMS), np.float32), np.zeros((len(rows), k), np.float32)
    for i, (d, at) in enumerate(rows):
        x[i, at] = 1
        y[i, d] = 1
    if not len(rows):
        return np.zeros((DIMS, k)), np.log(share)
    used = _clearest(x, y, most)
    x = np.column_stack([x[:, used], np.ones(len(x), np.float32)])
    width = len(used)
    weight = (share / np.maximum(y.sum(axis=0), 1))[y.argmax(axis=1)].astype(np.float32)
    weight /= weight.sum()
    w = v = np.zeros((width + 1, k), np.float32)
    step = np.float32(1.0 / (0.5 * float((weight * x.sum(axis=1)).sum()) + penalty))
    ridge = np.append(np.full(width, penalty), 0.0)[:, None].astype(np.float32)
    for t in range(rounds):
        z = x @ v
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ ((e / e.sum(axis=1, keepdims=True) - y) * weight[:, None]) + ridge * v
        nxt = v - step * g
        v, w = nxt + np.float32(t / (t + 3)) * (nxt - w), nxt
    out = np.zeros((DIMS, k))
    out[used] = w[:width]
    return out, w[width].astype(float)


def posteriors(docs: DataFrame, model, *keep: str) -> DataFrame:
    """keep..., n_tokens and p, the posterior of each domain in the model's order."""
    names, table, prior = model
    rows = marked(docs, *keep)
    if not table:
        return rows.select(*keep, "n_tokens", F.array(*(F.lit(1.0 / len(names)) for _ in names)).alias("p"))
    column = [F.expr("array(" + ",".join(f"{v:.7g}D" for v in w) + ")") for w in table]
    logs = [F.aggregate(F.transform("marks", lambda k: F.get(column[i], k)), F.lit(prior[i]), lambda a, x: a + x) for i in range(len(names))]
    rows = rows.select(*keep, "n_tokens", F.explode(F.array(F.array(*logs))).alias("s"))
    rows = rows.select(*keep, "n_tokens", F.explode(F.array(F.transform("s", lambda x: F.exp(x - F.array_max("s"))))).alias("e"))
    whole = sum((F.col("e")[i] for i in range(1, len(names))), F.col("e")[0])
    return rows.select(*keep, "n_tokens", F.transform("e", lambda x: x / whole).alias("p"))


def rates(table: DataFrame, targets: list[float], scratch: Scratch, rounds: int = 25, tolerance: float = 1e-5) -> DataFrame:
    """Adds ``rate`` to a table of n_tokens and p; ``targets`` are expected tokens of each domain."""
    d = len(targets)
    goal = np.array(targets, float)
    cur, before, still = table.withColumn("rate", F.lit(1.0)), np.inf, 0
    for k in range(rounds):
        n = F.col("n_tokens").cast("double")
        p = [F.col("p")[i] for i in range(d)]
        active = F.when((F.col("rate") > 0) | F.lit(k == 0), n).otherwise(0.0)
        sums = [F.sum(F.col("rate") * n * p[i]) for i in range(d)]
        cross = [F.sum(active * p[i] * p[j]) for i in range(d) for j in range(i, d)]
        row = cur.agg(*(x.alias(f"a{i}") for i, x in enumerate([*sums, *cross]))).first()
        value = np.array([x or 0.0 for x in row], float)
        gap = goal - value[:d]
        scale = max(1.0, np.abs(goal).max())
        now = float(np.linalg.norm(gap)) / scale
        still = still + 1 if before - now <= 1e-3 * tolerance else 0
        if np.abs(gap).max() <= tolerance * scale or still >= 3:  # met, or as near as nonnegative rates get
            break
        before = min(before, now)
        g = np.zeros((d, d))
        g[np.triu_indices(d)] = value[d:]
        g = g + np.triu(g, 1).T
        step = np.linalg.lstsq(g + np.eye(d) * (1e-9 * (np.trace(g) + 1)), gap, rcond=None)[0]
        move = sum((p[i] * float(step[i]) for i in range(1, d)), p[0] * float(step[0]))
        cur = scratch.keep(cur.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") + move)), f"rates-{k}", drop=(f"rates-{k - 1}",))
    else:
        warnings.warn(f"the rates have not settled in {rounds} steps; the domains' tokens were last off by {gap.tolist()}", stacklevel=2)
    return cur


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, scratch: Scratch | None = None, keep: tuple[str, ...] = ("doc_id",), by: str = "doc_id") -> DataFrame:
    """keep..., n_tokens, p_<domain>..., rate and copies.

    ``targets`` are multiples of each domain's expected tokens (1 where a domain is not named).
    ``copies`` is the rate rounded down, or up with the chance of its fraction, by a hash of the column ``by`` (one of ``keep``).
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    targets = TARGETS if targets is None else targets
    model = fit(docs, domain(labels))
    table = scratch.keep(posteriors(docs, model, *keep), "posteriors")
    names = model[0]
    now = table.agg(*(F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"a{i}") for i in range(len(names)))).first()
    out = rates(table, [float(x or 0.0) * targets.get(d, 1.0) for d, x in zip(names, now)], scratch)
    luck = F.pmod(F.xxhash64(by, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
    return out.select(*keep, "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)), "rate", copies.alias("copies"))
