"""Mixing to target weights by soft domain membership, in DataFrame operations only."""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.llm.common import discard, small_or_not, written

#: Domains that the rates are fitted for at most; the model's tables are that wide.
MOST_DOMAINS = 64
STEPS, TOLERANCE = 100, 5e-3
#: Shares of the greatest curvature by which steps are damped; steps after which the rates are written, so that expressions stay short.
DAMPED, WRITTEN = (0.0, 1e-4, 1e-3, 1e-2, 0.1, 1.0), 12


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, language, n_tokens and the coarse traits (name=step) that the classifier reads."""
    d = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("language"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    d = d.withColumn("w", F.filter(F.split("text", "[ \\n\\t\\r]+"), lambda x: x != ""))
    n = F.col("n_tokens").cast("double")
    size = F.greatest(F.lit(1), F.length("text")).cast("double")
    d = d.select(
        "doc_id", "language", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"),
        "text", F.regexp_count("text", F.lit("[$%&#*|!<>{}=_]")).alias("n_signs"), F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
    )

    def step(value: Column, most: int) -> Column:
        return F.least(F.lit(most), F.floor(value)).cast("string")

    traits = {
        "language": F.col("language"),
        "length": step(F.log2(n + 1), 24),
        "word": step(size / F.greatest(n, F.lit(1.0)), 16),
        "distinct": step(F.col("n_distinct") / F.greatest(n, F.lit(1.0)) * 10, 10),
        "signs": step(F.log2(F.col("n_signs") / size * 1000 + 1), 10),
        "upper": step(F.log2(F.col("n_upper") / size * 1000 + 1), 10),
    }
    return d.select("doc_id", "language", "n_tokens", F.array(*(F.concat(F.lit(f"{k}="), v) for k, v in traits.items())).alias("traits"))


def _domains(d: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Domains of the labelled table, log-likelihoods of each trait by domain, log-priors: naive Bayes by counting."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).alias("y"))
    known = d.join(known, "doc_id").withColumn("domain", F.concat_ws("/", "language", F.col("y").cast("string")))
    totals = known.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()
    if len(totals) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    names = [r["domain"] for r in totals]
    place = {name: i for i, name in enumerate(names)}
    counts: dict[str, list[int]] = {}
    # a trait has at most some tens of steps, and languages are no more than domains
    for r in known.select("domain", F.explode("traits").alias("trait")).groupBy("domain", "trait").count().collect():
        counts.setdefault(r["trait"], [0] * len(names))[place[r["domain"]]] = r["count"]
    model = {t: [math.log((c + 0.5) / (r["n"] + 10.0)) for c, r in zip(row, totals, strict=True)] for t, row in counts.items()}
    whole = sum(r["n"] for r in totals)
    return names, model, [math.log(r["n"] / whole) for r in totals]


def posteriors(d: DataFrame, model: dict[str, list[float]], prior: list[float]) -> DataFrame:
    """The column posterior: chances of the domains, in order. A trait never seen with a label says nothing."""
    table = F.from_json(F.lit(json.dumps(model)), "map<string,array<double>>")
    flat = F.array(*(F.lit(0.0) for _ in prior))
    score = F.aggregate(
        "traits", F.array(*(F.lit(p) for p in prior)),
        lambda acc, t: F.zip_with(acc, F.coalesce(F.try_element_at(table, t), flat), lambda a, b: a + b),
    )
    d = d.withColumn("score", score).withColumn("e", F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    return d.withColumn("total", total).withColumn("posterior", F.transform("e", lambda x: x / F.col("total")))


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.7,
    key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality",
) -> DataFrame:
    """A nonnegative rate for every document such that expected token totals of the domains match targets.

    A domain is a language with a label, as found in the labelled table. A naive Bayes classifier counted on all
    labelled rows gives each document its chances p_ik of the domains. Rates r minimise the sum over domains k of
    (sum_i tokens_i p_ik r_i - b_k)^2 / b_k, by projected gradient from 1: each step adds a multiple of the gradient,
    which Spark sums over all documents, and cuts rates at 0. Chances depend on the traits alone, so documents that agree
    in them share a rate, and the steps run on one row for each set of traits.
    targets: b_k by domain, 0 where one is not named (its gap is weighed by the mean target); without them, present totals
    times (share_k / largest share)^(temperature - 1), so the largest domain stays and small ones grow. Domains whose
    totals end off by more than TOLERANCE, as no nonnegative rates reach their targets, are named in a warning.

    Returns doc_id, domain (likeliest), n_tokens, rate. Null or empty text: no tokens, its rate is what its traits say.
    Null language: as the empty one. Rows that share an id: each its own. No labelled rows, or no tokens: domain null,
    rate 1. Empty table: no rows. Other columns are not carried.
    """
    d = written(described(docs, key, text, lang), "described")
    names, model, prior = _domains(d, labels, key, label)
    if not names:
        return d.select("doc_id", F.lit(None).cast("string").alias("domain"), "n_tokens", F.lit(1.0).alias("rate"))
    best = F.get(F.array(*(F.lit(x) for x in names)), (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    sets = d.groupBy("traits").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    system = posteriors(sets, model, prior).select("traits", "tokens", "posterior", best.alias("domain"), F.lit(1.0).alias("r"))
    system = written(system, "system")
    now = [x or 0.0 for x in system.agg(*(F.sum(F.col("tokens") * F.get("posterior", F.lit(k))) for k in range(len(names)))).first()]
    most = max(now)
    if most <= 0:
        rates = system.select("traits", "domain", "r")
    else:
        if targets is None:
            goal = [max(t, 1e-9 * most) * (max(t, 1e-9 * most) / most) ** (temperature - 1) for t in now]
        else:
            goal = [max(float(targets.get(x, 0.0)), 0.0) for x in names]
        rates, off = _solved(system, np.array(goal))
        missed = {x: round(float(o), 4) for x, o in zip(names, off, strict=True) if abs(o) > TOLERANCE}
        if missed:
            warnings.warn(f"mixing targets not reached, gaps as shares of them: {missed}", stacklevel=2)
    out = d.join(small_or_not(rates), "traits")
    return out.select("doc_id", "domain", "n_tokens", F.round("r", 9).alias("rate"))


def _literal(rows: list[np.ndarray]) -> str:
    """An array of arrays; one literal, so that plans are the same whatever the numbers and their compiled code is used again."""
    return "array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in row) + ")" for row in rows) + ")"


def _dot(s: str) -> str:
    return f"aggregate(zip_with(posterior, {s}, (a, b) -> a * b), 0D, (a, b) -> a + b)"


def _stepped(steps: list[np.ndarray]) -> Column:
    """The rate after projected steps: r becomes max(0, r + posterior . step), one after the other."""
    return F.expr(f"aggregate({_literal(steps)}, r, (x, s) -> greatest(0D, x + {_dot('s')}))") if steps else F.col("r")


def _solved(system: DataFrame, goal: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """Rows traits, domain, r of the projected-gradient fit, and the gaps left as shares of the targets.

    With gaps g = totals - goal, the gradient of a rate (in the metric of tokens) is posterior . (g / scale). Plain steps
    crawl where domains differ in size, so a step is the gradient scaled by the inverse of (C + d I), C being the
    curvature of the domains over the rates that can move and d one of DAMPED times its greatest eigenvalue: from the
    full scaling to about the plain step. All tried steps are projected and summed in one aggregation, and the best is
    taken. Steps end at the targets or, where no nonnegative rates reach them, when none brings the objective down.
    """
    n = len(goal)
    scale = np.where(goal > 0, goal, goal.sum() / n or 1.0)
    root = np.sqrt(scale)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    p = [F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(n)]
    totals = [F.sum(F.expr(f"w * r * p{i}")).alias(f"t{i}") for i in range(n)]

    def curvature(steps: list[np.ndarray], gap: np.ndarray) -> np.ndarray:
        rows = system.select(F.col("tokens").alias("w"), _stepped(steps).alias("r"), F.expr(f"aggregate(transform({_literal([gap / scale])}, s -> {_dot('s')}), 0D, (a, b) -> a + b)").alias("g"), *p)
        got = rows.where("r > 0 or g < 0").agg(*(F.sum(F.expr(f"w * p{i} * p{j}")) for i, j in pairs)).first()
        out = np.zeros((n, n))
        for (i, j), x in zip(pairs, got, strict=True):
            out[i, j] = out[j, i] = x or 0.0
        return out / np.outer(root, root)

    def gaps(steps: list[np.ndarray], tries: list[np.ndarray]) -> np.ndarray:
        """Gaps after the steps and each of the tried ones."""
        rows = system.select(F.col("tokens").alias("w"), _stepped(steps).alias("r"), "posterior", *p)
        rates = F.expr(f"transform({_literal(tries)}, s -> greatest(0D, r + {_dot('s')}))")
        rows = rows.select("w", F.posexplode(rates).alias("number", "r"), *(f"p{i}" for i in range(n)))
        got = {r["number"]: [r[f"t{i}"] or 0.0 for i in range(n)] for r in rows.groupBy("number").agg(*totals).collect()}
        return np.array([got[k] for k in range(len(tries))]) - goal

    def objective(gap: np.ndarray) -> np.ndarray:
        return (gap * gap / scale).sum(-1)

    steps: list[np.ndarray] = []
    gap = gaps([], [np.zeros(n)])[0]
    for _ in range(STEPS):
        if np.abs(gap / scale).max() < TOLERANCE / 1000:
            break
        curve = curvature(steps, gap)
        most = max(np.linalg.eigvalsh(curve)[-1], 1e-300)
        tries = [-np.linalg.lstsq(curve + d * most * np.eye(n), gap / root, rcond=1e-12)[0] / root for d in DAMPED]
        tries += [s / 4 for s in tries]
        found = gaps(steps, tries)
        best = int(np.argmin(objective(found)))
        if not objective(found[best]) < objective(gap) * (1 - 1e-7):
            break
        steps.append(tries[best])
        gap = found[best]
        if len(steps) == WRITTEN:
            before, system = system, written(system.withColumn("r", _stepped(steps)), "system")
            discard(before)
            steps = []
    return system.select("traits", "domain", _stepped(steps).alias("r")), gap / scale


def copies(rate: Column, key: Column, at_least: int = 0) -> Column:
    """A whole number of copies whose mean over keys is the rate: floor(rate + u), u in [0, 1) from a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    return F.greatest(F.lit(at_least), F.floor(rate + u)).cast("int")
