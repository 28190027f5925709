"""Quality: document evidence, and host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import least_hashed, raw_bytes
from tasksieve.session import checkpointed

#: Labelled rows of each class that the classifier is fitted on at most.
ROWS_PER_CLASS = 4000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
BLANK = b" \t\n\r\x0b\x0c"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-|")


def text_features(raw: bytes) -> list[float]:
    """Shares of kinds of characters, words and lines in a whole text."""
    size = max(1, len(raw))
    count = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    upper, lower = count(UPPER), count(LOWER)
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANK)]
    return [math.log1p(len(raw)), math.log1p(len(words)), upper / max(1, upper + lower), count(DIGITS) / size, count(SYMBOLS) / size * 10, raw.count(b"!") / n,
            raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n, sum(map(len, words)) / n / 10, len(set(words)) / n,
            len(set(lines)) / max(1, len(lines)), len(lines) / n * 10, raw.count(b"http") / n * 10, raw.count(b"\xc3") / size * 10]


@dataclass
class Evidence:
    """A logistic model on standardised features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        return np.c_[x, x * x]

    def logits(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((self.expand(features) - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit_evidence(features: np.ndarray, good: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Evidence:
    """Logistic regression by Newton steps with a ridge."""
    x = Evidence.expand(features)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - good) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w)


def _logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(safe / (1 - safe))


def prior_strength(groups: DataFrame, within: str, centre: Column, rows: str = "n", rate: str = "rate") -> float:
    """How many rows the prior counts for: variance within groups over variance between them, by moments.

    ``groups`` has a row per group with its number of rows, its rate and its sum of squares about the
    rate (``within``).  Without any variance between groups the prior is as strong as all rows.
    """
    n = F.col(rows).cast("double")
    s = groups.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(within).alias("inside"), F.sum(n * n).alias("n2"), F.sum(n * (F.col(rate) - centre) ** 2).alias("across")).first()
    if not s["n"]:
        return 1.0
    sigma = (s["inside"] or 0.0) / max(1.0, s["n"] - s["k"])
    spread = s["n"] - s["n2"] / s["n"]
    between = ((s["across"] or 0.0) - (s["k"] - 1) * sigma) / spread if spread > 0 else 0.0
    return min(max(sigma / between, 1.0), s["n"]) if between > 0 and sigma > 0 else max(1.0, s["n"])


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang",
                   label_id: str = "doc_id", label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``evidence``, ``host_rate``, ``path_rate``, ``quality``, ``kept``.

    The classifier is fitted on a bounded sample of labelled rows (those with the least hash of the
    id) and read as the chance p that a text alone is good.  Over all rows, p is averaged by host and
    by path within host.  A host's rate is drawn towards the global one, a path's towards its host's,
    each the more the fewer rows it has; the strengths come from the moments of all groups.  A row's
    own p is left out of the posterior that judges it.  In log odds, quality = evidence + path rate -
    global rate, kept from 0.5 on.

    Null and blank texts have evidence and quality 0 and take no part in rates; null hosts and paths
    are groups of their own; without labels of both classes every other text has evidence 0.5.  Rows
    that repeat an id are judged each for itself.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), raw_bytes(f"`{text}`").alias("raw"))
    known = labels.select(F.col(f"`{label_id}`").alias("lk"), F.col(f"`{label}`").cast("int").alias("good")).filter("good in (0, 1) and lk is not null")
    known = known.groupBy("lk").agg(F.max("good").alias("good"))
    chosen = least_hashed(known.withColumn("hash", F.xxhash64("lk")), "good", "hash", [F.asc("lk")], rows_per_class).select("lk", "good")  # 2 x rows_per_class rows
    kind = "array<double>"

    @F.pandas_udf(kind)
    def features(raw: pd.Series) -> pd.Series:
        return pd.Series([text_features(x) for x in raw])

    sample = rows.join(F.broadcast(chosen), F.col("key") == F.col("lk")).select("key", "good", features("raw").alias("x")).toArrow().to_pylist()
    sample.sort(key=lambda r: (r["key"], r["x"]))
    good = np.array([r["good"] for r in sample], np.float64)
    model = fit_evidence(np.array([r["x"] for r in sample]), good) if 0 < good.sum() < len(good) else None

    @F.pandas_udf("double")
    def chance(raw: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.5 if x.strip() else None for x in raw], dtype="float64")
        p = 1 / (1 + np.exp(-model.logits(np.array([text_features(x) for x in raw]).reshape(len(raw), -1))))
        return pd.Series(np.where([bool(x.strip()) for x in raw], p, np.nan))

    judged = checkpointed(rows.select("key", "host", "path", chance("raw").alias("p"))
                          .select("key", "host", "path", F.when(F.col("p").isNotNull() & ~F.isnan("p"), F.col("p")).alias("p")))
    some = judged.filter("p is not null")
    square = lambda s, n: F.greatest(F.sum(F.col("p") * F.col("p")) - s * s / n, F.lit(0.0))
    paths = checkpointed(some.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n"), square(F.sum("p"), F.count("*")).alias("within"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"), F.sum("q").alias("hq"))
    hosts = checkpointed(hosts.withColumn("rate", F.col("hs") / F.col("hn")).withColumn("within", F.greatest(F.col("hq") - F.col("hs") * F.col("rate"), F.lit(0.0))))
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    mu = (total[0] / total[1]) if total[1] else 0.5
    strength = prior_strength(hosts, "within", F.lit(mu), "hn")
    posterior = hosts.select(F.col("host").alias("h"), ((F.col("hs") + strength * mu) / (F.col("hn") + strength)).alias("host_rate"), F.col("rate").alias("raw_rate"))
    rated = checkpointed(paths.withColumn("rate", F.col("s") / F.col("n")).join(posterior, F.col("host").eqNullSafe(F.col("h"))))
    path_strength = prior_strength(rated, "within", F.col("raw_rate"))
    rates = rated.select("h", F.col("path").alias("pp"), "s", "n", "host_rate")
    joined = judged.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("pp")), "left")
    others = (F.col("s") - F.col("p") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength)
    odds = _logit(F.col("p")) + _logit(others) - F.lit(math.log(max(mu, 1e-6) / max(1 - mu, 1e-6)))
    quality = F.when(F.col("p").isNull(), 0.0).otherwise(1 / (1 + F.exp(-odds)))
    shown = (F.col("s") + path_strength * F.col("host_rate")) / (F.col("n") + path_strength)
    return joined.select("key", F.coalesce("p", F.lit(0.0)).alias("evidence"), "host_rate", shown.alias("path_rate"), quality.alias("quality"), (quality >= 0.5).alias("kept"))
