"""Operator 9 - quality scores: random Fourier features, ridge normal equations, isotonic map.

Document statistics are computed by Spark, standardised with sums over the training rows, and
mapped to ``features`` cosines whose products approximate a Gaussian kernel. Each task adds up
its rows' normal equations; the driver gets one matrix of fixed size a task, adds them and
solves the ridge system. Scores of the calibration fold, counted in ``bins`` equal bins, give
the isotonic (pool adjacent violators) map from score to probability.

The labels never enter a score other than through the fitted numbers: a row of the held-out
fold has no part in them. Folds: crc32(doc_id as text) mod 3 = 1 is held out, 0 calibrates, 2
fits. All labelled rows of the folds are used; nothing is sampled.

Defined results: null texts count as empty ones, which get a score like any text; of several
labels of a document the lowest holds, null labels are ignored; a null doc_id is scored and is
in no training fold; without labels of both classes every score is the share of 1 (0.5 without
any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

STATS = (
    "log_chars", "log_words", "mean_word", "distinct", "upper", "digits", "punctuation", "symbols",
    "bangs", "pipes", "spaces", "lines", "dup_lines", "top_word", "long_words", "non_ascii",
)


def text_stats(text: Column) -> dict[str, Column]:
    """The statistics of ``STATS``, in JVM expressions over one text."""
    t = F.lower(text)
    n = F.greatest(F.length(text), F.lit(1))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    m = F.greatest(F.size(words), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    rate = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    ordered = F.array_sort(words)
    run = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(a: Column, w: Column) -> Column:
        k = F.when(a["w"] == w, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), k.alias("n"), F.greatest(a["top"], k).alias("top"))

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "mean_word": F.least(F.length(F.regexp_replace(text, r"\s+", "")) / m, F.lit(40.0)),
        "distinct": F.size(F.array_distinct(words)) / m,
        "upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]+", ""))) / n,
        "digits": rate("0123456789"),
        "punctuation": rate(".,;:?'\"()-"),
        "symbols": rate("#*$%&<>"),
        "bangs": rate("!"),
        "pipes": rate("|"),
        "spaces": rate(" "),
        "lines": F.log1p(F.size(lines).cast("double")),
        "dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))) / F.greatest(F.size(lines), F.lit(1)),
        "top_word": F.aggregate(ordered, run, step, lambda a: a["top"]) / m,
        "long_words": F.size(F.filter(words, lambda w: F.length(w) > 15)) / m,
        "non_ascii": (F.length(t) - F.length(F.regexp_replace(t, r"[^\x00-\x7F]+", ""))) / n,
    }


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features, stats)
    phase: np.ndarray
    beta: np.ndarray
    edges: np.ndarray  # calibration: score bin -> probability
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cos = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.weights.T + self.phase)
        return np.column_stack([cos, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0.0, 1.0)


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of ``y`` with weights ``w``."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, k, n = blocks.pop()
            u, j, m = blocks.pop()
            blocks.append([(u * j + v * k) / (j + k), j + k, n + m])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(labelled: DataFrame, features: int = 256, gamma: float = 0.08, ridge: float = 1e-3, bins: int = 400, seed: int = 7) -> Model:
    """``labelled``: the STATS columns, ``label`` 0/1 and ``fold`` ('fit' or 'calibrate')."""
    rows = labelled.filter("fold = 'fit'")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"), *[f(c).alias(f"{k}_{c}") for c in STATS for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([sums[f"m_{c}"] or 0.0 for c in STATS])
    scale = np.array([max(sums[f"s_{c}"] or 0.0, 1e-6) for c in STATS])
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (features, len(STATS))), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if not sums["n"] or sums["rate"] in (0.0, 1.0):
        model.values = np.full(2, 0.5 if not sums["n"] else float(sums["rate"]))
        return model

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            z, y = model.features(b[list(STATS)].to_numpy(float)), b["label"].to_numpy(float)
            left += z.T @ z
            right += z.T @ y
        yield pd.DataFrame({"row": np.arange(features + 1), "values": [np.append(a, r) for a, r in zip(left, right, strict=True)]})

    # Partition sums meet row by row of the matrix, added up by Spark before the driver sees one system.
    cells = rows.select(*STATS, "label").mapInPandas(equations, "row int, values array<double>")
    total = cells.select("row", F.posexplode("values").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
    system = np.zeros((features + 1, features + 2))
    system[total["row"], total["col"]] = total["v"]
    left, right = system[:, :-1], system[:, -1]
    penalty = ridge * sums["n"] / (features + 1) * np.eye(features + 1)
    penalty[-1, -1] = 0.0
    model.beta = np.linalg.solve(left + penalty, right)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = model.raw(b[list(STATS)].to_numpy(float))
            yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * bins, 0, bins - 1).astype(int), "label": b["label"]})

    counts = labelled.filter("fold = 'calibrate'").select(*STATS, "label").mapInPandas(binned, "bin int, label int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).toPandas().sort_values("bin")
    if len(counts):
        model.edges = (counts["bin"].to_numpy() + 0.5) / bins * 2 - 0.5
        model.values = isotonic(counts["y"].to_numpy(float), counts["n"].to_numpy(float))
    else:
        model.values = np.array([0.0, 1.0])
    return model


def remainder(id_col: str = "doc_id", folds: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_t"))
    stats = written(stats.select("doc_id", *[c.cast("double").alias(k) for k, c in text_stats(F.col("_t")).items()]), "stats")
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    fold = F.when(remainder("doc_id") == 0, "calibrate").otherwise("fit")
    labelled = written(stats.join(marks.filter(remainder("doc_id") != 1), "doc_id").withColumn("fold", fold), "labelled")
    model = fit(labelled, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(b[list(STATS)].to_numpy(float))})

    scored = stats.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
