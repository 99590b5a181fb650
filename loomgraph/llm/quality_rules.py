"""Operator 3 - learned decision list over document statistics (native Spark only).

``text_statistics`` computes per-document counts with DataFrame functions alone,
``learn_decision_list`` runs sequential covering (grow a threshold conjunction on one part
of the labelled rows, prune it on the other, remove what it covers, repeat) where every step
is one grouped count over the whole labelled table, and ``DecisionList.verdict`` turns the
ordered rules into one ``CASE WHEN`` column.

Defined results: a null text counts as an empty one (all counts 0); null or repeated label
rows: nulls are ignored, of several labels of a document the lowest holds; with no labelled
row of either class the list is empty and everything is kept; ties between conditions are
broken by gain, then feature order, then threshold; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test: name -> ratio or count over the base counts.
FEATURES = ("n_words", "mean_word_chars", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate", "distinct_rate", "digit_rate", "pipe_rate")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times (a one-element ``transform``)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found at least twice. A 64-bit hash of each window
    only sorts out the documents without any repeat; the count itself compares the windows."""

    def windows(make):
        return lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 4), make(w))

    hashes = windows(lambda w: lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(5)]))
    placed = windows(lambda w: lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, 5)).alias("w"), i.alias("i")))

    def starts(rows):
        n = F.size(rows)
        twin = lambda x, j: ((j > 0) & (x["w"] == F.get(rows, F.greatest(j - 1, F.lit(0)))["w"])) | ((j < n - 1) & (x["w"] == F.get(rows, j + 1)["w"]))
        return F.sort_array(F.transform(F.filter(rows, twin), lambda x: x["i"]))

    def covered(found):
        start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"))
        return F.aggregate(found, start, step, lambda a: a["n"])

    exact = lambda w: _let(_let(F.sort_array(placed(w)), starts), covered)
    repeats = lambda w: _let(hashes(w), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(words, lambda w: F.when(repeats(w), exact(w)).otherwise(F.lit(0))))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the five base counts, and what the further features need; one narrow pass. Columns
    named in ``carried`` pass through."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *carried, t.alias("_t"), words_of(t).alias("_w"), F.split(t, "\n").alias("_lines"))
    lines = F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    digits = "0123456789"
    return base.select(
        "doc_id",
        *carried,
        F.size("_w").cast("long").alias("n_words"),
        F.coalesce(F.length(F.regexp_replace("_t", SPACE, "")), F.lit(0)).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        (F.length("_t") - F.length(F.regexp_replace("_t", "[A-ZÀ-ÖØ-Þ]+", ""))).cast("long").alias("n_upper"),
        removed("!").cast("long").alias("n_bangs"),
        removed(digits).cast("long").alias("n_digits"),
        removed("|").cast("long").alias("n_pipes"),
    )


def features(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_rate"),
        (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("n_upper") / chars).alias("upper_rate"),
        (F.col("n_bangs") / words).alias("bang_rate"),
        (F.col("n_distinct") / words).alias("distinct_rate"),
        (F.col("n_digits") / chars).alias("digit_rate"),
        (F.col("n_pipes") / words).alias("pipe_rate"),
    )


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` (above) or ``feature <= threshold``."""

    feature: str
    threshold: float
    above: bool

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that matches rejects the document, else it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def matched(self) -> Column:
        """Index of the first matching rule, -1 without one: one conditional expression."""
        out: Column | None = None
        for i, rule in enumerate(self.rules):
            hit = _all(rule)
            out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
        return F.lit(-1) if out is None else out.otherwise(F.lit(-1))

    def verdict(self) -> Column:
        return self.matched() == -1

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r))}" for r in self.rules) or "keep all"


def _all(rule: list[Condition]) -> Column:
    hit = F.lit(True)
    for c in rule:
        hit = hit & c.column()
    return hit


def _cuts(labelled: DataFrame, names: tuple[str, ...], steps: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature within each class."""
    asked = [k / steps for k in range(steps + 1)]
    rows = labelled.groupBy("bad").agg(*[F.percentile_approx(F.col(f).cast("double"), asked, 10_000).alias(f) for f in names]).collect()
    return {f: sorted({x for r in rows for x in (r[f] or []) if x is not None}) for f in names}


def learn_decision_list(
    labelled: DataFrame,
    names: tuple[str, ...] = FEATURES,
    steps: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_cover: int = 3,
) -> DecisionList:
    """Sequential covering over ``labelled`` (features, ``bad`` 0/1, ``part`` grow/prune).

    Only histograms come to the driver: at most len(names) x thresholds x 4 counts a step.
    Bin b of a feature means: b thresholds lie below the value, so each histogram gives the
    cover of every ``>`` and ``<=`` condition on that feature by a running sum.
    """
    cuts = _cuts(labelled, names, steps)
    names = tuple(f for f in names if cuts.get(f))
    if not names:
        return DecisionList()

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts[f]]), lambda x: F.col(f).cast("double") > x))

    binned = written(labelled.select("bad", "part", *[F.col(f).cast("double").alias(f) for f in names], *[bin_of(f).alias(f"bin_{f}") for f in names]), "binned")

    def histogram(rows: DataFrame) -> dict[str, dict[int, list[int]]]:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"bin_{f}").alias("b")) for i, f in enumerate(names)]))
        found = rows.select(pairs.alias("x"), "bad").groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        out: dict[str, dict[int, list[int]]] = {f: {} for f in names}
        for r in found:
            out[names[r["f"]]][r["b"]] = [r["p"], r["n"]]
        return out

    def score(p: float, n: float, p0: float, n0: float) -> float:
        """FOIL gain of narrowing (p0, n0) to (p, n)."""
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0

    def best(hist, p0: int, n0: int):
        top = None
        for f in names:
            low = [0, 0]
            for b, cut in enumerate(cuts[f]):
                at = hist[f].get(b, [0, 0])
                low = [low[0] + at[0], low[1] + at[1]]
                for above, (p, n) in ((True, (p0 - low[0], n0 - low[1])), (False, tuple(low))):
                    gain = score(p, n, p0, n0)
                    if p >= min_cover and gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, Condition(f, cut, above), p, n, cut)
                    elif top and top[1].feature == f and top[1].above == above and (p, n) == top[2:4]:
                        # no row lies between the tied cuts: take the middle of the gap
                        top = (*top[:1], Condition(f, (top[4] + cut) / 2, above), p, n, top[4])
        return top and top[:4]

    rules: list[list[Condition]] = []
    left = binned
    for _ in range(max_rules):
        grow, rule = left.filter("part = 'grow'"), []
        hist = histogram(grow)
        p0, n0 = (sum(v[k] for v in hist[names[0]].values()) for k in (0, 1))
        if p0 < min_cover:
            break
        while len(rule) < max_conditions and n0 and (found := best(hist, p0, n0)):
            _, condition, p0, n0 = found
            rule.append(condition)
            if n0 and len(rule) < max_conditions:
                hist = histogram(grow.filter(_all(rule)))
        if not rule:
            break
        prune = left.filter("part = 'prune'")
        heads = [rule[: k + 1] for k in range(len(rule))]
        got = prune.agg(*[F.coalesce(F.sum(F.when(_all(h), x)), F.lit(0)).alias(f"{a}{k}") for k, h in enumerate(heads) for a, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((got[f"p{k}"] - got[f"n{k}"]) / max(1, got[f"p{k}"] + got[f"n{k}"]), -k) for k in range(len(rule))]
        k = -max(worth)[1]
        rule = heads[k]
        hits, wrong = got[f"p{k}"], got[f"n{k}"]
        if hits + wrong == 0 or hits / (hits + wrong) < min_precision:
            break
        rules.append(rule)
        left = left.filter(~_all(rule))
    return DecisionList(rules)


def with_labels(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Labelled rows with ``bad`` and a grow/prune part dealt by a hash of the id."""
    marks = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((1 - F.min(label_col)).cast("int").alias("bad"))
    part = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, "prune").otherwise("grow")
    return stats.join(marks, "doc_id").withColumn("part", part)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DecisionList]:
    """Statistics, verdict columns and the learned list. Rules are learned from labelled
    documents that pass the base test, as only those depend on them."""
    stats = written(features(text_statistics(docs, carried=carried)), "stats").withColumn("base_failed", base_failed())
    rules = learn_decision_list(with_labels(stats.filter("NOT base_failed"), labels))
    return stats.withColumn("rule", F.when(F.col("base_failed"), -1).otherwise(rules.matched())).withColumn("kept", ~F.col("base_failed") & rules.verdict()), rules
