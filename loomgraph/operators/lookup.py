"""Path lookup for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def search_paths(queries: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """(q_id, path): paths that contain the query in any case, the first ``limit`` by name. Paths
    and queries meet by the query's first three characters, then are checked."""
    size = 3
    low = files.select("path", F.lower("path").alias("low"))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.substring(F.col("low"), i, k)))))
    asked = queries.select("q_id", F.lower("query").alias("q")).filter("q <> ''").withColumn("gram", F.substring("q", 1, size))
    met = low.select("path", "low", F.explode(grams).alias("gram")).join(asked, "gram").filter(F.col("low").contains(F.col("q"))).select("q_id", "path")
    order = W.partitionBy("q_id").orderBy("path")
    return met.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


VARIANT_CHARS = {1: 1000, 2: 60, 4: 20}  # wanted names up to so long meet by what is left when characters go: a few thousand strings at most


def _shortened(name: str, times: int) -> Column:
    """Hashes of the strings that are left of a column when up to ``times`` characters are deleted."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    found = [F.array(F.col(name))]
    for _ in range(times):
        found.append(F.array_distinct(F.flatten(F.transform(F.filter(found[-1], lambda s: s != ""), cut))))
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda s: F.xxhash64(s)))


def _pieces(want: DataFrame, bases: DataFrame, distance: int) -> DataFrame:
    """(q_id, want, base) that share one of ``distance`` + 1 pieces of the wanted name."""
    n = distance + 1
    part = F.floor(F.length("want") / n).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substring(F.col("want"), k * part + 1, part))
    asked = want.select("q_id", "want", F.explode(F.array_distinct(pieces)).alias("piece"), part.alias("size"))
    # Lengths differ by the distance at most, so three sizes of pieces will do for a base name.
    least, most = (F.greatest(F.floor((F.length("base") + d) / n), F.lit(1)).cast("int") for d in (-distance, distance))
    sized = bases.withColumn("size", F.explode(F.sequence(least, most))).filter(F.length("base") >= F.col("size"))
    have = sized.select("base", "size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("base") - F.col("size") + 1), lambda i: F.substring(F.col("base"), i, F.col("size"))))).alias("piece"))
    return asked.hint("merge").join(have, ["piece", "size"]).select("q_id", "want", "base")


def _near(want: DataFrame, bases: DataFrame, distance: int) -> DataFrame:
    """(q_id, want, base, dist) within ``distance`` edits. Two names are only if both can be shortened
    to one string by deleting as many characters, so short names are joined on these strings, which
    few share by chance even if all have a stem and an ending in common; long ones on pieces."""
    cut = VARIANT_CHARS.get(distance, 0)
    short, long = want.filter(F.length("want") <= cut), want.filter(F.length("want") > cut)
    left = short.select("q_id", "want", F.explode(_shortened("want", distance)).alias("h")) if cut else None
    met = _pieces(long, bases.filter(F.length("base") > cut - distance), distance)
    if cut:
        # Spark takes a table for as small as its file, however many rows it is exploded to: not to be broadcast.
        met = met.unionByName(left.hint("merge").join(bases.filter(F.length("base") <= cut + distance).select("base", F.explode(_shortened("base", distance)).alias("h")), "h").select("q_id", "want", "base"))
    return met.distinct().withColumn("dist", F.levenshtein("want", "base", distance)).filter("dist >= 0")


def resolve_path(queries: DataFrame, files: DataFrame, max_distance: int = 4) -> DataFrame:
    """(q_id, path, how): exact, then any case, then the nearest base name within
    ``max_distance`` edits (ties: distance, then path). Equal base names are looked for first, then
    those within one edit and within two, and each time only for wanted names that have none nearer:
    among numbered names over a thousand lie within two edits of any. A wanted
    name with no more characters than ``max_distance`` meets the short base names that share one of them; of
    those that share none, which differ by all the longer one's characters, the first path of each
    length will do."""
    asked = queries.select("q_id", "query")
    names = files.select("path", F.lower("path").alias("low"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("base"))
    exact = asked.join(names.select(F.col("path").alias("query"), "path"), "query").select("q_id", "path", F.lit(0).alias("rank"), F.lit(0).alias("dist"))
    cased = asked.withColumn("low", F.lower("query")).join(names.select("low", "path"), "low").select("q_id", "path", F.lit(1).alias("rank"), F.lit(0).alias("dist"))
    left = asked.join(exact.select("q_id"), "q_id", "left_anti").join(cased.select("q_id"), "q_id", "left_anti")
    left = written(left.withColumn("want", F.lower(F.element_at(F.split("query", "/"), -1))), "wanted")
    n = max_distance + 1
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bases = names.select("base").repartition(parts, "base").distinct()  # small as they lie, but each becomes many strings
    want = left.filter(F.length("want") >= n).select("q_id", "want")
    met = None
    for distance in sorted({min(d, max_distance) for d in (0, 1, 2, max_distance)}):
        if met is not None:
            want = written(want.join(met.select("q_id"), "q_id", "left_anti"), "wanted")
            if want.isEmpty():
                break
        found = written(_near(want, bases, distance), "near-names")
        met = found if met is None else met.unionByName(found)
    few = left.filter(F.length("want") < n)
    letters = lambda c: F.explode(F.array_distinct(F.split(c, ""))).alias("letter")
    alike = few.select("q_id", "want", letters("want")).hint("merge").join(bases.filter(F.length("base") < n + max_distance).select("base", letters("base")), "letter").filter("letter <> ''")
    firsts = names.filter(F.length("base") < n).groupBy(F.length("base").alias("len")).agg(F.min_by("base", "path").alias("base"))
    other = few.select("q_id", "want", F.explode(F.sequence(F.lit(0), F.lit(max_distance))).alias("len")).join(firsts, "len")
    alike = alike.select("q_id", "want", "base").unionByName(other.select("q_id", "want", "base")).distinct()
    alike = alike.withColumn("dist", F.levenshtein("want", "base", max_distance)).filter("dist >= 0")
    fuzzy = met.unionByName(alike).join(names.select("base", "path"), "base").select("q_id", "path", F.lit(2).alias("rank"), "dist")
    best = exact.unionByName(cased).unionByName(fuzzy).groupBy("q_id").agg(F.min(F.struct("rank", "dist", "path")).alias("m"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("case"), F.lit("fuzzy")), F.col("m.rank") + 1)
    return best.select("q_id", F.col("m.path").alias("path"), how.alias("how"))
