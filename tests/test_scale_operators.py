"""Operators whose work is cut into bounded tasks, against plain sequential versions."""

import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomgraph.operators import cells
from loomgraph.operators import communities as C
from loomgraph.operators import entities as N
from loomgraph.operators import vectors as V
from loomgraph.plans.fixtures import Tables
from loomgraph.sources.scratch import written

# --- similar pairs ---------------------------------------------------------------------------


def clustered(n=240, dims=8, hot=60, seed=1):
    """Vectors around a few centres, a third of them in one of these, some equal, some zero."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    of = [0 if i < hot else i % 7 for i in range(n)]
    v = [(centres[c] + 0.3 * rng.normal(size=dims)).round(3).tolist() for c in of]
    for i in range(0, n, 9):
        v[i] = v[3]
    v[5] = v[50] = [0.0] * dims
    return v


def scores(vectors):
    unit = np.array([np.array(v) / (np.linalg.norm(v) or 1) for v in vectors])
    return np.round(unit @ unit.T, 4)


def best(score, ids, threshold, k, off=frozenset()):
    out = set()
    for i, a in enumerate(ids):
        near = sorted(((-score[i, j], b) for j, b in enumerate(ids) if j != i and score[i, j] >= threshold and (a, b) not in off))
        out |= {(a, b) for _, b in near[:k]}
    return out


@pytest.mark.parametrize(("block", "lane", "threshold"), [(None, None, 0.7), (25, 40, 0.7), (10, 1000, 0.97), (60, 15, -1.0)])
def test_cell_pairs_equal_all_pairs(spark, block, lane, threshold):
    vectors = clustered()
    ids = [f"s{i:03d}" for i in range(len(vectors))]
    rows = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "item_id string, embedding array<double>")
    everything = cells.cell_pairs(rows.withColumn("room", F.lit(None).cast("int")), threshold, block_rows=block, lane_rows=lane).collect()
    score = scores(vectors)
    want = {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if i != j and score[i, j] >= threshold}
    assert {(r["src"], r["dst"]) for r in everything} == want
    assert len(everything) == len(want)  # each pair meets in one task
    few = cells.cell_pairs(rows.withColumn("room", F.lit(2)), threshold, block_rows=block, lane_rows=lane).collect()
    kept = {}
    for r in few:
        kept.setdefault(r["src"], []).append((-r["score"], r["dst"]))
    assert {(a, b) for a, near in kept.items() for _, b in sorted(near)[:2]} == best(score, ids, threshold, 2)


def test_bounds_save_copies_and_blocks_stay_small(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    vectors = [(centres[i % 12] + 0.02 * rng.normal(size=32)).tolist() for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "item_id long, embedding array<double>").withColumn("room", F.lit(3))
    made = cells.metric_cells(rows, 0.95, block_rows=50, lane_rows=200)
    sent = made.dealt().groupBy("task", "kind").count().collect()
    assert max(r["count"] for r in sent if r["kind"] == 1) <= 75  # hashing deals a large cell out unevenly
    visits = sum(r["count"] for r in sent if r["kind"] == 2)
    assert visits < 0.25 * len(vectors) * (len(made.blocks) - 1) / 2  # without bounds every row visits all later blocks
    per_task = made.pairs(0.95).groupBy("src").count().agg(F.max("count")).first()[0]
    assert per_task <= 3 * len(made.lanes)


def test_similar_pairs_by_cells_with_hub_and_copies(spark):
    vectors = clustered(150, hot=50)
    ids = list(range(150))
    rows = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "item_id long, embedding array<double>")
    hub = [(20, j) for j in range(21, 150)] + [(j, 3) for j in range(30, 90)]
    off = {*hub, *((b, a) for a, b in hub)}
    exclude = spark.createDataFrame(hub, "src long, dst long")
    got = V.similar_pairs(rows, 0.7, 3, exclude, method="cells").collect()
    assert {(r["src"], r["dst"]) for r in got} == best(scores(vectors), ids, 0.7, 3, off)
    plain = {(r["src"], r["dst"], r["score"]) for r in V.similar_pairs(rows, 0.7, 3).collect()}
    assert {(r["src"], r["dst"], r["score"]) for r in V.similar_pairs(rows, 0.7, 3, method="cells").collect()} == plain


def test_cells_of_no_and_odd_vectors(spark):
    kind = "item_id long, embedding array<double>"
    for rows in ([], [(1, [])], [(1, [0.0, 0.0]), (2, [0.0, 0.0])], [(1, [1.0, 0.0])]):
        assert V.similar_pairs(spark.createDataFrame(rows, kind), 0.5, 3, method="cells").count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0])], kind)
    assert {(r["src"], r["dst"]) for r in V.similar_pairs(mixed, 0.5, 3, method="cells").collect()} == {(1, 2), (2, 1)}


def test_near_duplicates_compare_numbers(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(12)], "item_id long, embedding array<double>")
    got = {(r["item_id"], r["twin"], r["score"]) for r in V.near_duplicates(rows, 0.99).collect()}
    assert got == {(i, i % 3, 1.0) for i in range(3, 12)}


# --- next-fit --------------------------------------------------------------------------------


def sequential(tokens, cap):
    batch, held, out = 0, 0, []
    for t in tokens:
        if held and held + t > cap:
            batch, held = batch + 1, 0
        held += t
        out.append(batch)
    return out


def test_fill_steps_tell_every_start():
    rng = random.Random(1)
    for _ in range(400):
        cap = rng.randint(1, 12)
        tokens = [rng.randint(1, rng.choice([3, cap, 2 * cap])) for _ in range(rng.randint(1, 9))]
        steps = N.fill_steps(tokens, cap)
        assert len({s[0] for s in steps}) == len(steps)
        for held in range(cap + 1):
            batch, after = N.packed(tokens, cap, held)
            step = max((s for s in steps if s[0] <= held), key=lambda s: s[0])
            assert (min(cap, held + sum(tokens)) if step[1] is None else step[1], step[2]) == (after, batch[-1])


@pytest.mark.parametrize("cap", [1, 20, 100])
def test_next_fit_equals_the_sequential_result_for_all_ranges(spark, cap):
    rng = random.Random(cap)
    tokens = [rng.choice([1, 2, 5, 19, 20, 21, 60, 130]) for _ in range(83)]
    files = spark.createDataFrame([(f"f{i:03d}", t) for i, t in enumerate(tokens)], "file_id string, tokens long").repartition(5)
    want = {f"f{i:03d}": f"000000-{b:08d}" for i, b in enumerate(sequential(tokens, cap))}
    for ranges in (None, 2, 7, 83):
        assert {r["file_id"]: r["batch_id"] for r in N.next_fit(files, cap, ranges).collect()} == want
    assert N.next_fit(files.limit(0), cap).count() == 0


# --- leader clustering -----------------------------------------------------------------------


def plain_leaders(rows, threshold=0.5):
    """The sequential fold in key order."""
    sums, sizes, lead, out = [], [], [], {}
    for key, v in sorted(rows):
        x = np.array(v)
        score = [round(float(x @ s / np.linalg.norm(x) / np.linalg.norm(s)), 4) for s in sums]
        at = max(range(len(score)), key=lambda c: (score[c], -c), default=-1)
        if at < 0 or score[at] < threshold:
            at = len(sums)
            sums.append(x * 0)
            sizes.append(0)
            lead.append(key)
        sums[at] = sums[at] + x
        sizes[at] += 1
        out[key] = lead[at]
    return out


def grouped(found):
    sets = {}
    for key, c in found.items():
        sets.setdefault(c, set()).add(key)
    return sorted(map(sorted, sets.values()))


def leaders(df, **more):
    return {r["section_key"]: r["community_id"] for r in C.leader_cluster(df, **more).collect()}


@pytest.fixture(scope="module")
def apart(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(f"k{i:03d}", (centres[(i * 7) % 9] + 0.05 * rng.normal(size=16)).tolist()) for i in range(180)]
    return rows, spark.createDataFrame([(k, f"h {k}", v) for k, v in rows], "node_key string, heading_path string, embedding array<double>")


def test_leaders_in_one_run_are_the_sequential_result(apart):
    rows, df = apart
    assert grouped(leaders(df)) == grouped(plain_leaders(rows))


@pytest.mark.parametrize("size", [7, 20, 64])
def test_leaders_in_a_tree_of_runs(apart, size):
    rows, df = apart
    first = leaders(df.repartition(3), rows_a_group=size)
    assert grouped(first) == grouped(plain_leaders(rows))  # groups that are well apart: the tree loses nothing
    assert leaders(df.repartition(11), rows_a_group=size) == first


def test_leaders_of_the_given_sections_in_runs(spark):
    df = written(Tables(spark, DATA).vectors().select("node_key", "heading_path", "embedding"), "given")
    rows = [(r["node_key"], r["embedding"]) for r in df.collect() if any(r["embedding"])]
    whole, tree = leaders(df), leaders(df, rows_a_group=100)
    assert grouped({k: c for k, c in whole.items() if k in dict(rows)}) == grouped(plain_leaders(rows))
    assert set(tree) == set(whole)
    pair = random.Random(2)
    keys = sorted(whole)
    drawn = [pair.sample(keys, 2) for _ in range(4000)]
    same = np.mean([(whole[a] == whole[b]) == (tree[a] == tree[b]) for a, b in drawn])
    print(f"pairs on which one run and runs of 100 agree: {same:.3f} of {len(keys)} sections, {len(set(whole.values()))} and {len(set(tree.values()))} clusters")
    assert same >= 0.8
