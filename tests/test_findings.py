"""Queries and operators that a review found wrong or slow, against plain versions."""

import random

import numpy as np
import pyarrow as pa
from conftest import DATA
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.operators import cells
from loomgraph.operators import entities as N
from loomgraph.operators import graph as G
from loomgraph.operators import lookup as Q
from loomgraph.operators import revisions as E
from loomgraph.operators import search as S
from loomgraph.operators import triage as P
from loomgraph.operators import vectors as V
from loomgraph.plans import registry
from loomgraph.plans.fixtures import Tables
from loomgraph.streaming import live


def test_cached_embed_has_the_rows_of_its_sql_and_the_vectors_of_the_model(spark, duck):
    rows = registry.queries()["v5_cached_embed"](spark, DATA)
    result = duck.execute(registry.oracle_sql()["v5_cached_embed"])
    assert rows.columns == [d[0] for d in result.description]
    assert sorted(tuple(r) for r in rows.collect()) == sorted(result.fetchall())
    sections = Tables(spark, DATA).sections()
    cache = V.embed(sections.filter("content_hash < '8'").select("content_hash", "text").distinct(), "text").select("content_hash", "embedding")
    got = {r["node_key"]: r["embedding"] for r in V.cached_embed(sections, cache).collect()}
    want = {r["node_key"]: V.hash_vectors([r["t"]])[0] for r in sections.select("node_key", F.trim(F.translate("text", "\n", " ")).alias("t")).collect()}
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, d in enumerate(b, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_names_with_a_common_stem_do_not_meet_all_others(spark):
    """Names of one stem share pieces, but few of their shortened strings."""
    rng = random.Random(3)
    bases = [f"note-{rng.randrange(1_000_000):06d}.md" for _ in range(400)]
    names = spark.createDataFrame([(b,) for b in sorted(set(bases))], "base string")
    want = spark.createDataFrame([(b, b.replace("note-", "nte-9", 1)) for b in sorted(set(bases))], "q_id string, want string")
    assert Q._pieces(want, names, 4).distinct().count() > 100_000
    cut = lambda df, c: df.select(c, F.explode(Q._shortened(c, 2)).alias("h"))
    assert cut(want, "want").join(cut(names, "base"), "h").select("want", "base").distinct().count() < 4_000


def test_nearest_names_of_all_distances_and_lengths(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc-") for _ in range(n))
    paths = sorted({f"p/{word(n)}" for n in (3, 6, 12, 18, 21, 24, 58, 61, 64, 80) for _ in range(6)})
    asked = []
    for p in paths:
        for times in (1, 2, 3, 4):
            x = list(p[2:])
            for _ in range(times):
                at = rng.randrange(len(x)) if x else 0
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "y"])
            asked.append("q/" + "".join(x))
    asked = sorted({a for a in asked if len(a) > 6})
    got = Q.resolve_path(spark.createDataFrame([(q, q) for q in asked], "q_id string, query string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    want = {}
    for q in asked:
        near = min((edits(q[2:], p[2:]), p) for p in paths)
        if near[0] <= 4:
            want[q] = near[1]
    assert {r["q_id"]: r["path"] for r in got.collect()} == want


def test_edits_make_no_group_of_a_document(spark):
    """Documents go through Python by the batch, with or without valid ops."""
    docs = spark.createDataFrame([(f"d{i}", "a\nb\nc") for i in range(50)], "doc_id string, content string")
    ops = spark.createDataFrame([(f"d{i}", 2, "remove_span", "tag", None, None, 1, 1, None) for i in range(0, 50, 2)] + [(f"d{i}", 1, "insert_header", None, "# T", None, None, None, 1 if i % 4 else 99) for i in range(0, 50, 2)], E.OP_SCHEMA)
    edited, _ = E.apply_edits(docs, ops)
    plan = edited._jdf.queryExecution().toString()
    assert "CoGroup" not in plan
    got = {r["doc_id"]: (r["content"], r["n_applied"]) for r in edited.collect()}
    assert got == {f"d{i}": ("a\nb\nc", 0) if i % 2 else ("# T\nb\nc", 2) if i % 4 else ("b\nc", 1) for i in range(50)}


def test_block_scores_few_pairs_in_full_and_ranks_by_number(monkeypatch):
    """A block's pairs are those of the whole table, though only numbers are ranked and few pairs scored."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 900)] + 0.4 * rng.normal(size=(900, 16))
    v[40:60] = v[20:40]  # ties
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [f"s{i:04d}" for i in range(900)]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array([3] * (b - a), pa.int32()), pa.array([x.tobytes() for x in v[a:b]], pa.binary())], ["item_id", "room", "v"])
    ranked, plain = [], cells.best_places
    monkeypatch.setattr(cells, "best_places", lambda of, rooms, dst, score: ranked.append((dst.dtype, len(dst))) or plain(of, rooms, dst, score))
    block = cells._Block(0, True, 0.6, 16)
    block.out = {ids[0]: {ids[20], ids[500]}, ids[20]: {ids[0]}, ids[500]: {ids[0]}}
    out = [b for part in (block.take(1, batch(0, 400)), block.take(2, batch(400, 900)), block.finished()) for b in part]
    got: dict = {}
    for b in out:
        for src, dst, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(src, []).append((-score, dst))
    score = np.round(np.einsum("ik,jk->ij", v, v), 4)
    hit = 0
    for i, a in enumerate(ids):
        met = range(900) if i < 400 else range(400)
        near = sorted((-score[i, j], ids[j]) for j in met if j != i and score[i, j] >= 0.6 and ids[j] not in block.out.get(a, ()))
        hit += len(near)
        assert sorted(got.get(a, []))[:3] == near[:3]
    assert all(kind != object for kind, _ in ranked)
    assert sum(n for _, n in ranked) < hit


def test_semantic_edges_need_the_first_sections_of_a_name_only(spark):
    """A task sends no more of a name than can matter; the edges are those of all mentions."""
    sections = spark.createDataFrame([(f"k{i:03d}", "", "Alpha beta Gamma" if i % 2 else "alpha delta") for i in range(60)], "node_key string, heading_path string, text string").repartition(2)
    parsed = spark.createDataFrame([("b", "Alpha", "x")], "batch_id string, name string, type string"), spark.createDataFrame([("b", "Alpha", "delta", "r"), ("b", "alpha", "Gamma", "r")], "batch_id string, src string, dst string, relation string")
    few = N.first_mentions(parsed, sections, 5)
    assert few.groupBy("name").count().agg(F.max("count")).first()[0] == 5
    all_ = N.match_mentions(N._names(parsed), sections)
    assert all_.count() == 180
    edges = lambda m: sorted(tuple(r) for r in G.semantic_edges(parsed[1], m, 4).collect())
    assert edges(few) == edges(all_) != []


class Store:
    """A state store of one id, which counts its calls."""

    def __init__(self):
        self.value, self.list, self.timers, self.calls = None, [], set(), 0

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def _called(self, change=lambda: None):
        self.calls += 1
        return change()

    def get(self):
        return self._called(lambda: self.value)

    def exists(self):
        return self._called(lambda: self.value is not None)

    def update(self, v):
        self._called(lambda: setattr(self, "value", v))

    def registerTimer(self, at):
        self._called(lambda: self.timers.add(at))

    def deleteTimer(self, at):
        self._called(lambda: self.timers.discard(at))


class Steps:
    def __init__(self, store):
        self.store, self.held = store, []

    def appendValue(self, v):
        self.store._called(lambda: self.held.append(v))

    def put(self, vs):
        self.store._called(lambda: setattr(self, "held", list(vs)))

    def exists(self):
        return self.store._called(lambda: bool(self.held))

    def get(self):
        return iter(self.store._called(lambda: list(self.held)))

    def clear(self):
        self.store._called(self.held.clear)


def test_scores_call_the_state_store_by_the_batch():
    """Steps of a batch are one value and one timer; those the watermark has not passed wait on."""

    class Clock:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    store = Store()
    store.getListState = lambda *_: Steps(store)
    scores = live._Scores()
    scores.init(store)
    rng = random.Random(6)
    steps = [(rng.randrange(1000) * 1000, i, rng.choice([0.2, -0.3, 0.1, 0.00005])) for i in range(2000)]
    for s in range(0, 2000, 1000):
        assert not list(scores.handleInputRows(("h",), iter([Row(at=a, seq=i, amount=x) for a, i, x in steps[s : s + 1000]]), Clock(0)))
    assert store.calls == 4
    out = []
    for mark in (500, 501, 2000):
        while due := sorted(t for t in store.timers if t < mark):
            info = type("Timer", (), {"getExpiryTimeInMs": lambda _, at=due[0]: at})()
            out += scores.handleExpiredTimer(("h",), Clock(mark), info)
            store.timers.discard(due[0])
    assert store.calls < 40

    def plain(mark):
        score, n = 5000, 0
        for at, _, x in sorted(steps):
            if at // 1000 < mark:
                score, n = min(10000, max(0, score + {0.2: 2000, -0.3: -3000, 0.1: 1000, 0.00005: 1}[x])), n + 1
        return score / 10000, n

    assert [(r["score"], r["total"]) for r in out] == [plain(500), plain(501), plain(2000)]
    assert out[-1]["total"] == 2000


def test_candidates_make_the_vectors_of_sections_once(spark, monkeypatch):
    """However many blocks the units come in, a section's vector is made once."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "TOP_BLOCK", 3, raising=False)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(text):
        made.add(1)
        return V.hash_vectors([text])[0]

    texts = [f"part {i} of {i * i}" for i in range(40)]
    sections = spark.createDataFrame([(f"s{i:02d}", "f", "", t) for i, t in enumerate(texts)], "node_key string, file_id string, heading_path string, text string").withColumn("embedding", vector("text"))
    units = spark.createDataFrame([(f"u{i:02d}", t) for i, t in enumerate(texts[:12])], "unit_id string, text string")
    got = P.candidates(units, sections, 1, 3).collect()
    assert made.value == 40
    v = np.array(V.hash_vectors(texts))
    score = np.round(v[:12] @ v.T, 4)
    want = {(f"u{i:02d}", f"s{j:02d}") for i in range(12) for j in sorted(range(40), key=lambda j: (-score[i, j], j))[:3]}
    assert {(r["unit_id"], r["node_key"]) for r in got} == want


def test_top_k_over_many_batches_with_ties_and_pairs_left_out(spark, monkeypatch):
    monkeypatch.setattr(V, "COLUMNS", 7, raising=False)
    rng = np.random.default_rng(7)
    v = rng.integers(-2, 3, (3000, 6)).astype(float)
    v[5] = 0
    items = spark.createDataFrame([(f"i{i:04d}", x.tolist()) for i, x in enumerate(v)], "item_id string, embedding array<double>").coalesce(1)
    asked = items.filter("item_id LIKE '%00' OR item_id = 'i0005'").withColumnRenamed("item_id", "q_id")
    skip = spark.createDataFrame([("i0100", f"i{i:04d}") for i in range(0, 3000, 2)], "q_id string, item_id string")
    got: dict = {}
    for r in V.vector_topk(asked, items, 8, exclude_self=True, skip=skip).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append((r["item_id"], r["score"]))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for q in [5, *range(0, 3000, 100)]:
        score = np.round(unit @ unit[q], 4)
        left = [j for j in range(3000) if j != q and not (q == 100 and j % 2 == 0)]
        best = sorted(left, key=lambda j: (-score[j], j))[:8]
        assert got[f"i{q:04d}"] == [(f"i{j:04d}", score[j]) for j in best]


def test_questions_meet_groups_of_sections(spark, monkeypatch):
    """Sections whose headings hold the same tokens, and those of one entity, are met as a group."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "deltas", "epsilon"]
    sections = [(f"n{i:04d}", " ".join(rng.sample(words, rng.randrange(1, 4))), "") for i in range(2000)]
    names = [("e1", "Alpha Zeta"), ("e2", "zeta"), ("e3", "omega")]
    mentions = [(f"n{i:04d}", e) for e, _ in names for i in sorted(rng.sample(range(2000), 400))]
    asked = [(1, "alpha beta"), (2, "zeta gamma delta"), (3, "omega"), (4, "beta alpha zeta"), (5, "the")]
    tables: dict = {}
    plain = S.written
    monkeypatch.setattr(S, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got: dict = {}
    for r in S.resolve_query_nodes(frame(asked, "q_id long, question string"), frame(sections, "node_key string, heading_path string, heading_text string"), frame(names, "entity_id string, name string"), frame(mentions, "section_key string, entity_id string"), 8).collect():
        got.setdefault(r["q_id"], []).append((r["pos"], r["node_key"], r["score"]))
    assert tables["cover"].count() < 5 * 2 ** len(words)
    for q, text in asked:
        tokens = [x for x in text.split() if x != "the"]
        best: dict = {}
        for key, head, _ in sections:
            c = sum(t in head for t in tokens)
            if c:
                best[key] = 1.5 if text in head else round(c / len(tokens), 4)
        for key, e in mentions:
            own = dict(names)[e].lower().split()
            c = sum(t in tokens for t in own)
            if c:
                best[key] = max(best.get(key, 0), round(c / len(own), 4))
        top = sorted(best, key=lambda k: (-best[k], k))[:8]
        assert sorted(got.get(q, [])) == [(i + 1, k, best[k]) for i, k in enumerate(top)]


def test_vectors_whose_grams_share_a_place(spark, monkeypatch):
    monkeypatch.setattr(V._Grams, "BITS", 4)
    rng = random.Random(9)
    texts = ["", "a", "ab", "abc", "é€😀", "😀", "\0", "\0\0\0", *["".join(rng.choice("abcé😀 ") for _ in range(n)) for n in range(60)]]
    grams = V._Grams(64)
    assert [grams.vectors(texts[i : i + 7]).tolist() for i in range(0, len(texts), 7)] == [V.hash_vectors(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert "Aggregate" not in V.hash_embed(spark.createDataFrame([(1, "x")], "id long, text string"), "id", "text")._jdf.queryExecution().toString()


def test_grounded_entities_make_no_pairs_of_names_and_sections(spark, monkeypatch):
    """Entities alone take one section a name from a task, and are those of all mentions."""
    parsed = N.parse_extractions(registry._completions(Tables(spark, DATA)))
    sections = Tables(spark, DATA).sections()
    want = sorted(tuple(r) for r in N.ground_extractions(parsed, sections)[0].collect())
    sent, plain = [], N.match_mentions
    monkeypatch.setattr(N, "match_mentions", lambda *a, **k: sent.append(plain(*a, **k)) or sent[-1])
    assert sorted(tuple(r) for r in registry.queries()["n6_ground_extractions"](spark, DATA).collect()) == want != []
    assert sent[0].groupBy("name").count().agg(F.max("count")).first()[0] == 1


def test_a_full_block_scores_so_many_pairs_at_a_time(monkeypatch):
    """What a task scores at once is bounded in pairs, not only in visitors."""
    import tracemalloc

    rng = np.random.default_rng(10)
    v = np.abs(rng.normal(size=(40_000, 8)))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array([f"s{i:05d}" for i in range(a, b)]), pa.array([3] * (b - a), pa.int32()), pa.array([x.tobytes() for x in v[a:b]], pa.binary())], ["item_id", "room", "v"])
    block = cells._Block(0, False, 0.3, 8)
    list(block.take(1, batch(0, 39_000)))
    tracemalloc.start()
    try:
        list(block.take(2, batch(39_000, 40_000)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 500 << 20
