"""One small case for each finding of the fourth round that was right."""

import numpy as np
import pyarrow as pa

from loomgraph.operators import cells
from loomgraph.operators import entities as N
from loomgraph.operators import lookup as Q
from loomgraph.operators import search as S
from loomgraph.operators import vectors as V

DATA = "/root/testdata/sf0.001"


class _Rows:
    """Stands for the rows of ``Cells``: keeps what a task would run."""

    def __init__(self):
        self.schema = {"item_id": type("f", (), {"dataType": type("t", (), {"simpleString": staticmethod(lambda: "string")})})}

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_copies_of_rows_leave_in_batches_of_bounded_size(spark):
    """With many blocks a row has as many copies; a batch of rows must not leave as one batch of all copies."""
    rng = np.random.default_rng(1)
    n, blocks, dims = 3000, 60, 8
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    wide = np.full((blocks, 4), 4.0)
    made = cells.Cells(_Rows(), n, dims, v[:4], -wide, wide, [[c] for c in range(blocks)], [1 + k // 20 for k in range(blocks)], 1.0)
    batch = pa.RecordBatch.from_arrays([pa.array([f"s{i}" for i in range(n)]), pa.nulls(n, pa.int32()), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(np.arange(n)), pa.array(np.arange(n) % blocks, pa.int32()), pa.nulls(n, pa.float64())], ["item_id", "room", "v", "h", "block", "least"])
    sizes = [b.num_rows for b in made.dealt().run(iter([batch]))]
    assert sum(sizes) == sum(blocks - 1 - k for k in range(blocks)) * n // blocks + sum(1 + k // 20 for k in range(blocks)) * n // blocks
    assert max(sizes) <= 8192


def test_rows_that_know_better_partners_take_no_worse_ones():
    """A visitor and an own row with ``least`` are sent only pairs that reach it, ties included."""
    rng = np.random.default_rng(2)
    v = np.abs(rng.normal(size=(1200, 16)))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(np.einsum("ik,jk->ij", v, v), 4)
    least = np.where(np.arange(1200) % 7 == 0, 0.6, np.sort(score, axis=1)[:, -4])
    ids = [f"s{i:04d}" for i in range(1200)]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array([3] * (b - a), pa.int32()), pa.array([x.tobytes() for x in v[a:b]], pa.binary()), pa.array(least[a:b])], ["item_id", "room", "v", "least"])
    block = cells._Block(0, False, 0.6, 16)
    out = [b for part in (block.take(1, batch(0, 700)), block.take(2, batch(700, 1200)), block.finished()) for b in part]
    got = sorted((a, b) for x in out for a, b in zip(x.column("src").to_pylist(), x.column("dst").to_pylist(), strict=True))
    want = []
    for i, a in enumerate(ids):
        near = sorted((-score[i, j], ids[j]) for j in (range(700, 1200) if i < 700 else range(700)) if score[i, j] >= least[i])
        want += [(a, b) for _, b in near[:3]]
    assert got == sorted(want)


def test_offline_vectors_by_the_table_equal_those_hashed_one_by_one(monkeypatch):
    """The model that builds an index hashes a gram once, not once a text."""
    import hashlib

    texts = ["Hello world, hello", "", None, "ab", "Ä¨ 日本語 text", "aaa" * 50, "Hello world, hello"]
    want = []
    for t in texts:
        low = (t or "").lower()
        x = np.zeros(64)
        for g in {low[i : i + 3] for i in range(len(low) - 2)} or ({low} if low else set()):
            d = hashlib.md5(g.encode()).digest()
            x[d[0] % 64] += 1.0 if d[1] % 2 == 0 else -1.0
        n = np.sqrt((x * x).sum())
        want.append((x / n if n else x).tolist())
    assert V.hash_vectors(texts) == want
    calls, plain = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: calls.append(x) or plain(x))
    assert V.hash_vectors(texts) == want
    assert calls == []


def test_best_queries_of_an_item_without_sorting_all(spark, monkeypatch):
    """Ties by query, pairs left out, and no row of scores is sorted."""
    rng = np.random.default_rng(3)
    v = np.abs(rng.normal(size=(400, 8)))
    v[50:60] = v[40:50]
    names = [f"q{i:03d}" for i in range(400)]
    rows = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, v, strict=True)], "q_id string, embedding array<double>").coalesce(2)
    skip = spark.createDataFrame([("q041", "q300"), ("q007", "q301")], "q_id string, item_id string")
    monkeypatch.setattr(V, "COLUMNS", 64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(np.einsum("ik,jk->ij", u, u), 4)
    for threshold in (0.6, 0.98):
        out = V.best_queries(rows.filter("q_id < 'q300'"), rows.filter("q_id >= 'q300'").withColumnRenamed("q_id", "item_id"), 3, threshold, skip)
        got = {(r["item_id"], r["q_id"]) for r in out.collect()}
        want = set()
        for i in range(300, 400):
            near = sorted((-score[i, j], names[j]) for j in range(300) if score[i, j] >= threshold and (names[j], names[i]) not in {("q041", "q300"), ("q007", "q301")})
            want |= {(names[i], q) for _, q in near[:3]}
        assert got == want


def test_many_names_take_passes_and_shuffle_no_texts(spark):
    """More names than one automaton holds are searched for in parts; neither grams of the texts nor hits are dealt."""
    names = spark.createDataFrame([(f"word{i} tail",) for i in range(40)] + [("WORD3 tail",), ("tail",)], "name string")
    sections = spark.createDataFrame([(f"k{i:02d}", "", f"a word{i} tail b word{i + 1} tail") for i in range(40)], "node_key string, heading_path string, text string")
    whole = N.match_mentions(names, sections)
    parts = N.match_mentions(names, sections, needle_chars=100)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) != []
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    few = sorted(map(tuple, N.match_mentions(names, sections, needle_chars=100, first=1).collect()))
    assert few == sorted({n: min(k for m, k in whole.collect() if m == n) for n, _ in whole.collect()}.items())


def test_pairs_of_entities_and_sections_are_not_dealt(spark):
    """Section entities come from the task that holds the section, one row an entity, though names differ by case."""
    text = "ENTITY|Acme|Org\nENTITY|ACME|Firm\nENTITY|Bolt x|Part\nREL|Acme|Gamma|has"
    parsed = N.parse_extractions(spark.createDataFrame([("b", text)], "batch_id string, completion string"))
    sections = spark.createDataFrame([("s1", "", "ACME and acme"), ("s2", "Bolt x", "gamma acme"), ("s3", "", "gamma")], "node_key string, heading_path string, text string")
    entities, pairs, mentions = N.ground_extractions(parsed, sections)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    ids = {r["entity_id"]: r["name"] for r in entities.collect()}
    assert sorted(ids.values()) == ["ACME", "Bolt x"]
    assert sorted((ids[r["entity_id"]], r["section_key"]) for r in pairs.collect()) == [("ACME", "s1"), ("ACME", "s2"), ("Bolt x", "s2")]
    assert ("Gamma", "s3") in {(r["name"], r["section_key"]) for r in mentions.collect()}


def test_questions_open_their_best_groups_only(spark, monkeypatch):
    """Groups meet questions by number, a question opens as many groups as it has places, and the
    nodes are those of all sections and names."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rng = np.random.default_rng(4)
    heads = [" ".join(rng.choice(words, rng.integers(1, 5), replace=False)) for _ in range(120)]
    sections = spark.createDataFrame([(f"s{i:03d}", "", h) for i, h in enumerate(heads)], "node_key string, heading_path string, heading_text string")
    names = [" ".join(rng.choice([*words, "other", "thing"], rng.integers(1, 4), replace=False)) for _ in range(40)]
    entities = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(names)], "entity_id string, name string")
    pairs = [(f"s{rng.integers(120):03d}", f"e{rng.integers(40)}") for _ in range(200)]
    mentions = spark.createDataFrame(sorted(set(pairs)), "section_key string, entity_id string")
    asked = {1: "alpha beta", 2: "omega", 3: "gamma delta thing alpha", 4: "nothing"}
    questions = spark.createDataFrame(list(asked.items()), "q_id long, question string")
    tables, plain = {}, S.written
    monkeypatch.setattr(S, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    got = sorted((r["q_id"], r["node_key"], r["score"], r["pos"]) for r in S.resolve_query_nodes(questions, sections, entities, mentions, 3).collect())
    want = []
    for q, text in asked.items():
        tokens, score = set(text.split()), {}
        for i, h in enumerate(heads):
            c = len(tokens & set(h.split()))
            if c:
                score[f"s{i:03d}"] = 1.5 if text in h else round(c / len(tokens), 4)
        for s, e in pairs:
            own = set(names[int(e[1:])].split())
            if own & tokens:
                score[s] = max(score.get(s, 0), round(len(own & tokens) / len(own), 4))
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3]
        want += [(q, s, x, p + 1) for p, (s, x) in enumerate(best)]
    assert got == sorted(want)
    assert "held" not in tables["cover"].columns


def test_numbered_names_do_not_meet_all_their_neighbours(spark, monkeypatch):
    """A wanted name that exists elsewhere is settled by equality, one a letter off by one edit."""
    numbers = range(100000, 100400)
    files = spark.createDataFrame([(f"a/note-{i}.md",) for i in numbers], "path string")
    asked = [(i, f"x/note-{i}.md" if i % 4 else f"x/note-{i}z.md") for i in numbers] + [(1, "x/nxote-100007zz.md")]
    made, plain = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: made.append((name, plain(df, name))) or made[-1][1])
    got = {r["q_id"]: (r["path"], r["how"]) for r in Q.resolve_path(spark.createDataFrame(asked, "q_id long, query string"), files).collect()}
    assert got == {i: (f"a/note-{i}.md", "fuzzy") for i in numbers} | {1: ("a/note-100007.md", "fuzzy")}
    assert sum(df.count() for name, df in made if name == "near-names" and "dist" in df.columns) < 4 * len(numbers)


def test_shortened_names_are_not_broadcast(spark):
    """A small file of names becomes thousands of strings a name: such a join must not go through the driver."""
    want = Q.written(spark.createDataFrame([(1, "abcdefgh.md"), (2, "x" * 70)], "q_id long, want string"), "wanted")
    bases = Q.written(spark.createDataFrame([("abcdefgx.md",), ("y" * 70,)], "base string"), "bases")
    for distance in (2, 4):
        plan = Q._near(want, bases, distance)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
