"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import binascii
import collections
import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, kernel_quality, maxent_lm, pieces, quality_rules, queries, repeats, shards, simhash, suffixes, token_files, tool_calls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "one", "É ß x y", "same words here again " * 40, "same words here again " * 40, "a\x00b c", "w " * 30_000, "l\nl\n\nl\n" * 9]


@pytest.fixture(scope="module")
def texts(spark):
    """Small documents: ordinary, repeated, odd, null; extra columns with clashing names."""
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows = [(r["doc_id"], r["text"]) for r in own] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id at all"), (10_001, "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id long, text string, shard string, n_words int, hub int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 1 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(queries.vocabulary_path(1))


def all_paths(p, text):
    def go(at, ids, score):
        if at == len(text):
            yield score, ids
            return
        node, single = p.trie, False
        for e in range(at, len(text)):
            node = node.get(text[e])
            if node is None:
                break
            if 0 in node:
                single |= e == at
                yield from go(e + 1, (*ids, node[0][0]), score + node[0][1])
        if not single:
            yield from go(at + 1, ids + p.unknown_ids(text[at]), score + p.unknown_score)

    return sorted(go(0, (), 0.0), key=lambda x: -x[0])


@pytest.mark.parametrize("word", ["▁hello", "▁the", "zzzé", "▁▁▁a", "中文x", "▁ingenont", "aaaaaaa", "."])
def test_nbest_equals_all_paths(model, word):
    want, got = all_paths(model, word), model.nbest(word, 5)
    assert [s for s, _ in got] == [s for s, _ in want[:5]]
    assert set(got) <= set(want)
    assert len(set(got)) == len(got)
    ids, best, gap = model.first(word)
    assert best == want[0][0]
    assert gap == (want[0][0] - want[1][0] if len(want) > 1 else math.inf)


@pytest.mark.parametrize("text", ["the cat sat", "a\nb  c. x", "on, éon!", "..!"])
def test_text_nbest_and_round_trip(model, text):
    want = all_paths(model, model.own.normalize(text))
    ids, score, others = model.encode(text, 6)
    assert [score, *(s for s, _ in others)] == [s for s, _ in want[:6]]
    for changes in ([], *(c for _, c in others)):
        again = pieces.applied(ids, changes)
        assert model.decode(again) == text
        assert tuple(np.frombuffer(again, "<u4").tolist()) in {i for _, i in want}


def test_encode_rows(spark, docs, texts, empty):
    path = queries.vocabulary_path(1)
    rows = pieces.encode_nbest(docs, path, keep_text=True)
    got = pieces.digest(rows, "doc_id", "text").collect()
    assert len(got) == len(texts)
    assert all(r["round_trip"] for r in got)
    back = pieces.decode_ids(rows, path).filter("decoded <> coalesce(text, '')").count()
    assert back == 0
    assert {r["n_tokens"] for r in got if not r["text"]} == {0}
    assert pieces.encode_nbest(empty, path).count() == 0


# --- 2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(0)
    fmt = token_files.Format(block=64, planes=planes)
    rows = [(5, rng.integers(0, 2**32, 150, dtype=np.uint32)), (None, np.zeros(0, np.uint32)), (7, np.zeros(1, np.uint32))]
    data = token_files.pack(rows, fmt)
    back = token_files.unpack(data)
    assert [d for d, _ in back] == [5, None, 7]
    assert all((a == b).all() for (_, a), (_, b) in zip(rows, back, strict=True))
    assert (token_files.read_block(data, 1) == rows[0][1][64:128]).all()
    assert token_files.unpack(token_files.pack([], fmt)) == []


def test_token_files_equal_library(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path, t = queries.vocabulary_path(2), Tokenizer.from_file(queries.vocabulary_path(2))
    token_files.write_token_files(docs, str(tmp_path / "t"), path, shards=3, fmt=token_files.Format(file_ids=2000))
    got = token_files.read_token_files(spark, str(tmp_path / "t")).collect()
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
    want = collections.Counter((i, len(ids(x)), zlib.crc32(ids(x).tobytes())) for i, x in texts)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert in_order == sorted(in_order)
    token_files.write_token_files(empty, str(tmp_path / "e"), path)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_encoder_on_odd_white_space():
    e = token_files.Encoder(queries.vocabulary_path(2))
    odd = ["a  b", "\n\nx", " lead", "trail ", "tab\tx", "<|endoftext|> y", "don't 'll  \n y", "a\x1cb", "é\r\nb", "", "a \n b", "a b c"]
    assert [x.tolist() for x in e.ids(odd)] == [x.ids for x in e.own.encode_batch(odd, add_special_tokens=False)]


# --- 3 ---------------------------------------------------------------------------------------


def plain_stats(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in collections.Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_statistics_equal_brute_force(docs, texts):
    got = collections.Counter(tuple(r) for r in quality_rules.text_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == collections.Counter((i, *plain_stats(t)) for i, t in texts)


def test_rules_learn_planted_thresholds(spark):
    rng = random.Random(3)
    rows = [(i, 0 if (a := rng.random()) > 0.8 or (b := rng.random()) > 0.9 else 1, a, b if a <= 0.8 else 0.1) for i in range(3000)]
    table = spark.createDataFrame([(i, 1 - q, "prune" if i % 3 == 0 else "grow", a, b) for i, q, a, b in rows], "doc_id long, bad int, part string, a double, b double")
    rules = quality_rules.learn_decision_list(table, ("a", "b"))
    wrong = table.filter((rules.matched() >= 0) != (F.col("bad") == 1)).count()
    assert 1 <= len(rules.rules) <= 4
    assert wrong / 3000 < 0.03
    assert quality_rules.learn_decision_list(table.filter("bad = 0"), ("a", "b")).rules == []
    assert quality_rules.learn_decision_list(table.limit(0), ("a", "b")).rules == []


def test_quality_query(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in texts[:20]] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    judged, _ = quality_rules.apply_quality_rules(docs, labels)
    rows = judged.collect()
    assert len(rows) == len(texts)
    assert all(not r["kept"] for r in rows if r["n_words"] < 10)


def test_native_plan(docs):
    plan = quality_rules.features(quality_rules.text_statistics(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 4 ---------------------------------------------------------------------------------------


def edit_distance_within(window, text, budget):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row) <= budget


def test_matches_equal_full_alignment():
    rng = random.Random(5)
    lim = decontaminate.Limits(window=32, budget=2, q=6, min_item=12, band=4, stretch=200)
    letters = "abcd "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, word(rng.choice([20, 40, 75]))) for i in range(6)]
    index = decontaminate.Index(items, lim)
    assert (index.need > 0).all()
    docs = []
    for _ in range(60):
        w = list(map(chr, rng.choice(index.text).tolist()))
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(w))
            rng.choice([lambda p=p, w=w: w.__setitem__(p, "z"), lambda p=p, w=w: w.__delitem__(p), lambda p=p, w=w: w.insert(p, "q")])()
        docs.append(word(rng.randrange(60)) + "".join(w) + word(rng.randrange(60)))
    docs += [None, "", "zzz"]
    got = collections.defaultdict(set)
    for n, i, *_ in index.matches(docs):
        got[n].add(i)
    for n, d in enumerate(docs):
        norm = decontaminate.normalised(d)
        want = {i for i, t in enumerate(index.text) if edit_distance_within("".join(map(chr, t.tolist())), norm, index.budget[i])}
        assert got[n] == want, n


def test_decontamination_names_the_text_with_the_match():
    item = "the quick brown fox jumps over the lazy dog and runs far away from here, past the old stone mills"[:96]
    index = decontaminate.Index([(1, item)], decontaminate.Limits())
    for cut in (1, 5, 7):  # letters of the item that the text lacks at its begin or end
        for kept in (item[cut:], item[:-cut], "so " + item[:-cut]):
            for others in ([], ["some clean text of no interest"], ["clean", None, "", "x"]):
                got = list(index.matches([*others, kept, "clean as well"]))
                assert {m[0] for m in got} == {len(others)}, (cut, kept, others)
                assert all(m[4] == cut and 0 <= m[2] < m[3] <= len(kept) for m in got)


def test_decontamination_finds_excerpts_wherever_they_begin(spark):
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    item = words(80)
    bench = spark.createDataFrame([(1, item), (2, words(60))], "item_id long, text string")
    cuts = [(n, s) for n in (96, 97, 103, 110, 120, 135, 150) for s in range(0, len(item) - n, 3) if " " not in (item[s], item[s + n - 1])]
    inside = [f"{words(9)} {item[s : s + n]} {words(9)}" for n, s in cuts]
    bare = [item[s : s + n] for n, s in cuts]
    clean = [words(40) for _ in range(50)]
    rows = list(enumerate(inside + bare + clean))
    got = decontaminate.benchmark_matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(k, 1) for k in range(2 * len(cuts))]
    assert all(r["edits"] <= 7 for r in got)


def test_decontamination_rows(spark, docs, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs far away from here"), (2, None), (3, "short")], "item_id long, text string")
    dirty = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77_777, "x " * 50 + "The quick brown  fox jumps over the lazy cog and runs far away from here " + "y " * 99), (77_777, None)], "doc_id long, text string"))
    for lim in (decontaminate.Limits(), decontaminate.Limits(block_chars=30)):
        got = decontaminate.benchmark_matches(dirty, bench, lim).collect()
        assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(77_777, 1, 1)]
    assert decontaminate.benchmark_matches(empty, bench).count() == 0
    assert decontaminate.benchmark_matches(dirty, bench.limit(0)).count() == 0


# --- 5 ---------------------------------------------------------------------------------------


def plain_fingerprint(text, shingle=3):
    words = WORD.findall((text or "").translate(ASCII_LOW))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """Smallest id reachable for (id, fingerprint) rows, by comparing all pairs."""
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(prints):
        low[top(k)] = min(low.get(top(k), math.inf), i)
    return [low[top(k)] for k in range(len(prints))]


def test_fingerprints_equal_definition(spark, docs, texts):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == xxhash.xxh64_intdigest(b"a b c", 42) - (1 << 64) * (xxhash.xxh64_intdigest(b"a b c", 42) >> 63)
    for _, t in texts:
        if len(t or "") < 5000:
            assert simhash.fingerprint_of(t) == plain_fingerprint(t)
    ids = [(i, t) for i, t in texts if i is not None and len(t or "") < 5000]
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.simhash_components(docs.filter("doc_id IS NOT NULL AND length(coalesce(text, '')) < 5000")).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in ids]
    assert [got[p] for p in prints] == grouped(prints)


def test_components_of_crowded_fingerprints(spark, empty):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    prints = []
    for i in range(400):
        x = rng.choice(base)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(10)
        prints.append((i, x))
    rows = spark.createDataFrame([(i, x - (1 << 64) * (x >> 63)) for i, x in prints], "doc_id long, fp long")
    roots = simhash.components(simhash.links(rows))
    root = {r["node"]: r["root"] for r in roots.collect()}
    low = {}
    for i, x in prints:
        x -= (1 << 64) * (x >> 63)
        low[root.get(x, x)] = min(low.get(root.get(x, x), 10**9), i)
    assert [low[root.get(y, y)] for y in (x - (1 << 64) * (x >> 63) for _, x in prints)] == grouped(prints)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("shingle", [3, 2])
def test_groups_by_several_fingerprints(spark, texts, empty, shingle):
    """Against all pairs of rows: equal texts, near copies, texts without words."""
    rng = random.Random(5)
    made = [t for _, t in texts if t is None or len(t) < 3000][:60] + ["", " \n"]
    for t in [t for t in made if t and len(t.split()) > 60][:12]:
        for _ in range(6):
            words = t.split(" ")
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = "edited"
            made.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    prints = [[int(x) for x in simhash.fingerprints_of(t, shingle, 4)] for t in made]
    assert [p[0] for p in prints] == [plain_fingerprint(t, shingle) for t in made]
    assert all(len(set(p)) == 4 for p in prints if p[0])
    low = list(range(len(made)))
    near = [(i, j) for i, j in itertools.combinations(range(len(made)), 2) if any((a ^ b).bit_count() <= 2 for a, b in zip(prints[i], prints[j], strict=True))]
    for _ in made:
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    one = simhash.simhash_components(rows, shingle=shingle).select("component_id").distinct().count()
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(rows, shingle=shingle).collect()}
    assert [got[i] for i in range(len(made))] == low
    assert len(set(low)) < one
    assert simhash.simhash_groups(empty).count() == 0


# --- 6 ---------------------------------------------------------------------------------------


def test_suffix_array_and_prefixes():
    rng = random.Random(0)
    for _ in range(200):
        alphabet = rng.choice([b"a", b"ab", b"abcd", bytes([0, 1, 255])])
        d = bytes(rng.choice(alphabet) for _ in range(rng.randrange(100)))
        a = np.frombuffer(d, np.uint8)
        sa, rank = suffixes.suffix_array(a)
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert sa.tolist() == want
        assert [rank[i] for i in want] == list(range(len(d)))
        lcp = suffixes.common_prefixes(a, sa)
        for k in range(1, len(d)):
            x, y = d[want[k - 1] :], d[want[k] :]
            assert lcp[k] == next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def plain_removal(rows, length):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("limits", [repeats.Repeats(), repeats.Repeats(shard_bytes=5000), repeats.Repeats(hot_regions=3, merge_regions=4, shard_bytes=5000), repeats.Repeats(stretch=1500)])
def test_removal_equals_brute_force(spark, texts, limits):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(700))
    rows = [(i, t) for i, t in texts if len(t or "") < 20_000]
    for k in range(40):
        side = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(300)))
        cut = rng.randrange(200)
        rows.append((20_000 + k, side() + passage[cut : cut + rng.randrange(380, 600)] + side()))
    rows += [(30_000, "z" * 900), (30_001, rows[0][1])]
    frame = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, k1 string").repartition(6)
    found = repeats.without_repeats(frame, limits)
    assert found.columns[:3] == ["doc_id", "text", "k1"]
    got = found.select("doc_id", "_rep_bytes", F.expr("aggregate(_rep_spans, 0L, (a, x) -> a + x.e - x.s)"), F.size("_rep_spans"), F.sha2("_rep_kept", 256)).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_removal([(i, (t or "").encode()) for i, t in rows], 400)


def test_removal_of_nothing(empty):
    assert repeats.without_repeats(empty).count() == 0


# --- 7 ---------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(spark, docs, texts, empty):
    rows = spark.createDataFrame([(i, f"text {i if i % 4 else i // 40}") for i in range(1000)] + [(i, "hot") for i in range(1000, 1500)] + [(None, None)], "doc_id long, text string")
    got = shards.shard_documents(rows).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert len(got) == 1501
    assert set(counts) == set(range(24))
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    groups = collections.defaultdict(list)
    for r in got:
        groups[r["hub"]].append(r["shard"])
    split = sum(len(set(v)) > 1 for v in groups.values() if 1 < len(v) < 60)
    assert split <= 10  # of 25; dealt by a hash alone all of them would be
    hot = max(groups.values(), key=len)
    assert len(set(hot)) <= math.ceil(500 / 62) + 2
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in shards.shard_documents(docs).collect()} == {(i, len((t or "").encode()) + 8, binascii.crc32((t or "").encode())) for i, t in texts}
    assert shards.shard_documents(empty).count() == 0


# --- 8 ---------------------------------------------------------------------------------------


def test_lm_base_and_normalisation(spark, docs, texts, empty):
    shape = maxent_lm.Shape(head=50, buckets=256, chunk=512, range_tokens=64)
    rows = [(i, t) for i, t in texts]
    got = maxent_lm.lm_scores(docs, shape).collect()
    tok = lambda t: [*WORD.findall((t or "").translate(ASCII_LOW)), ""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if i is not None and not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 4)
    want = collections.Counter((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, base(t)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert maxent_lm.lm_scores(empty, shape).count() == 0


def test_lm_learns_context(spark):
    rng = random.Random(1)
    sides = [["ka", "ko", "ki", "ku", "ke"], ["ma", "mo", "mi", "mu", "me"]]
    rows = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(60))) for i in range(400)]
    got = maxent_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), maxent_lm.Shape(singles=4, classes=16, buckets=512)).filter("held_out").collect()
    assert len(got) > 20
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.1 * sum(r["n_tokens"] for r in got)


def test_lm_table_grows():
    least = maxent_lm.Shape()
    assert [least.sized(n).buckets for n in (0, 1 << 16, 10**10, 1 << 40)] == [1 << 13, 1 << 13, 1 << 14, 1 << 16]
    assert [least.range_bits(n) for n in (0, 1 << 27, 1 << 30)] == [6, 6, 9]


def plain_class_weights(texts, lex):
    """The class factor of a list of texts, by loops over all tokens in one array."""
    reader = maxent_lm.Reader(lex.shape)
    t, sizes = reader.read(texts)
    words = maxent_lm.Words.known(*reader.words(), lex)
    f, cls = maxent_lm.features(words.hash.view(np.uint64)[t], sizes, lex.shape), words.cls[t]
    prior = lex.shape.prior * np.exp(lex.bias.astype(float)) / np.exp(lex.bias.astype(float)).sum()
    seen = np.zeros((maxent_lm.FEATURES * lex.shape.buckets, lex.shape.classes))
    for k in range(maxent_lm.FEATURES):
        np.add.at(seen, (f[:, k], cls), 1)
    w = np.log1p(seen / prior) / 4
    for _ in range(lex.shape.rounds):
        x = np.exp(w[f].sum(axis=1) + lex.bias)
        p, expected = x / x.sum(axis=1, keepdims=True), np.zeros_like(seen)
        for k in range(maxent_lm.FEATURES):
            np.add.at(expected, f[:, k], p)
        w = w + np.log((seen + prior) / (expected + prior)) / 4
    return w


def test_lm_scores_equal_plain_loops(spark, docs):
    """Small chunks, ranges and heads against one pass over all tokens with dictionaries."""
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    shape = maxent_lm.Shape(head=300, buckets=64, classes=16, singles=4, chunk=900, range_tokens=50, rounds=2)
    lex = maxent_lm.lexicon(maxent_lm.word_counts(rows, shape), shape)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score_texts(rows.withColumn("learn", F.lit(True)), lex).collect()}
    rows = rows.collect()
    weights = plain_class_weights([r["text"] for r in rows], lex)
    letters = maxent_lm.Letters(shape)
    cls = lambda w: lex.single.get(maxent_lm.word_hash(w), letters[w[:2] if w[:2].isascii() else w[:8]])
    text = {r["doc_id"]: maxent_lm.tokens_of(r["text"]) for r in rows}
    c = collections.Counter(w for ws in text.values() for w in ws)
    pair = collections.Counter(x for ws in text.values() for x in itertools.pairwise([None, *ws]))
    context = collections.Counter((a, cls(b)) for ws in text.values() for a, b in itertools.pairwise([None, *ws]))
    for i, ws in text.items():
        h = np.array([maxent_lm.word_hash(w) for w in ws], np.int64).view(np.uint64)
        x = weights[maxent_lm.features(h, np.array([len(ws)]), shape)].sum(axis=1) + lex.bias
        want = 0.0
        for k, (a, b) in enumerate(itertools.pairwise([None, *ws])):
            n = cls(b)
            p0 = (c[b] + 0.1) / 10 ** lex.class_cost[n]
            p = p0 if n < shape.singles else (shape.kappa * p0 + pair[a, b]) / (shape.kappa + context[a, n])
            want += math.log10(p) + (x[k, n] - np.log(np.exp(x[k]).sum())) / math.log(10)
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-3), (i, len(ws), ws[:5])


def test_lm_probabilities_sum_to_one(spark):
    shape = maxent_lm.Shape(classes=8, singles=2, buckets=64)
    words = ["a", "b", "c", "dd"]
    train = [(1, "b a c a"), (2, "a b dd")]
    contexts = ["", "a", "b a", "dd c", "new", "new b"]
    tests = [(100 + k, f"{x} {w}") for k, (x, w) in enumerate(itertools.product(contexts, words))]
    rows = spark.createDataFrame([(i, t, True) for i, t in train] + [(i, t, False) for i, t in tests] + [(200 + k, x, False) for k, x in enumerate(contexts)], "doc_id long, text string, learn boolean")
    lex = maxent_lm.lexicon(maxent_lm.word_counts(rows.filter("learn"), shape), shape)
    passed = maxent_lm.written(maxent_lm.tokenised(rows, shape), "tokens")
    lex = maxent_lm.train(passed, lex)
    # p of each word, of the end and of one unseen word a class, after each context.
    for context in contexts:
        reader = maxent_lm.Reader(shape)
        before = maxent_lm.tokens_of(context)[:-1]
        letters = maxent_lm.Letters(shape)
        cls = lambda w: lex.single.get(maxent_lm.word_hash(w), letters[w[:2]])  # noqa: B023, E731
        seen = [maxent_lm.tokens_of(t) for _, t in train]
        last = before[-1] if before else None
        total = 0.0
        known = [w.encode() for w in words] + [maxent_lm.END]
        count = collections.Counter(w for ws in seen for w in ws)
        pair = collections.Counter(x for ws in seen for x in itertools.pairwise([None, *ws]))
        whole = collections.Counter()
        for (a, b), n in pair.items():
            whole[a, cls(b)] += n
        inside = collections.Counter()
        for w in known:
            n = cls(w)
            p0 = (count[w] + 0.1) / 10 ** lex.class_cost[n]
            inside[n] += p0 if n < shape.singles else (shape.kappa * p0 + pair[last, w]) / (shape.kappa + whole[last, n])
        for n in range(shape.classes):
            p0 = 0.1 / 10 ** lex.class_cost[n]
            inside[n] += p0 if n < shape.singles else shape.kappa * p0 / (shape.kappa + whole[last, n])
            assert inside[n] == pytest.approx(1.0)
        t, sizes = reader.read([context])
        h = reader.words()[0].view(np.uint64)[t]
        p = np.exp(maxent_lm.class_scores(maxent_lm.features(h, sizes, shape), lex.weights, lex.bias))
        assert p.sum(axis=1) == pytest.approx(1.0)
        total += p[-1].sum()
        assert total == pytest.approx(1.0)


def plain_bigram(texts, held):
    """Mean log10 score of held-out tokens by an interpolated bigram of the other texts."""
    tok = lambda t: maxent_lm.tokens_of(t)
    train = [tok(t) for i, t in texts if i not in held]
    c, n = collections.Counter(w for ws in train for w in ws), sum(map(len, train))
    pair, first = collections.Counter(), collections.Counter()
    for ws in train:
        for a, b in itertools.pairwise([None, *ws]):
            pair[a, b] += 1
            first[a] += 1
    score = count = 0
    for i, t in texts:
        if i in held:
            for a, b in itertools.pairwise([None, *tok(t)]):
                p0 = (c[b] + 0.1) / (n + 0.1 * (len(c) + 1))
                score, count = score + math.log10((2 * p0 + pair[a, b]) / (2 + first[a])), count + 1
    return score / count


def test_lm_gains_as_a_bigram_does_whatever_the_tasks(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in rows.collect()]
    scores = []
    for parts in (1, 3, 8):
        got = maxent_lm.lm_scores(rows.repartition(parts, "doc_id"), maxent_lm.Shape(chunk=20_000)).collect()
        scores.append({r["doc_id"]: r["score"] for r in got})
        held = [r for r in got if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    base, model = sum(r["base_score"] for r in held) / n, sum(r["score"] for r in held) / n
    assert model - base >= 0.5 * (plain_bigram(texts, {r["doc_id"] for r in held}) - base) > 0
    for other in scores[1:]:
        assert all(other[i] == pytest.approx(x, rel=1e-4, abs=1e-3) for i, x in scores[0].items())


# --- 9 ---------------------------------------------------------------------------------------


def test_isotonic():
    assert kernel_quality.isotonic(np.array([0.0, 1.0, 0.5, 0.6, 0.2, 1.0]), np.ones(6)) == pytest.approx([0, 0.575, 0.575, 0.575, 0.575, 1])


def test_quality_held_out(spark, docs, empty):
    documents, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = kernel_quality.quality_scores(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    all_ = kernel_quality.quality_scores(docs, labels).collect()
    assert len(all_) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in all_)
    none = kernel_quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert kernel_quality.quality_scores(empty, labels).count() == 0


# --- 10 --------------------------------------------------------------------------------------


def test_schema_errors():
    s = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}}}
    assert tool_calls.schema_error({"a": 1.0, "b": ["x"]}, s) is None
    assert tool_calls.schema_error({}, s) == "$.a: missing"
    assert tool_calls.schema_error({"a": 0}, s) == "$.a: out of range"
    assert tool_calls.schema_error({"a": True}, s) == "$.a: not integer"
    assert tool_calls.schema_error({"a": 1, "c": 2}, s) == "$.c: unknown"
    assert tool_calls.schema_error({"a": 1, "b": ["x", "xyz"]}, s) == "$.b[1]: length"
    assert tool_calls.canonical({"b": 1.0, "a": [1.5, "é\n"]}) == '{"a":[1.5,"é\\n"],"b":1}'


def test_links_order_and_cycles(spark):
    chain = [(1, f"c{i:03d}", "t", "{}", f"c{i - 1:03d}" if i else None) for i in range(40)]
    odd = [(2, "x", "t", "{}", "y"), (2, "y", "t", "{}", "x"), (2, "z", "t", "{bad", "nowhere"), (2, "w", "gone", '{"b":2, "a":1.0}', None), (2, "w", "gone", '{"b":2, "a":1.0}', None), (None, "n", "t", "{}", None), (3, "q", "t", None, None)]
    calls = spark.createDataFrame(chain + odd, "conv_id long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "c005", "five"), (2, "lost", "r"), (2, "w", None)], "conv_id long, call_id string, content string")
    rows = tool_calls.linked_calls(calls, results, {"t": {"type": "object"}}).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(rows) == 40 + 6 + 1
    assert [got[1, f"c{i:03d}"]["position"] for i in range(40)] == list(range(40))
    assert [got[1, f"c{i:03d}"]["depth"] for i in range(40)] == list(range(40))
    assert got[1, "c005"]["linked"]
    assert json.loads(got[1, "c005"]["message"])["result"] == "five"
    assert {got[2, k]["error"] for k in "xy"} == {"after: cycle"}
    assert got[2, "z"]["error"] == "after: no such call"
    assert (got[2, "w"]["copies"], got[2, "w"]["error"]) == (2, "unknown tool")
    assert (got[2, "lost"]["error"], got[None, "n"]["error"], got[3, "q"]["error"]) == ("no call", "no id", "arguments: none")
    none = tool_calls.linked_calls(calls.limit(0), results.limit(0), {})
    assert none.count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.written(stage(spark, seen[-1], DATA), "t"))
    assert all(d.columns == docs.columns for d in seen[1:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in itertools.pairwise(ids))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = collections.Counter(plain_fingerprint(rows[i]) for i in ids[2])
    assert max(kept.values()) == 1
    items = [decontaminate.normalised(r["text"]) for r in bench.collect()]
    left = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert not any(i in decontaminate.normalised(t) for t in left.values() for i in items)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    clean = [i for i in ids[0] if labels.get(i) == 1 and plain_stats(rows[i])[0] >= 10 and plain_stats(rows[i])[4] * 5 <= plain_stats(rows[i])[0]]
    assert len(set(clean) & ids[1]) >= 0.99 * len(clean)


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids, repeated ids with other texts, U+FFFD, planted passages, clashing columns, empty tables."""
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    passage, a, b, c, d = prose(52), prose(80), prose(90), prose(70), prose(60)
    rows = [
        (1, a), (2, a), (None, a), (1, b), (None, None), (None, ""), (3, "one two"), (3, c), (4, "w " * 60), (4, d),
        (5, prose(40) + " � " + passage + " " + prose(40)), (6, prose(40) + " " + passage + "�é " + prose(40)),
        (None, prose(30) + " " + item + " " + prose(30)), (7, prose(30) + " " + item + " " + prose(30)), (7, prose(50)), (None, prose(45)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, 2) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _n int, n_words int").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name, rows: collections.Counter((r["doc_id"], r["text"]) for r in stages[name](spark, rows, DATA).collect())
    whole = collections.Counter(rows)
    short = collections.Counter([(None, None), (None, ""), (3, "one two"), (4, "w " * 60)])
    assert left("quality rules", docs) == whole - short
    near = left("simhash near-dedup", docs)
    assert near == whole - collections.Counter([(2, a), (None, a), (None, None)]) or near == whole - collections.Counter([(2, a), (None, a), (None, "")])
    got = left("suffix-array dedup", docs)
    texts = [t for _, t in got if t]
    assert not any(passage[20:-20] in t for t in texts)
    assert sum(t.count("�") for t in texts) == 2
    assert all((i, t) in got for i, t in [(1, b), (None, None), (3, "one two"), (3, c), (4, d)])
    assert {i for i, t in rows if t == a and (i, t) in got} == set()  # a whole text that occurs elsewhere goes
    assert left("benchmark decontamination", docs) == whole - collections.Counter([rows[12], rows[13]])
    assert stages["sentencepiece encoding"](spark, docs, DATA).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), DATA)
        assert out.count() == 0
        assert name == "sentencepiece encoding" or out.columns == docs.columns


def test_short_items_are_found_verbatim():
    lim = decontaminate.Limits(stretch=500)
    index = decontaminate.Index([(7, "Tiny  item here"), (8, "x"), (9, "a thirty-nine character item, so to say"), (10, ""), (11, None)], lim)
    docs = ["so tiny item here.", "the tiny item here is", "tiny item heres", "x", "axa b", "bb " * 600 + "TINY item\nhere", "q " * 160 + "x " * 3, "a thirty-nine character item, so to say", "a thirty-nine character item, so to sax", None]
    got = {(n, index.item[i]) for n, i, *_ in index.matches(docs)}
    assert got == {(1, 7), (3, 8), (5, 7), (6, 8), (7, 9)}
    long = " ".join(f"w{i}x x{i}" for i in range(400))  # x at the ends of words only
    assert list(index.matches([long])) == []


def test_joined_by_weight_equals_a_join(spark):
    from loomgraph.llm.store import joined_by_weight

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(4000)], "i int, k string")
    table = rows.filter("i % 7 <> 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    for how in ("inner", "left"):
        want = collections.Counter(rows.join(table.drop("n"), "k", how).select("i", "k", "top").collect())
        assert collections.Counter(joined_by_weight(rows, table, ["k"], "n", how).select("i", "k", "top").collect()) == want


def _folder(spark):
    return spark.conf.get("spark.checkpoint.dir").split(":", 1)[1].replace("//", "/")


def test_operators_leave_their_result_only(spark, docs):
    """Tables written on the way are deleted when the result is: later stages share the disk."""
    before = set(os.listdir(_folder(spark)))
    found = simhash.simhash_groups(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    spans = repeats.repeated_spans(docs, repeats.Repeats(length=64, gram=32))
    assert len(set(os.listdir(_folder(spark))) - before) == 2
    assert found.count() and spans.count()


def test_full_cells_are_not_found_by_a_second_grid(spark, monkeypatch):
    """Members of full cells come from the cells, so the grid of all fingerprints is dealt once."""
    made, plain = [], simhash._cells
    monkeypatch.setattr(simhash, "_cells", lambda c: made.append(c) or plain(c))
    rows = spark.createDataFrame([(1 << i,) for i in range(9)], "fp long")
    assert simhash.links(rows).count() >= 8
    assert len(made) == 2


def test_full_cells_go_back_to_their_members_only(spark):
    """A cell leads to the vectors that members came from, not to all 33 around it."""
    rows = spark.createDataFrame([(1 << i,) for i in (0, 1, 2, 9)] + [(3,)], "fp long").withColumn("key", simhash.popcount_vector(F.col("fp")))
    grid = rows.select("fp", "key", F.explode(simhash._cells(F.col("key"))).alias("c")).select("fp", "key", "c.*")
    cells = grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_or(simhash._bit(F.col("step"))).alias("steps")).filter("n > 2")
    want = {tuple(r) for r in grid.join(cells, "cell").select("cell", "key", "step").collect()}
    got = [tuple(r) for r in simhash._ways_back(cells).select("cell", "key", "step").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts_are_shuffled_once(spark, texts):
    """What repeats is joined to texts that lie in buckets: only the spans are shuffled for it."""
    frame = spark.createDataFrame([(i, t) for i, t in texts if len(t or "") < 20_000], "doc_id long, text string").repartition(3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = repeats.without_repeats(frame, repeats.Repeats(length=64, gram=32))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert found.count() == frame.count()
    finally:
        spark.conf.set(key, before)


def test_frequent_stretches_stay_remembered():
    """When the memory is full the older half goes, not what comes again and again."""
    p = pieces.Pieces(queries.vocabulary_path(1))
    p.ROOM, asked, plain = 6, [], p.first
    p.first = lambda text: asked.append(text) or plain(text)
    for k in range(40):
        p.encode(f"again {k}x{k * 7}", 1)
    assert asked.count(pieces.MARK + "again") + asked.count("again") == 1
