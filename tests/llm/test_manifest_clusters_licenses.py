"""Merkle manifest, centroid clustering and licence scan against plain Python versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from loomgraph.llm import centroids, licenses, merkle, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# --- 11 --------------------------------------------------------------------------------------


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, more=0):
    doc_id, source, lang, n_chars, text = r
    return H(*map(framed, (doc_id, source, lang, n_chars if n_chars is None else n_chars + more, text)))


def upward(nodes, fan_out):
    """The root of nodes and, for each, its (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k - k % fan_out
            paths[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + fan_out])))
        nodes = [H(*nodes[s : s + fan_out]) for s in range(0, len(nodes), fan_out)]
        at = [k // fan_out for k in at]
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows, fan_out=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs.append(upward([leaf(r) for r in groups[g]], fan_out))
    root, above = upward([s for s, _ in subs], fan_out)
    out = []
    for g, (sub, paths), top in zip(order, subs, above, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            whole = path + top
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, int(odd))
            for left, right in whole:
                h = H(left, h, right)
            out.append((r[0], leaf(r), sub, root, H(*[a + b for a, b in whole]), h, h == root))
    return out


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
KIND = "doc_id long, source string, lang string, n_chars long, text string, node string, grp int, path string"


def sorted_rows(rows):
    return sorted(rows, key=repr)


def manifest_of(spark, rows, monkeypatch, n=3):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], KIND).repartition(n)
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return sorted_rows(tuple(r[c] for c in RESULT) for r in queries.op11_merkle_manifest(spark, "").collect())


def test_manifest_of_the_given_table(spark):
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted_rows(tuple(r[c] for c in RESULT) for r in queries.op11_merkle_manifest(spark, DATA).collect())
    assert got == sorted_rows(plain_manifest(rows))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, monkeypatch):
    rows = [(i, "s", "en", 3, "t" * i) for i in range(11)] + [(i, None, None, None, None) for i in (3, 14, 21, 28)]
    rows += [(None, "s", "en", 1, "no id"), (None, "s", "en", 2, "no id"), (5, "s", "en", 9, "again"), (5, "s", "en", 9, "again"), (1, "é", "", 0, ""), (7, "s", "-", 1, "é" * 50_000), (2, "s", "Ünï", 4, "a\x00b")]
    assert manifest_of(spark, rows, monkeypatch) == sorted_rows(plain_manifest(rows))


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 3, "one")], [(1, "s", "en", 3, "one"), (2, "s", "de", 3, "two")]])
def test_manifest_of_few_rows(spark, monkeypatch, rows):
    assert manifest_of(spark, rows, monkeypatch) == sorted_rows(plain_manifest(rows))


@pytest.mark.parametrize("fan_out", [3, 4])
def test_manifest_with_wider_runs(spark, fan_out):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(41)]
    found = merkle.merkle_manifest(spark.createDataFrame(rows, KIND.split(", node")[0]), fan_out=fan_out, carried={"doc_id": F.col("doc_id")})
    back = found.rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.folded(F.col("path"), F.col("leaf"))).collect()
    want = {r[0]: r[1:6] for r in plain_manifest(rows, fan_out)}
    for r in back:
        assert tuple(r)[1:5] == want[r[0]][:4]
        assert r[5] == found.root == want[r[0]][2]
    assert len(back) == 41 and found.groups.count() == 2


# --- 12 --------------------------------------------------------------------------------------


def plain_clusters(rows, k=40, rounds=5, factor=256):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(float(x)) * factor) for x in v]))
    kept.sort(key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    means = [v for _, v in kept[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        means = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(means)]
    found = [(i, nearest(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, (d, c) in found:
        inertia[c] += d
    fits = lambda n: n if n < 2**63 else None
    return [(i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, (d, c) in found]


def clusters_of(df, **more):
    return sorted_rows(tuple(r) for r in centroids.cluster_report(centroids.centroid_clusters(df, **more)).collect())


def test_clusters_of_the_given_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = sorted_rows(plain_clusters([(r["vec_id"], r["embedding"]) for r in df.collect()]))
    assert clusters_of(df) == want
    assert clusters_of(df.repartition(7)) == want


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], f"vec_id long, embedding {kind}, planes string, cluster int").repartition(3)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(3)
    near = [(i, [rng.gauss(i % 3, 0.2) for _ in range(64)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [float("nan")] * 64), (105, [float("inf")] * 64), (106, [0.0] * 64), (106, [0.0] * 64), (None, [-0.001] * 64), (107, [5.0] * 64), (107, [-5.0] * 64)]
    assert clusters_of(vectors(spark, near + odd), k=6, rounds=3) == sorted_rows(plain_clusters(near + odd, 6, 3))


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters_of(vectors(spark, rows)) == sorted_rows(plain_clusters(rows))
    assert clusters_of(vectors(spark, [(1, None)])) == clusters_of(vectors(spark, [])) == []


def test_components_of_any_size_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(0, 12) for _ in range(64)]) for i in range(12)] + [(50, [1e300] * 64), (51, [-1.7e308] * 64)]
    assert clusters_of(vectors(spark, rows), k=5, rounds=2) == sorted_rows(plain_clusters(rows, 5, 2))


def test_planes_give_values_and_products_back():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-700, 700, (50, 64)), rng.integers(-3, 2, (9, 64))
    p, q = centroids.planes_of(a), centroids.planes_of(b)
    assert (centroids.values_of(p) == a).all() and q.shape[1] == 3
    assert (centroids.dots(p, q) == a @ b.T).all()
    assert (centroids.distances(p, q) == ((a[:, None] - b[None]) ** 2).sum(axis=2)).all()


# --- 13 --------------------------------------------------------------------------------------

BASE = [("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])]


def plain_base(text):
    words = WORD.findall((text or "").translate(ASCII_LOW))
    return len(words), [(label, i) for i in range(len(words)) for label, p in BASE if words[i : i + len(p)] == p]


def plain_matches(texts):
    """The method's matches by comparing every word of every text with every word of every template."""
    known, texts = licenses.templates(), [WORD.findall((t or "").translate(ASCII_LOW)) for t in texts]
    df = {w: sum(w in set(t) for t in texts) for one in known for w in one.words}
    rarest = [set(sorted(set(one.words), key=lambda w: (-math.log((len(texts) + 1) / (df[w] + 1)), w))[: licenses.RARE]) for one in known]
    out = []
    for words in texts:
        found = []
        for one, rare in zip(known, rarest, strict=True):
            places = [q for q, w in enumerate(one.words) if w in rare]
            votes = sorted((p - q, q) for p, w in enumerate(words) for q in places if one.words[q] == w)
            while votes:
                n = 1
                while n < len(votes) and votes[n][0] - votes[n - 1][0] <= one.slack:
                    n += 1
                group, votes = votes[:n], votes[n:]
                share = len({q for _, q in group}) / len(places)
                low, high = group[0][0], group[-1][0]
                spans = [[i for i in range(len(words)) if tuple(words[i : i + len(p)]) == p and low - one.slack <= i - q <= high + one.slack] for q, p in one.keys]
                if share >= licenses.SHARE and all(spans):
                    begin = min(max(0, low), *(s[0] for s in spans))
                    end = max(min(len(words), high + len(one.words)), *(s[0] + len(p) for s, (_, p) in zip(spans, one.keys, strict=True)))
                    found.append((one.label, one.name, begin, end, share, round(share * len(places))))
        kept = []
        for m in sorted(found, key=lambda m: (-m[5], m[2], m[1])):
            if not any(o[2] <= m[2] and m[3] <= o[3] for o in kept):
                kept.append(m)
        out.append(sorted((m[:5] for m in kept), key=lambda m: (m[2], m[1])))
    return out


def licence_texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(["the", "work", "river", "of", "public", "license", "use", "stone", "cc", "all"]) for _ in range(n))
    out = [None, "", " .-\n", "CC-BY", "all rights reserved, ALL RIGHTS RESERVED. All rights", "Ünï 数据 cc by", "license " * 3000]
    for one in licenses.templates():
        out.append(f"{filler(30)}. {' '.join(one.words).upper()}! {filler(20)}")
        loose = list(one.words)
        loose.insert(len(loose) // 2, "really")  # one word put in
        out.append(f"{filler(5)} {' '.join(loose)} {filler(9)} {' '.join(one.words)}")
        out.append(" ".join(w for w in one.words if w not in one.keys[0][1]))  # without its key phrase
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    texts = licence_texts()
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "MIT License, released under the MIT license", "x", 3), (3, "CC-BY", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4)
    return [r[1] for r in rows], licenses.license_scan(df).collect(), licenses.license_report(licenses.license_scan(df)).collect(), rows


def test_scan_equals_word_by_word_comparison(scanned):
    texts, found, _, rows = scanned
    want = sorted_rows((r[0], plain_base(r[1])[0], sorted(plain_base(r[1])[1]), m) for r, m in zip(rows, plain_matches(texts), strict=True))
    got = sorted_rows((r["doc_id"], r["n_words"], sorted(tuple(b) for b in r["base"]), [tuple(m) for m in r["matches"]]) for r in found)
    assert got == want


def test_every_licence_is_found_and_key_phrases_decide(scanned):
    texts, _, report, _ = scanned
    by = {r["doc_id"]: r for r in report if r["doc_id"] is not None}
    for k, one in enumerate(licenses.templates()):
        i = 7 + 3 * k
        assert one.label in by[i]["labels"].split(",")
        assert one.label in by[i + 1]["labels"].split(",")
        assert not any(m["template"] == one.name for m in by[i + 2]["matches"])
    assert by[3]["base_labels"] == by[3]["labels"] == "cc-by" and by[3]["score"] == licenses.PHRASE_SCORE
    assert (by[4]["n_base"], by[4]["first_word"], by[4]["last_word"]) == (2, 0, 3)
    assert by[0]["n_words"] == 0 and by[0]["first_word"] is None and by[0]["labels"] == "" and by[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in report)


def test_scan_of_the_given_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_license_scan(spark, DATA).collect()}
    matches = dict(zip(texts, plain_matches(texts.values()), strict=True))
    for i, t in texts.items():
        n, base = plain_base(t)
        assert (got[i]["n_words"], got[i]["n_base"]) == (n, len(base))
        assert got[i]["base_labels"] == ",".join(sorted({x for x, _ in base}))
        assert got[i]["labels"] == ",".join(sorted({x for x, _ in base} | {m[0] for m in matches[i]}))
    assert licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
