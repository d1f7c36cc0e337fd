"""Clustering and the Merkle manifest against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakatlas.llm import centroids, merkle
from leakatlas.llm.centroids import VantageTree

VECTORS = "vec_id long, embedding array<float>, cluster string, k string, distance string"
ROWS = "doc_id long, source string, lang string, n_chars int, text string, tree string, key string, run int, at int, node string"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 40, 130])
@pytest.mark.parametrize("spread", [1, 2, 300])
def test_tree_finds_the_smallest_of_the_nearest(n, spread):
    rng = np.random.default_rng(n + spread)
    points = rng.integers(-spread, spread + 1, (n, 6))
    points[n // 2] = points[0]  # equal centroids
    vectors = np.concatenate([rng.integers(-spread, spread + 1, (700, 6)), points])
    number, square = VantageTree(points).nearest(vectors)
    all_pairs = ((vectors[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (square == all_pairs.min(axis=1)).all()
    assert (number == all_pairs.argmin(axis=1)).all()


def test_largest_components_stay_exact():
    far = centroids.LARGEST
    points = np.array([[-far] * 8, [far] * 8, [far] * 7 + [far - 1]])
    number, square = VantageTree(points).nearest(np.array([[far] * 7 + [far - 1], [far] * 8, [-far + 1] * 8]))
    assert number.tolist() == [2, 1, 0] and square.tolist() == [0, 0, 8]


def plain_clusters(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, m) in zip(kept, of, strict=True) if m == n]
            if mine:
                cents[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    of = assign()
    inertia = {n: sum(d for d, m in of if m == n) for _, n in of}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), ",".join(map(str, cents[n]))) for (i, _), (d, n) in zip(kept, of, strict=True)), key=str)


def vector_rows(dims):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1, 0, 1)) * rng.random() for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * dims) for i in range(150)]  # a third alike: ties in hash order are decided by id
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, [0.5] * dims), (2000, None), (2001, []), (2002, [1.0] * (dims - 1))]
    rows += [(2003, [None] + [0.1] * (dims - 1)), (2004, [math.nan] + [0.1] * (dims - 1)), (2005, [math.inf] * dims), (2006, [-math.inf] * dims), (2007, [-0.0] * dims)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("k", [1, 7, 40, 600])
def test_clusters_equal_brute_force(spark, k):
    rows = vector_rows(5)
    df = spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], VECTORS).repartition(6)
    got = centroids.cluster(df, k=k, rounds=3, dims=5)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, 3, 5)


def test_too_large_components_are_left_out(spark):
    df = spark.createDataFrame([(1, [600000.0, 0.0]), (2, [1.0, 0.0]), (3, [-524288.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(r.vec_id for r in centroids.cluster(df, k=2, rounds=1, dims=2).collect()) == [2, 3]


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none, dims=5).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], "", "", "")], VECTORS), dims=5).columns == centroids.cluster(none, dims=5).columns


# ---- manifest ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in row])


def climb(nodes):
    """The top and, of every node, its way: (left, right) of each level."""
    ways, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, at in enumerate(of):
            run, slot = nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
            ways[n].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        of = [at // 16 for at in of]
    return nodes[0], ways


def plain_manifest(rows):
    """Rows (doc_id, source, lang, n_chars, text), ordered by key, then by leaf."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out, tops = [], {}
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted((-(2**63) if r[0] is None else r[0], plain_leaf(r), r) for r in rows if r[1] == source)
        tops[source] = climb([x[1] for x in mine]), mine
    root, upper = climb([t[0][0] for t in tops.values()])
    for ((subroot, ways), mine), up in zip(tops.values(), upper, strict=True):
        for (_, leaf, r), way in zip(mine, ways, strict=True):
            seen = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                seen = plain_leaf((*r[:4], None if r[4] is None else r[4].translate(lower)))
            for left, right in way + up:
                seen = h(left, seen, right)
            out.append((r[0], leaf, subroot, root, h(*[x for s in way + up for x in s]), seen, seen == root))
    return sorted(out, key=str)


def spark_manifest(spark, rows, parts=7):
    df = spark.createDataFrame([(*r, "c", "c", 1, 2, "c") for r in rows], ROWS).repartition(parts)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns = ["doc_id", "source", "lang", "n_chars"]
    made = merkle.manifest(df, "doc_id", "source", [*columns, "text"], [*[F.col(c) for c in columns], F.translate("text", upper, upper.lower())], F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), "folded_root", "verified")
    return sorted((tuple(r) for r in made.collect()), key=str)


def manifest_rows():
    rng = random.Random(1)
    rows = []
    for i in rng.sample(range(100_000), 700):  # a hot source, lone sources, some of exactly 16, 17 and 256 leaves
        rows.append((i, "hot" if i % 3 else f"s{i % 11}", rng.choice(("en", None)), i, f"Text {i} É"))
    rows += [(i, "sixteen", "en", 1, "A") for i in range(16)] + [(i, "seventeen", "en", 1, "A") for i in range(17)] + [(i * 77, "full", "en", 1, "A") for i in range(256)]
    rows += [(5, "lone", None, None, None), (6, None, None, None, "X" * 20_000), (7, "", "en", 0, ""), (8, "ü", "en", 1, "UPPER"), (9, None, "en", 1, "-")]
    rows += [(2**63 - 1, "far", "en", 1, "a"), (-(2**63), "far", "en", 1, "b"), (-1, "far", "en", 1, "c"), (0, "far", "en", 1, "d"), (1 << 40, "far", "en", 1, "e"), (-(1 << 50), "far", "en", 1, "f")]
    return rows


def test_manifest_equals_brute_force(spark):
    rows = manifest_rows()
    assert spark_manifest(spark, rows) == plain_manifest(rows)


def test_tied_keys_follow_by_leaf(spark, monkeypatch):
    """Null keys, repeated keys with other texts, repeated rows; also where a key's rows are joined in parts."""
    rng = random.Random(2)
    rows = [(4, "hot", "en", 1, f"same key {i}") for i in range(90)] + [(4, "hot", "en", 1, "same row")] * 60 + [(None, "hot", "en", 1, f"no key {i % 40}") for i in range(80)]
    rows += [(i, "hot", "en", 1, "plain") for i in range(120)] + [(None, None, None, None, None)] * 20 + [(i % 9, "few", "en", 1, "x") for i in range(30)]
    rng.shuffle(rows)
    want = plain_manifest(rows)
    assert spark_manifest(spark, rows) == want
    monkeypatch.setattr(merkle, "HOT_ROWS", 16)
    assert spark_manifest(spark, rows, 3) == want


def test_small_manifests(spark):
    for rows in ([], [(1, "a", "en", 1, "Lone")], [(1, "a", "en", 1, "x"), (2, "a", "en", 1, "x")], [(i, f"s{i}", "en", 1, "Y") for i in range(40)]):
        assert spark_manifest(spark, rows) == (plain_manifest(rows) if rows else [])


def test_changed_texts_are_found(spark):
    got = spark_manifest(spark, manifest_rows())
    assert {r[6] for r in got} == {True, False}
    assert all((r[5] == r[3]) == r[6] for r in got)
