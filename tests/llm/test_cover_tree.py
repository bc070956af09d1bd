import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.llm import cover_tree as ct


def brute(rows, k=5, mod=50):
    vectors = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in vectors if i % mod == 0}):
        q = min(v for j, v in vectors if j == i)
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in vectors if j != i and len(v) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return out


def test_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=8) * 0.05]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)] + [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (None, [0.1] * 8), (2250, [1.0, 2.0]), (2251, [1.0, 2.0]), (0, rows[0][1]), (7, rows[7][1]), (7, rows[7][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = ct.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows)
    assert ct.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_many_shards(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("BLOCK", 7), ("PIVOTS", 4), ("SEEDS", 30)):
        monkeypatch.setattr(ct, name, value)
    rng = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)], "vec_id long, embedding array<double>")
    got = ct.top_k(frame, F.col("vec_id") % 20 == 0, k=3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute([(r.vec_id, r.embedding) for r in frame.collect()], 3, 20)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 4))
def test_search(seed, n, spread):
    rng = np.random.default_rng(seed)
    data = rng.integers(-spread, spread + 1, (n, 3)).astype(float)
    queries = rng.integers(-spread, spread + 1, (40, 3)).astype(float)
    ids, own = np.arange(n) * 2, np.arange(40)
    best, owners, found = ct.search(queries, own, np.full(40, -np.inf), data, ids, 4)
    for i in range(40):
        want = sorted((-s, j) for s, j in zip((data @ queries[i]).tolist(), ids.tolist(), strict=True) if j != i)[:4]
        assert [(-s, o) for s, o in zip(best[i][found[i]], owners[i][found[i]], strict=True)] == want


def test_pruning():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3000
    data = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 50 for c in centres]))
    stats = {}
    ct.search(data[:100], np.arange(100) + 10_000, np.full(100, -np.inf), data, np.arange(len(data)), 5, stats)
    assert stats["compared"] < 0.1 * 100 * len(data) and stats["pruned"] >= 19
    tree = ct.CoverTree(data)
    for node in range(tree.size):
        assert (tree._distances(tree.members[node], tree.centre[node]) <= tree.radius[node] + 1e-6).all()


def test_large_components(spark):
    """Scores beyond 2**53, and beyond a long, are exact, and ranked as such."""
    rng = np.random.default_rng(8)
    for bits in (23, 31, 40):
        rows = [(i, [float(x) for x in rng.integers(-(1 << bits), 1 << bits, 12)]) for i in range(120)] + [(500 + i, [float(1 << bits)] * 11 + [float(i % 3)]) for i in range(9)]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = ct.top_k(frame, F.col("vec_id") % 50 == 0)
        near = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == [(q, n, i, near(s)) for q, n, i, s in brute(rows)]
    data = rng.integers(-(1 << 23), 1 << 23, (40, 512)).astype(float)
    best, owners, _ = ct.search(data[:3], np.arange(3) + 100, np.full(3, -np.inf), data, np.arange(40), 5)
    for i in range(3):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(data[i], v, strict=True)), j) for j, v in enumerate(data))[:5]
        assert [(-int(s), int(o)) for s, o in zip(best[i], owners[i], strict=True)] == want
    odd = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, -1.0]), (2, [1e-30, 0.5]), (50, [0.0, 0.0])], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in odd.collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ct.top_k(odd, F.col("vec_id") % 50 == 0).collect()) == [(q, n, i, near(s)) for q, n, i, s in brute(rows)]


def test_trees_of_the_embeddings(spark):
    """The trees descend on vectors that are spread evenly as well; how little can be pruned there is in the README."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    data = np.floor(256 * np.array([r.embedding for r in rows], float))
    stats = {}
    ct.search(data[::50], np.arange(len(data))[::50], np.full(len(data[::50]), -np.inf), data, np.arange(len(data)), 5, stats)
    assert stats["nodes"] > 1 and stats["visited"] > 1 and stats["compared"] <= stats["all"]


def test_cells_are_left_out(spark, monkeypatch):
    """Groups of queries and cells that can't meet aren't paired."""
    for name, value in (("SHARD", 20), ("BLOCK", 2), ("PIVOTS", 40), ("SEEDS", 400)):
        monkeypatch.setattr(ct, name, value)
    told = []
    meet = ct._meet
    monkeypatch.setattr(ct, "_meet", lambda *a: told.append(meet(*a)) or told[-1])
    rng = np.random.default_rng(6)
    centres = np.eye(16) * 40
    rows = [(i, [float(x) for x in centres[i % 16] + rng.normal(size=16) * 0.1]) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ct.top_k(frame, F.col("vec_id") % 10 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 5, 10)
    assert told.count(False) > len(told) / 2
