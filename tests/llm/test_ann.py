import numpy as np

from quarry.llm import ann


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")


def brute(vectors, k, every):
    m = np.array(vectors, np.float32).astype(np.float64)
    out = {}
    for i in range(0, len(m), every):
        s = (m * m[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(m)), -s)) if j != i][:k]
        out[i] = [(j, s[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((30, 32)) * 2
    vectors = centers[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 32))
    want = brute(vectors, 20, 20)
    got = {}
    for r in ann.search(frame(spark, vectors.tolist())).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    m = vectors.astype(np.float32).astype(np.float64)
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert all(abs(r.score - m[q] @ m[r.vec_id]) < 1e-9 for r in rows)
        hits += len({r.vec_id for r in rows} & {j for j, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_every_query_gets_its_rows_where_lists_are_left_out(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((3000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = ann.search(frame(spark, vectors.tolist()), probe=0.3, least_probe=1, per_list=50).groupBy("query_id").count().collect()
    assert len(rows) == 150 and {r["count"] for r in rows} == {20}


def test_small_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((400, 8))
    table = frame(spark, vectors.tolist())
    one = sorted(map(tuple, ann.search(table, least_probe=100).collect()))
    many = sorted(map(tuple, ann.search(table, least_probe=100, block=7, query_block=3).collect()))
    assert one == many
    want = brute(vectors, 20, 20)
    assert [(q, j) for q, _, j, _ in one] == [(q, j) for q in sorted(want) for j, _ in want[q]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [1, 0], [0, 0], None, [nan, 1], [inf, 1], [None, 1], [1, 2, 3], [-1, 1], [1, 0], [2, 0]]
    rows = ann.search(frame(spark, vectors, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, None, 20])).collect()
    found = {q: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    assert found == {0: [20, 1, 8], 20: [0, 1, 8]}
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [[1.0, 2.0]])).count() == 0


def test_repeated_ids_are_one_query_and_one_neighbour(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((200, 8))
    ids = list(range(200))
    want = sorted(map(tuple, ann.search(frame(spark, vectors.tolist(), ids), least_probe=100).collect()))
    again = np.concatenate([vectors, vectors[:60]])
    got = sorted(map(tuple, ann.search(frame(spark, again.tolist(), ids + ids[:60]), least_probe=100).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    # Two vectors of one id: the better score counts, once.
    other = np.concatenate([vectors, vectors[:60] * -1])
    m = other.astype(np.float32).astype(np.float64)
    names = np.array(ids + ids[:60])
    got = {}
    for r in ann.search(frame(spark, other.tolist(), names.tolist()), least_probe=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 200, 20):
        best = {}
        for a in np.flatnonzero(names == q):
            for b in np.flatnonzero(names != q):
                best[int(names[b])] = max(best.get(int(names[b]), -np.inf), float((m[a] * m[b]).sum()))
        assert [j for _, j in sorted(got[q])] == sorted(best, key=lambda j: (-best[j], j))[:20]


def test_queries_with_too_few_rows_look_again(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((600, 8))
    # A bound that fails for nearly all rows, and one list of many: few rows would be left.
    rows = ann.search(frame(spark, vectors.tolist()), slack=-5.0, probe=0.01, least_probe=1, per_list=10).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(vectors, 20, 20)
    assert {q: [j for _, j in sorted(x)] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}


def test_code_products_are_those_of_unpacked_codes():
    rng = np.random.default_rng(6)
    for d in (3, 64, 100):
        bits = rng.random((50, d)) > 0.5
        turned = rng.standard_normal((20, d))
        codes, p = ann.packed(bits), ann.planes(turned)
        got = ann.code_products(codes, np.bitwise_count(codes).sum(axis=1, dtype=np.int64), p, d)
        rounded = p.least[:, None] + p.step[:, None] * np.rint((turned - p.least[:, None]) / p.step[:, None])
        signs = (bits * 2.0 - 1) / np.sqrt(d)
        # What is rounded enters twice where the bit is set, and the exact total once.
        want = (2 * rounded @ bits.T.astype(float) - turned.sum(axis=1)[:, None]) / np.sqrt(d)
        assert np.allclose(got, want)
        assert np.abs(got - turned @ signs.T).max() <= p.step.max() / 2 * 2 * d / np.sqrt(d) + 1e-9


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(7)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal((40, 64))
    index = ann.fit(v[:500], 4)
    near = ann.assign(v, index.centroids)
    codes, length, own = ann.encode(v, near, index)
    p = ann.planes(q @ index.rotation)
    guess = (q @ index.centroids.T)[:, near] + ann.code_products(codes, np.bitwise_count(codes).sum(axis=1, dtype=np.int64), p, 64) * (length / own)
    one = (length / own) * np.sqrt(np.square(q).sum(axis=1)[:, None] * ((1 - own**2) / 63)[None, :] + np.square(p.step)[:, None] / 12)
    off = np.abs(guess - q @ v.T) / one
    assert abs(np.mean((guess - q @ v.T) / one)) < 0.1 and np.mean(off > 2.5) < 0.03 and np.mean(off > 4) < 1e-3


def test_exact_setting_is_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((900, 24))
    want = brute(vectors, 20, 20)
    got = {}
    for r in ann.search(frame(spark, vectors.tolist()), probe=1.0, slack=float("inf"), per_list=20, block=100, query_block=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [j for _, j in sorted(x)] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}


def test_recall_on_the_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(np.float64)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        hits, total = hits + len(got[ids[i]] & set(ids[order].tolist())), total + 20
        assert len(got[ids[i]]) == 20
    assert hits >= 0.95 * total
