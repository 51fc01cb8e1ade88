import numpy as np
import pytest

from heatscape.operators import neighbours
from heatscape.operators.neighbours import knn, knn_mean, tiles_touched


def brute(q, qid, r, rid, k, exclude):
    rows = []
    for i in range(len(q)):
        d = np.zeros(len(r))
        for j in range(q.shape[1]):
            d += (q[i, j] - r[:, j]) ** 2
        if exclude:
            d[rid == qid[i]] = np.inf
        for rank, j in enumerate(np.lexsort((rid, d))[:k], 1):
            rows.append((int(qid[i]), rank, int(rid[j]), round(float(np.sqrt(d[j])), 9)))
    return sorted(rows)


def frame(spark, x, ids):
    cols = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(int(i), float(i) * 2, *map(float, row)) for i, row in zip(ids, x)],
                                 ["id", "v", *cols]), cols


def got(df):
    return sorted((r.query_id, r.rank, r.ref_id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("dims", [1, 2, 4])
@pytest.mark.parametrize("small", [0, 10_000])
def test_self_join_matches_brute_force(spark, dims, small):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(700, dims))
    x[:230] = x[0]                       # a third of all rows on one spot
    x[230:300] = np.round(x[230:300])    # lattice ties
    ids = rng.permutation(700)
    df, cols = frame(spark, x, ids)
    out = knn(df, df, cols, 5, "id", value="v", exclude_self=True, small_reference=small, tile_rows=32)
    assert got(out) == brute(x, ids, x, ids, 5, True)
    assert out.where("value <> ref_id * 2").count() == 0


@pytest.mark.parametrize("nq,nr", [(40, 500), (500, 40), (300, 3)])
def test_query_against_other_table(spark, nq, nr):
    rng = np.random.default_rng(nq)
    q, r = rng.normal(size=(nq, 2)) * 3, rng.normal(size=(nr, 2))
    qd, cols = frame(spark, q, np.arange(nq))
    rd, _ = frame(spark, r, np.arange(nr))
    out = knn(qd, rd, cols, 7, "id", small_reference=0, tile_rows=16)
    assert got(out) == brute(q, np.arange(nq), r, np.arange(nr), 7, False)


@pytest.mark.parametrize(("dims", "fanout"), [(2, 4), (2, 64), (6, 4)])
def test_walk_down_a_tree_of_boxes(spark, dims, fanout):
    """Distinct rows, a few far away, in a tree of one level and of several; many dimensions use pivots."""
    rng = np.random.default_rng(dims * fanout)
    x = rng.normal(size=(900, dims))
    x[:5] += 40
    ids = rng.permutation(900)
    df, cols = frame(spark, x, ids)
    want = brute(x, ids, x, ids, 6, True)
    assert got(knn(df, df, cols, 6, "id", value="v", exclude_self=True, small_reference=0, tile_rows=16, fanout=fanout)) == want
    other, _ = frame(spark, x[::3] + 0.1, np.arange(300))
    assert got(knn(other, df, cols, 6, "id", small_reference=0, tile_rows=16, fanout=fanout)) == brute(x[::3] + 0.1, np.arange(300), x, ids, 6, False)
    # a tile with fewer rows than neighbours, and a table with fewer
    assert got(knn(df, df, cols, 20, "id", exclude_self=True, small_reference=0, tile_rows=16, fanout=fanout)) == brute(x, ids, x, ids, 20, True)
    few, _ = frame(spark, x[:9], ids[:9])
    assert got(knn(few, few, cols, 20, "id", exclude_self=True, small_reference=0, tile_rows=4, fanout=fanout)) == brute(x[:9], ids[:9], x[:9], ids[:9], 8, True)


@pytest.mark.parametrize("small", [0, 10_000])
def test_means_equal_those_of_neighbours(spark, small):
    rng = np.random.default_rng(2)
    x, ids = rng.normal(size=(400, 2)), rng.permutation(400)
    df, cols = frame(spark, x, ids)
    kw = {"exclude_self": True, "small_reference": small, "tile_rows": 32}
    edges = knn(df, df, cols, 7, "id", value="v", **kw).groupBy("query_id").agg({"value": "avg", "distance": "avg"}).collect()
    values = {r.query_id: r for r in knn_mean(df, df, cols, 7, "id", value="v", own="v", **kw).collect()}
    distances = {r.query_id: r["mean"] for r in knn_mean(df, df, cols, 7, "id", **kw).collect()}
    assert len(values) == len(distances) == len(edges) == 400
    for r in edges:
        v = values[r.query_id]
        assert v["near"] == 7 and v["own"] == 2 * r.query_id and v["mean"] == pytest.approx(r["avg(value)"])
        assert distances[r.query_id] == pytest.approx(r["avg(distance)"])


def test_tiles_touched_do_not_grow_with_the_table(spark):
    rng = np.random.default_rng(9)
    means = []
    for n in (2_000, 16_000):
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((n, 2)))], "id long, a double, b double")
        r = tiles_touched(df, ["a", "b"], 8, "id", tile_rows=64).first()
        assert r["queries"] == n and r["tiles"] == n // 64
        means.append(r["mean_tiles"])
    assert means[1] < 1.25 * means[0] + 0.1


def test_tiles_are_cut_where_rows_are_far_apart(spark):
    """Which of six columns is the widest makes no difference to the tiles that a query goes to."""
    x = np.random.default_rng(3).uniform(size=(6000, 6))
    seen = []
    for wide in (0, 5):
        y = x.copy()
        y[:, wide] *= 20
        df, cols = frame(spark, y, np.arange(len(y)))
        seen.append(tiles_touched(df, cols, 4, "id", tile_rows=64).first()["mean_tiles"])
    assert seen[1] < 1.3 * seen[0]


def test_groups_of_queries_meet_only_near_rows(monkeypatch):
    rng = np.random.default_rng(3)
    cells, plain = [], neighbours.squared_distances

    def counted(q, r):
        cells.append(len(q) * len(r))
        return plain(q, r)

    for dims, ties, exclude, limited in [(2, False, True, False), (2, True, True, True), (3, True, False, False), (1, True, True, False), (6, False, True, True)]:
        r = rng.random((1024, dims)).round(1 if ties else 9)
        rid = rng.permutation(1024) // (2 if ties else 1)  # ids that repeat leave out both rows
        q, qid = r[rng.permutation(1024)[:700]], rng.integers(0, 1024, 700)
        limit = rng.random(700) / 100 if limited else None
        if dims == 2 and ties:
            q[5], r[7] = np.inf, np.inf
        d = plain(q, r)
        if exclude:
            d[qid[:, None] == rid[None, :]] = np.inf
        if limited:
            d[d > limit[:, None]] = np.inf
        want = []
        for i in range(len(q)):
            best = sorted((x, int(rid[j])) for j, x in enumerate(d[i]) if np.isfinite(x))[:8]
            want += [(i, *b) for b in best]
        cells.clear()
        monkeypatch.setattr(neighbours, "squared_distances", counted)
        rows, cols, dist = neighbours.nearest(q, qid, r, rid, 8, exclude, limit)
        monkeypatch.setattr(neighbours, "squared_distances", plain)
        assert [(int(a), float(c), int(rid[b])) for a, b, c in zip(rows, cols, dist)] == want
        if dims == 2 and not ties:
            assert sum(cells) < 0.5 * len(q) * len(r)


def test_search_of_line_items_asks_for_every_row(spark, tmp_path):
    from heatscape.plans import catalogue

    rows = spark.range(130).selectExpr("id AS l_orderkey", "cast(id % 7 AS int) AS l_linenumber", "id AS l_partkey", "id % 10 AS l_suppkey",
                                       "cast(id % 50 AS double) AS l_quantity", "id * 100e0 AS l_extendedprice", "id % 11 / 100e0 AS l_discount",
                                       "id % 9 / 100e0 AS l_tax", "date_add(DATE'2020-01-01', cast(id AS int)) AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["e8_knn_lineitem"](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert sorted(r["query_id"] for r in found) == list(range(130)) and {r["count"] for r in found} == {8}
