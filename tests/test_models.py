import numpy as np
import pytest
from pyspark.sql import functions as F

from heatscape.operators import boosting, clusters, explain, forests, gwr, linear, models, random_trees, spatial, tiles, trees, validate
from heatscape.operators.gatekeeper import Gatekeeper, spearman, validate_coverage, verdict_errors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 4)) * [1, 2, 0.5, 1]
    y = 30 + 8 * x[:, 0] - 5 * x[:, 1] + 0.4 * x[:, 2] + rng.normal(0, 0.4, 1200)
    xy = rng.random((1200, 2))
    rows = [(i, *map(float, xy[i]), *map(float, x[i]), float(y[i])) for i in range(1200)]
    return spark.createDataFrame(rows, "id long, lon double, lat double, a double, b double, c double, d double, y double").persist()


FEATS = ["a", "b", "c", "d"]


def arrays(df):
    p = df.toPandas().sort_values("id")
    return p[FEATS].to_numpy(), p["y"].to_numpy(), p


def test_ols_recovers_coefficients(data):
    m = linear.fit_ols(data, FEATS, "y")
    x, y, _ = arrays(data)
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert [m.intercept, *m.coef] == pytest.approx(list(want), rel=1e-9)
    assert list(want) == pytest.approx([30, 8, -5, 0.4, 0], abs=0.06)


def test_ridge_loo_equals_refits(data):
    d = data.where("id < 60")
    x, y, _ = arrays(d)
    m = linear.moments(d, [*FEATS, "y"])
    for alpha, got in zip([0.1, 30.0], linear.loo_errors(d, FEATS, "y", m, [0.1, 30.0])):
        z = (x - x.mean(0)) / x.std(0)
        errs = []
        for i in range(len(z)):
            k = np.arange(len(z)) != i
            a, b = np.column_stack([np.ones(k.sum()), z[k]]), y[k]
            p = np.diag([0.0] + [alpha] * 4)
            w = np.linalg.solve(a.T @ a + p, a.T @ b)
            errs.append((y[i] - np.r_[1, z[i]] @ w) ** 2)
        assert got == pytest.approx(np.mean(errs), rel=1e-8)
    big = linear.solve(m, FEATS, 1e9)
    assert np.abs(big.coef).max() < 1e-3


def test_fold_models_never_see_their_rows(data):
    d = spatial.random_folds(data, "id")
    got = linear.ols_by_fold(d, FEATS, "y")
    for k, m in got.items():
        direct = linear.fit_ols(d.where(F.col("fold") != k), FEATS, "y")
        assert list(m.coef) == pytest.approx(list(direct.coef), rel=1e-9)


def test_benchmark_and_audit(data):
    d, how = spatial.spatial_blocks(data, "lon", "lat", FEATS, "id")
    d = spatial.random_folds(spatial.assign_folds(d, "id"), "id", out="random_fold").persist()
    assert "coordinates" in how and d.select("fold").distinct().count() == 5
    assert d.groupBy("block").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    zoo = {"OLS": linear.fit_ols, "Ridge": linear.fit_ridge, "Forest": models.random_forest(5, 5)}
    table, oof = validate.benchmark(d, "id", FEATS, "y", zoo, "Z")
    rows = {r["Model"]: r for r in table.collect()}
    assert rows["OLS"]["R2"] > 0.99 > rows["Forest"]["R2"] > 0.5 and oof.count() == 3600
    a = validate.leakage_audit(d, "id", FEATS, "y", "OLS", linear.fit_ols).first()
    assert a["optimism"] == pytest.approx(a["R2_random_CV"] - a["R2_spatial_CV"]) and abs(a["optimism"]) < 0.01


def test_group_folds_balance():
    assert spatial.group_folds({0: 50, 1: 40, 2: 30, 3: 20, 4: 10}, 2) == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_moran_smooth_against_noise(spark):
    side = 40
    rng = np.random.default_rng(0)
    noise = rng.normal(size=side * side)
    rows = [(i * side + j, i / side, j / side, float(np.sin(4 * i / side) + np.cos(3 * j / side)), float(noise[i * side + j]))
            for i in range(side) for j in range(side)]
    d = spark.createDataFrame(rows, "id long, lon double, lat double, smooth double, noise double")
    for kw in ({}, {"small_reference": 0, "tile_rows": 64}):
        assert spatial.morans_i(d, "smooth", "lon", "lat", "id", **kw).first()["morans_i"] > 0.9
        assert abs(spatial.morans_i(d, "noise", "lon", "lat", "id", **kw).first()["morans_i"]) < 0.08
    assert spatial.morans_i(d.limit(10), "noise", "lon", "lat", "id").first()["morans_i"] is None
    assert spatial.morans_i(d.withColumn("flat", F.lit(1.0)), "flat", "lon", "lat", "id").first()["morans_i"] is None


def test_sampled_shap_adds_up(data):
    m = models.random_forest(4, 4)(data, FEATS, "y")
    rows = data.where("id < 50")
    out, base = explain.sampled_shap(rows, "id", m, FEATS, explain.explain_sample(data, "id", 6, 3), 12)
    gap = m.transform(out).withColumn("g", F.abs(F.col("prediction") - explain.prediction_from_shap(FEATS, base)))
    assert gap.agg(F.max("g")).first()[0] < 1e-9
    imp = {r["Feature"]: r for r in explain.importance(explain.shap_long(out, "id", FEATS)).collect()}
    assert imp["b"]["Direction"] == "cooling" and imp["a"]["Direction"] == "warming"


def test_clusters_find_blobs(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(c, 0.3, (200, 2)) for c in ((0, 0), (5, 5), (0, 6), (6, 0))])
    rows = [(i, float(x), float(y), float(20 + x)) for i, (x, y) in enumerate(pts)]
    d = spark.createDataFrame(rows, "id long, p double, q double, lst double")
    table, labelled, meta = clusters.discover(d, ["p", "q"], "lst", range(3, 6))
    assert meta["chosen_k"] == 4 and sorted(r["N_pixels"] for r in table.collect()) == [200] * 4
    assert table.first()["Mean_LST_C"] == pytest.approx(26, abs=0.2) and "high p" in table.first()["Signature"]


def test_tiled_gwr_equals_broadcast(spark):
    rng = np.random.default_rng(3)
    n = 700
    rows = [(i, float(a), float(b), float(x), float(x * a + e)) for i, (a, b, x, e) in enumerate(
        zip(rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)))]
    d = spark.createDataFrame(rows, "id long, lon double, lat double, x double, y double")
    whole = gwr.take_points(d, "id", "lon", "lat", ["x"], "y")
    cut = gwr.take_points(d, "id", "lon", "lat", ["x"], "y", small_rows=100, tile_rows=64)
    assert isinstance(cut[1], gwr.Tiles) and cut[1].n == n
    for bandwidth in (50, 200, n):
        a, b = (gwr.local_coefficients(*p, ["x"], bandwidth).toPandas().sort_values("focal_id") for p in (whole, cut))
        assert len(b) == n
        np.testing.assert_allclose(np.stack(b["coef"]), np.stack(a["coef"]), rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(b["leverage"], a["leverage"], rtol=1e-7)
    # the same rows move to the same places in both forms, and some tiles are met as moments
    a, b = (gwr.permuted_spreads(*p, ["x"], 100, n_perm=3).orderBy("perm").toPandas() for p in (whole, cut))
    assert a["perm"].tolist() == [0, 1, 2] and (a["iqr"] > 0).all()
    np.testing.assert_allclose(b["iqr"], a["iqr"], rtol=1e-7)


@pytest.mark.parametrize("fanout", [4, 64])
def test_wide_bandwidths_meet_tiles_as_moments(spark, monkeypatch, fanout):
    """Every bandwidth up to all rows gives the fits of plain weights, whether the tree has one level or several."""
    rng = np.random.default_rng(8)
    n = 1500
    xy, x = rng.random((n, 2)) * [30, 1], rng.normal(size=(n, 2))
    xy[:300] = xy[0]  # a fifth of all rows in one place
    y = x[:, 0] * xy[:, 1] + x[:, 1] + rng.normal(size=n)
    d = spark.createDataFrame([(i, *map(float, (*xy[i], *x[i], y[i]))) for i in range(n)], "id long, lon double, lat double, `a.b` double, c double, y double")
    monkeypatch.setattr(gwr, "tree", lambda b, xs: tiles.tree(b, xs, fanout))
    features = ["a.b", "c"]
    whole = gwr.take_points(d, "id", "lon", "lat", features, "y")
    cut = gwr.take_points(d, "id", "lon", "lat", features, "y", small_rows=100, tile_rows=24)
    assert len(cut[1].levels) > (2 if fanout == 4 else 0)
    for bandwidth in (60, 700, n):
        a, b = (gwr.local_coefficients(*p, features, bandwidth).toPandas().sort_values("focal_id") for p in (whole, cut))
        np.testing.assert_allclose(np.stack(b["coef"]), np.stack(a["coef"]), rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(b["leverage"], a["leverage"], rtol=1e-6)
    blocks = cut[1].levels[0].selectExpr("node AS block", "lo_lon", "hi_lon", "lo_lat", "hi_lat")
    cover = tiles.covering(blocks, cut[1].levels, ["lon", "lat"], 700).cache()
    inside = cover.where("inside").agg(F.sum("n")).first()[0]
    assert inside > 0.2 * 700 * blocks.count()  # rows that are not met one by one
    assert fanout == 64 or cover.where("inside AND level > 0").count() > 0  # and some of them by boxes of tiles


def test_permutations_are_bijections(spark):
    import duckdb

    from heatscape.functions.permutation import permuted, permuted_places, permuted_sql

    for n in (0, 1, 2, 3, 10, 97, 1000):
        for seed in (0, 1, 42):
            moved = permuted_places(n, seed)
            assert sorted(moved) == list(range(n))
            assert [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, seed)).collect()] == moved.tolist()
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT range AS place FROM range(97)")
    rows = con.execute(f"WITH {permuted_sql('t', 'place', 42, 2)} SELECT perm, place, x FROM moved ORDER BY ALL").fetchall()
    assert rows == [(i, p, int(x)) for i in range(2) for p, x in enumerate(permuted_places(97, 42 + i))]
    far = permuted_places(5000, 7)
    assert abs(np.corrcoef(np.arange(5000), far)[0, 1]) < 0.05 and 0.3 < np.abs(np.diff(far)).mean() / 5000 < 0.37


def test_gwr_against_numpy_and_gate(spark):
    rng = np.random.default_rng(6)
    n = 300
    xy, x = rng.random((n, 2)), rng.normal(size=n)
    slope = 1 + 4 * xy[:, 0]
    y = 20 + slope * x + rng.normal(0, 0.1, n)
    d = spark.createDataFrame([(i, *map(float, xy[i]), float(x[i]), float(y[i])) for i in range(n)],
                              "id long, lon double, lat double, x double, y double")
    out = gwr.gwr(d, "id", "lon", "lat", ["x"], "y", n_perm=19)
    meta, s = out["meta"].first(), out["summary"].first()
    assert meta["gwr_justified"] and meta["gwr_R2"] > meta["ols_R2"] + 0.05
    assert s["Non_stationary"] and s["Test_basis"] == "permutation test" and s["Local_IQR"] > s["Null_IQR_p95"]
    local = out["local"].orderBy("focal_id").collect()
    w = gwr.weights(xy, xy, meta["bandwidth"])
    z = np.column_stack([np.ones(n), (x - x.mean()) / x.std()])
    for i in (0, 100, 299):
        want = np.linalg.solve(z.T @ (z * w[i][:, None]), z.T @ (w[i] * y))
        assert local[i]["coef"] == pytest.approx(list(want), abs=1e-4)


def test_gate_under_stress(spark):
    rng = np.random.default_rng(3)

    def rows(x, y, start):
        return [(start + i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]

    def make(n, shift=0.0, drift=False):
        x = rng.normal(size=(n, 6)) + shift
        noise = rng.normal(0, 0.4, n)
        lin = 30 + 8 * x[:, 0] - 6 * x[:, 1]
        return x, (60 - lin if drift else lin + 3 * x[:, 2] * x[:, 3] - 2 * x[:, 4]) + noise

    cols = "id long, a double, b double, c double, d double, e double, f double, y double"
    f = ["a", "b", "c", "d", "e", "f"]
    x, y = make(3000)
    d = spark.createDataFrame(rows(x, y, 0), cols)
    train, cal, test = d.where("id < 1800"), d.where("id >= 1800 and id < 2400"), d.where("id >= 2400")
    m = linear.fit_ols(train, f, "y")
    gate = Gatekeeper("id", tuple(f)).fit(m, cal, train, "y")
    scored = gate.score(test)
    cov = validate_coverage(scored, "y", gate).first()
    assert 0.85 < cov["empirical_coverage"] < 0.96
    assert cov["MAE_REJECT"] > 1.2 * cov["MAE_ACCEPT"]
    far = gate.score(spark.createDataFrame(rows(*make(200, 4.0), 10_000), cols))
    assert far.where("verdict <> 'REJECT'").count() == 0
    drift = verdict_errors(gate.score(spark.createDataFrame(rows(*make(200, drift=True), 20_000), cols)), "y")
    worst = {r["verdict"]: r for r in drift.collect()}
    assert worst["ACCEPT"]["n"] > 50 and worst["ACCEPT"]["mae"] > 5  # the known blind spot stays visible
    e = scored.withColumn("e", F.abs(F.col("y") - F.col("prediction")))
    assert spearman(e, "trust_score", "e", "id").first()["rho"] < -0.1


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = 3 * x[:, 0] * x[:, 1] + x[:, 2] ** 2 + rng.normal(0, 0.1, 2000)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, `b.c` double, d double, y double")
    return df.repartition(4), x, y


CURVED = ["a", "b.c", "d"]
GROWN = {
    "leaf by leaf": boosting.Settings(10, 0.3, leaves=15, l2=1.0, columns=0.7),
    "level by level": boosting.Settings(10, 0.3, depth=4, min_leaf=5, l2=1.0, rows=0.8),
}


@pytest.mark.parametrize("name", GROWN)
def test_boosting_grows_alike_in_jobs_and_in_place(curved, name):
    df, x, y = curved
    s = GROWN[name]
    here, there = (boosting.fit_boosting(df, CURVED, "y", s, small_rows=n) for n in (10_000, 0))
    assert len(here.feature) == len(there.feature) and here.roots.tolist() == there.roots.tolist()
    np.testing.assert_allclose(there.predict(x), here.predict(x), atol=1e-9)
    got = here.transform(df).orderBy("id").select("prediction").toPandas()["prediction"]
    np.testing.assert_allclose(got, here.predict(x))
    assert 1 - ((y - here.predict(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.5 and sum(here.importances()) == pytest.approx(1)


def test_boosting_takes_the_best_leaf_first(curved):
    """Against a plain search that splits one leaf at a time, the one of greatest gain."""
    df, x, y = curved
    s = boosting.Settings(1, 1.0, leaves=12, min_leaf=20, l2=1.0)
    m = boosting.fit_boosting(df, CURVED, "y", s)
    edges = [np.unique(np.quantile(x[:, j], [i / boosting.BINS for i in range(1, boosting.BINS)])) for j in range(3)]
    g = y.mean() - y

    def best(rows):
        out = (0.0, None)
        for j in range(3):
            for t in edges[j]:
                left = rows[x[rows, j] <= t]
                n, r = len(left), len(rows) - len(left)
                if min(n, r) >= 20:
                    a, b = g[left].sum(), g[rows].sum() - g[left].sum()
                    gain = a * a / (n + 1) + b * b / (r + 1) - g[rows].sum() ** 2 / (len(rows) + 1)
                    if gain > out[0] + 1e-9:
                        out = (gain, (j, t))
        return out

    leaves = [np.arange(len(y))]
    found = [best(leaves[0])]
    while len(leaves) < 12:
        k = max(range(len(leaves)), key=lambda i: found[i][0])
        j, t = found[k][1]
        rows = leaves.pop(k)
        found.pop(k)
        for part in (rows[x[rows, j] <= t], rows[x[rows, j] > t]):
            leaves.append(part)
            found.append(best(part))
    want = np.zeros(len(y))
    for rows in leaves:
        want[rows] = y.mean() - g[rows].sum() / (len(rows) + 1)
    np.testing.assert_allclose(m.predict(x), want, atol=1e-9)


def test_boosting_of_nothing_and_of_constants(spark):
    none = spark.createDataFrame([], "a double, y double")
    s = boosting.Settings(3, 0.1, leaves=4)
    assert len(boosting.fit_boosting(none, ["a"], "y", s).roots) == 0
    same = spark.createDataFrame([(1.0, 5.0)] * 60 + [(None, 1.0), (2.0, None)], "a double, y double")
    m = boosting.fit_boosting(same, ["a"], "y", s)
    assert m.predict(np.array([[1.0], [9.0]])).tolist() == [5.0, 5.0]
    t = random_trees.fit_random_trees(same, ["a"], "y", 3)
    assert t.predict(np.array([[1.0]])).tolist() == pytest.approx([5.0])


def test_random_trees_grow_alike_in_jobs_and_in_place(curved):
    df, x, y = curved
    here, there = (random_trees.fit_random_trees(df, CURVED, "y", 5, 6, small_rows=n) for n in (10_000, 0))
    np.testing.assert_allclose(there.predict(x), here.predict(x), atol=1e-9)
    whole = random_trees.fit_random_trees(df, CURVED, "y", 60)
    fresh = np.random.default_rng(5).normal(size=(500, 3))
    want = 3 * fresh[:, 0] * fresh[:, 1] + fresh[:, 2] ** 2
    assert 1 - ((want - whole.predict(fresh)) ** 2).sum() / ((want - want.mean()) ** 2).sum() > 0.5
    # thresholds lie inside the node's range, whole trees end at two rows, no two trees are alike
    inner = whole.feature >= 0
    assert whole.cover[~inner].min() >= 2 and len(set(whole.threshold[whole.roots].tolist())) > 50


def expected(trees, node, row, known):
    """Value of a subtree if only some features are known."""
    f = trees.feature[node]
    if f < 0:
        return trees.value[node]
    left, right = trees.left[node], trees.right[node]
    if f in known:
        return expected(trees, left if row[f] <= trees.threshold[node] else right, row, known)
    return (trees.cover[left] * expected(trees, left, row, known) + trees.cover[right] * expected(trees, right, row, known)) / trees.cover[node]


def test_tree_attributions_equal_all_subsets(spark, curved):
    import itertools
    import math

    from heatscape.operators import trees

    df, x, _ = curved
    forest = models.random_forest(5, 6)(df.withColumnRenamed("b.c", "b"), ["a", "b", "d"], "y")
    stack = models.stacked({"one": models.boosted("HistGBM", 4), "two": models.random_forest(4, 4)}, "id")(df.withColumnRenamed("b.c", "b"), ["a", "b", "d"], "y")
    for m in (boosting.fit_boosting(df, CURVED, "y", GROWN["leaf by leaf"]), forest.as_trees(), stack.as_trees()):
        rows = x[:8]
        got, base = trees.shap_values(m, rows)
        np.testing.assert_allclose(got.sum(axis=1) + base, m.predict(rows), atol=1e-9)
        for i, row in enumerate(rows):
            def whole(known):
                return sum(expected(m, r, row, known) for r in m.roots)
            for j in range(3):
                others = [k for k in range(3) if k != j]
                want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (whole({*s, j}) - whole(set(s)))
                           for n in range(3) for s in itertools.combinations(others, n))
                assert got[i, j] == pytest.approx(want, abs=1e-9)
    small = df.withColumnRenamed("b.c", "b").limit(40)
    for m in (forest, stack):
        out, base = trees.tree_shap(m.transform(small), m.as_trees())
        for r in out.collect():
            assert r["shap_a"] + r["shap_b"] + r["shap_d"] + base == pytest.approx(r["prediction"], abs=1e-8)


def test_rows_go_on_from_the_node_they_had_come_to(curved):
    df, x, _ = curved
    s = boosting.Settings(1, 1.0, leaves=12, min_leaf=20, l2=1.0)
    tree = boosting.Tree(s, [0, 1])
    tree.nodes = [boosting.Node(0.0, 9, 0, None, (1.0, 0, 3), 1, 2), boosting.Node(0.0, 5, 1), boosting.Node(0.0, 4, 1)]
    bins = np.random.default_rng(1).integers(0, 8, (200, 2)).astype(np.uint8)
    before = tree.places(bins)
    tree.nodes[2] = boosting.Node(0.0, 4, 1, None, (1.0, 1, 5), 3, 4)
    tree.nodes += [boosting.Node(0.0, 2, 2), boosting.Node(0.0, 2, 2)]
    assert (tree.places(bins, before) == tree.places(bins)).all() and set(tree.places(bins)) == {1, 3, 4}


def test_boosting_is_the_same_when_workers_remember_nothing(curved, monkeypatch):
    df, _, _ = curved
    s = GROWN["leaf by leaf"]
    monkeypatch.setattr(boosting, "WRITTEN", 4)
    one, other = (boosting.fit_boosting(df.repartition(n), CURVED, "y", s, small_rows=0) for n in (1, 4))
    assert (one.feature == other.feature).all() and np.allclose(one.threshold, other.threshold) and np.allclose(one.value, other.value)


def test_looked_up_attributions_equal_those_made_one_by_one(curved):
    df, x, _ = curved
    m = boosting.fit_boosting(df, CURVED, "y", GROWN["leaf by leaf"])
    for paths in trees.leaf_paths(m):
        looked_up, made = np.zeros((50, len(CURVED))), np.zeros((50, len(CURVED)))
        trees._shapley(paths, x[:50], looked_up)
        trees._shapley(paths, x[:50], made, most=0)
        assert np.allclose(looked_up, made, atol=1e-12)


def test_border_of_small_groups_is_narrow(monkeypatch):
    rng = np.random.default_rng(5)
    n, bandwidth = 20_000, 8_000
    xy = rng.random((n, 2))
    quantities = gwr._quantities(rng.normal(size=(n, 1, 2)))
    block = np.flatnonzero((np.abs(xy - 0.5) < 0.1).all(axis=1))
    met, plain = [], gwr._sums

    def counted(own, near, *rest):
        met.append(len(own) * len(near))
        return plain(own, near, *rest)

    monkeypatch.setattr(gwr, "_sums", counted)
    none = gwr.Nodes(np.zeros(0, int), np.zeros((0, 2)), np.zeros((0, gwr.POWERS, quantities.shape[1])))
    out = np.zeros((len(block), quantities.shape[1]))
    for at, sums in gwr._fine_sums(xy[block], xy, quantities, bandwidth, none, gwr.FINE_ROWS):
        out[at] = sums
    assert np.allclose(out, gwr.weights(xy[block], xy, bandwidth) @ quantities, rtol=1e-9, atol=1e-7)
    # groups of 64 rows and boxes of as many met about half of all pairs
    assert sum(met) < 0.3 * len(block) * n


def test_boosting_of_few_combinations_of_bins_needs_no_job_a_pass(curved, monkeypatch):
    """Rows of equal bins are one row with a count and a sum, which gives the same trees."""
    df, x, _ = curved
    s = boosting.Settings(12, 0.3, leaves=15, l2=1.0, columns=0.6)
    twice = df.unionByName(df.where("id < 700"))
    with monkeypatch.context() as m:
        m.setattr(boosting, "_binned", lambda *_: pytest.fail("rows went to passes"))
        few = boosting.fit_boosting(twice, ["a", "b.c"], "y", s, small_rows=0)
    monkeypatch.setattr(boosting, "MOST_CELLS", 0)
    plain = boosting.fit_boosting(twice, ["a", "b.c"], "y", s)
    assert few.feature.tolist() == plain.feature.tolist() and few.cover.tolist() == plain.cover.tolist()
    np.testing.assert_allclose(few.predict(x[:, :2]), plain.predict(x[:, :2]), atol=1e-9)


@pytest.mark.parametrize("kind", ["random thresholds", "best edges"])
def test_forests_grow_alike_in_place_in_tasks_and_below_upper_nodes(curved, kind):
    """A model in a table predicts as the same one held by the driver."""
    df, x, y = curved
    rows = df.unionByName(df.where("id < 300")).repartition(5, "id").persist()
    rule = forests.Rule(2, 2, None, 7, None if kind == "random thresholds" else forests.quantile_edges(rows, CURVED))
    whole = forests.fit_forest(rows, CURVED, "y", 12, rule, small_rows=10_000)
    assert isinstance(whole, trees.Trees) and whole.cover[whole.feature < 0].min() >= 2
    asked = rows.withColumn("n", F.lit(1)).select("id", "n", *[f"`{c}`" for c in CURVED], "y")
    for limits in ({}, {"subtree_rows": 400}):
        table = forests.fit_forest(rows, CURVED, "y", 12, rule, small_rows=0, small_nodes=0, **limits)
        assert isinstance(table, forests.Forest) and table.nodes == len(whole.feature)
        np.testing.assert_allclose(table.as_trees().predict(x), whole.predict(x), atol=1e-9)
        np.testing.assert_allclose(table.importances(), whole.importances(), atol=1e-9)
        out = table.transform(asked)
        assert out.columns == [*asked.columns, "prediction"]
        got = out.orderBy("id").toPandas()
        assert len(got) == 2300
        np.testing.assert_allclose(got["prediction"], whole.predict(got[CURVED].to_numpy()), atol=1e-9)


def test_forest_takes_the_best_edge(curved):
    df, x, y = curved
    rule = forests.Rule(3, 200, 1, 3, forests.quantile_edges(df, CURVED))
    w = rule.weights(5, np.arange(2000, dtype=np.uint64))
    assert abs(w.mean() - 1) < 0.1 and abs((w == 0).mean() - np.exp(-1)) < 0.05
    bins = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(rule.edges, x.T)]).astype(np.uint8)
    got = forests.grown(rule, 5, bins, y, w)
    best = (0.0,)
    for j in range(3):
        for t in rule.edges[j]:
            left = x[:, j] <= t
            n, m = w[left].sum(), w[~left].sum()
            if min(n, m) >= 200:
                a, b = (w * y)[left].sum(), (w * y)[~left].sum()
                best = max(best, (a * a / n + b * b / m - (a + b) ** 2 / (n + m), j, t, n, a / n))
    assert (got["feature"][0], got["number"][0], got["cover"][1]) == best[1:4] and got["number"][1] == pytest.approx(best[4])
