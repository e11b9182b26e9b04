import duckdb
import numpy as np
import pytest

from pixelflow.operators import cluster, huge_shots
from pixelflow.plans import oracle
from pixelflow.plans import queries as detector

SF = "/root/testdata/sf0.001"
SCHEMA = "shot long, pid long, x double, y double, tof double, tot long"


def shot_of(spark, key, xyt):
    return spark.createDataFrame([(key, k, float(x), float(y), float(t), 1) for k, (x, y, t) in enumerate(xyt)], SCHEMA)


def labels(df, **more):
    return {(r.shot, r.pid): r.cluster for r in cluster.density(df, 2.0, more.pop("least", 2), **more).collect()}


def test_boxes_equal_one_task(spark):
    rng = np.random.default_rng(3)
    spread = np.column_stack([rng.integers(-40, 80, 4000), rng.integers(0, 60, 4000), rng.integers(0, 400, 4000) * 1e-7])
    snake = np.column_stack([np.arange(300) * 1.5 - 90, np.full(300, 200.0), np.arange(300) * 1e-7])  # one cluster through many boxes
    hot = np.repeat([[7.0, 300.0, 0.0]], 2500, axis=0)  # one place
    points = rng.permutation(np.concatenate([spread, snake, hot, [[9.0, 300.0, 0.0], [-0.0, 400.0, 0.0], [0.0, 400.0, 0.0], [0.0, 400.0, 0.0]]]))
    small = spark.createDataFrame([(8, k, 1.0, float(k), 0.0, 1) for k in range(5)] + [(None, k, 0.0, 0.0, 0.0, 1) for k in range(2000)], SCHEMA)
    df = shot_of(spark, 7, points).unionByName(small)
    for least, limit in ((1, 100), (3, 1000)):
        want = labels(df, least=least)
        assert labels(df, least=least, huge=1000, limit=limit) == want
    xyz = np.column_stack([points[:, 0], points[:, 1], points[:, 2] * (2.0 / (cluster.Z_NS * 1e-9))])
    assert [want[7, k] for k in range(len(points))] == cluster._labels(xyz, 2.0, 3).tolist()


def test_lacking_places_are_noise_and_empty_tables(spark):
    df = spark.createDataFrame([(1, k, x, 0.0, t, 1) for k, (x, t) in enumerate([(0.0, 0.0), (None, 0.0), (float("nan"), 0.0), (1.0, None), (1.0, 0.0), (float("nan"), 0.0)])], SCHEMA)
    assert labels(df, least=1, huge=1, limit=1) == {(1, 0): 0, (1, 1): -1, (1, 2): -1, (1, 3): -1, (1, 4): 0, (1, 5): -1}
    assert labels(df.limit(0), huge=1) == {} and labels(df, least=1, huge=6)[1, 4] == 0


def test_boxes_are_bounded(spark):
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 60, (20_000, 3)), axis=0)
    cells = spark.createDataFrame([(1, *map(int, c), 10) for c in at], "_shot long, _cx long, _cy long, _cz long, _n long")
    dealt = cells.join(huge_shots.boxes(cells, 500), ["_shot", "_cx", "_cy", "_cz"])
    sizes = [r["sum(_n)"] for r in dealt.groupBy("_box").sum("_n").collect()]
    assert sum(sizes) == 10 * len(at) and max(sizes) < 3 * 500 + 10


def test_components_of_links(spark, tmp_path):
    rng = np.random.default_rng(6)
    pairs = [(k, k + 1) for k in range(0, 400)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))] + [(5000, k) for k in range(4000, 4300)]
    pairs = [pairs[k] for k in rng.permutation(len(pairs))]
    top = {}

    def find(a):
        while top.setdefault(a, a) != a:
            a = top[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(s, a, b) for s in (1, 2) for a, b in pairs], "_shot long, u long, v long")
    got = {(r["_shot"], r.u): r.v for r in huge_shots.components(df, str(tmp_path / "c")).collect()}
    assert got == {(s, a): find(a) for s in (1, 2) for a in list(top) if find(a) != a}


@pytest.mark.parametrize("name", ["density_in_boxes", "eps_neighbours"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    result = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, detector.queries()[name](spark, SF).select(*names).collect())) == sorted(result.fetchall())
