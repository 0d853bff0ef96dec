import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridcalc.llm import multi_index


def test_nothing_near_is_lost_beyond_the_first_pass(spark, tmp_path):
    """Production parameters on more distinct vectors than the first pass looks at."""
    rng = np.random.default_rng(3)
    n = 3 * multi_index.CANDIDATES
    x = rng.normal(size=(n, 32)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    got = {}
    for r in multi_index.search(spark, spark.read.parquet(f"{tmp_path}/e.parquet"), F.col("vec_id") % 600 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert len(got) == 30
    for q, hits in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        assert [hits[k] for k in range(1, 11)] == [int(j) for j in np.argsort(d, kind="stable")[:11] if j != q][:10]


def test_lower_bounds_are_below_every_distance():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6)) * 6
    x = centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 6))
    first, second = multi_index.centroids(x[:, :3], 12), multi_index.centroids(x[:, 3:], 12)
    a, b = multi_index.distances(x[:, :3], first), multi_index.distances(x[:, 3:], second)
    i, j = a.argmin(1), b.argmin(1)
    radii = np.zeros((3, 12, 12))
    for k, r in enumerate((np.sqrt(a.min(1)), np.sqrt(b.min(1)), np.sqrt(a.min(1) + b.min(1)))):
        np.maximum.at(radii[k], (i, j), r)
    scale = np.sqrt((x * x).sum(1)).max()
    far = 0
    for q in range(0, 3000, 100):
        low = multi_index.lower_bounds(a[q], b[q], first, second, radii, scale)[i, j]
        true = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert (low <= true + 1e-6 * scale).all()
        far += (low > 0.3 * true).mean()
    assert far > 15


def test_each_length_has_its_own_index(spark, monkeypatch):
    """And full cells are dealt in groups."""
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 4)
    monkeypatch.setattr(multi_index, "GROUP", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=w).tolist()) for w, ids in ((4, range(300)), (2, range(300, 330)), (1, range(330, 345))) for i in ids]
    df = spark.createDataFrame(rows + [(400, [])], "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.search(spark, df, F.col("vec_id") % 5 == 0, candidates=60, n_centroids=3).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert set(got) == set(range(0, 345, 5))
    for q, hits in got.items():
        v = rows[q][1]
        d = sorted((np.linalg.norm(np.subtract(w, v)), i) for i, w in rows if i != q and len(w) == len(v))
        assert [hits[k] for k in range(1, 11)] == [i for _, i in d[:10]]
