import duckdb
import numpy as np
import pytest

from quiverine.errors import InvalidArgs
from quiverine.operators import kmeans
from quiverine.operators.vectors import check, from_block
from quiverine.plans import catalog


def blobs(n=120, seed=3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.1, (n // 3, 4)) for c in (-2, 0, 2)])


def test_finds_separate_groups():
    book = kmeans.fit_block(blobs(), 3, seed=5)
    assert sorted(np.bincount(book.indices)) == [40, 40, 40]
    assert np.allclose(sorted(book.centroids.mean(axis=1)), [-2, 0, 2], atol=0.1)


def test_as_many_clusters_as_vectors():
    rows = blobs(6)
    book = kmeans.fit_block(rows, 6)
    assert np.allclose(book.centroids, rows)


def test_one_cluster():
    rows = blobs()
    assert np.allclose(kmeans.fit_block(rows, 1).centroids[0], rows.mean(axis=0))


def test_what_is_refused():
    with pytest.raises(InvalidArgs, match="can't make"):
        kmeans.fit_block(blobs(6), 7)
    with pytest.raises(InvalidArgs, match="distinct"):
        kmeans.fit_block(np.ones((5, 2)), 2)
    with pytest.raises(InvalidArgs, match="empty"):
        kmeans.fit_block(np.zeros((3, 1)), 2, init=np.array([[0.0], [9.0]]))


def test_ties_go_to_the_first_centre():
    nearest, distance = kmeans.nearest_block(np.array([[0.0], [1.0]]), np.array([[1.0], [-1.0], [1.0]]))
    assert list(nearest) == [0, 0]
    assert list(distance) == [1, 0]


def test_events_name_each_step():
    seen = []
    kmeans.fit_block(blobs(), 3, listener=lambda e: seen.append(e.name))
    assert seen[:2] == ["start_init", "finish_init"]
    assert seen[-1] == "finish_update"
    assert set(seen) <= set(kmeans_events())


def kmeans_events():
    from quiverine.operators.events import CLUSTER_EVENTS

    return CLUSTER_EVENTS


def test_the_table_way_follows_the_block_way(spark):
    rows = blobs()
    vectors = from_block(spark, rows, 4).repartition(3)
    init = rows[[0, 50, 100]]
    whole = kmeans.fit_block(rows, 3, init=init)
    assert np.allclose(kmeans.fit(vectors, 3, init=init), whole.centroids)
    two = kmeans.lloyd_sql(vectors, kmeans.centroid_table(spark, init), 2).orderBy("cluster").collect()
    assert np.allclose([r["centroid"] for r in two], kmeans.fit(vectors, 3, init=init, rounds=2, epsilon=0.0))
    got = {r["vec_ord"]: r["cluster"] for r in kmeans.assign(vectors, whole.centroids).collect()}
    assert [got[k] for k in range(len(rows))] == list(whole.indices)
    again = {r["vec_ord"]: r["cluster"] for r in kmeans.assign_sql(vectors, kmeans.centroid_table(spark, whole.centroids)).collect()}
    assert again == got


def test_training_goes_on_until_the_centres_stand_still(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(4000, 4)) + 3 * rng.normal(size=4)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    kmeans.fit_block(rows, catalog.P, seed=1, rounds=10**6, listener=lambda e: seen.append(e.name))
    assert seen.count("finish_update") > kmeans.ROUNDS
    embeddings = duckdb.read_parquet(f"{tmp_path}/embeddings.parquet/*.parquet")  # noqa: F841  named in the SQL
    assert [tuple(r) for r in catalog.kmeans_train_random(spark, str(tmp_path)).collect()] == duckdb.sql(catalog.ORACLES["kmeans_train_random"]).fetchall()


def test_blocks_are_let_go_and_a_limit_of_rounds_holds(spark):
    vectors = from_block(spark, blobs(), 4).repartition(3)
    seen = []
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    kmeans.fit(vectors, 3, seed=5, rounds=2, epsilon=0.0, listener=lambda e: seen.append(e.name))
    assert seen.count("finish_update") == 2
    with pytest.raises(InvalidArgs, match="empty"):
        kmeans.fit(vectors, 2, init=np.array([[0.0] * 4, [99.0] * 4]), rounds=None)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_vectors_are_checked(spark):
    assert check(from_block(spark, [], 4)) == (0, 0)
    assert check(from_block(spark, range(10), 2)) == (5, 2)
    with pytest.raises(InvalidArgs):
        from_block(spark, range(10), 3)
    with pytest.raises(InvalidArgs, match="one positive width"):
        check(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vec array<double>"))
    for bad in ([1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], None):
        with pytest.raises(InvalidArgs, match="null, NaN or infinite"):
            check(spark.createDataFrame([(bad,), ([1.0, 2.0],)], "vec array<double>"))
