import copy
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverine.errors import InvalidArgs, InvalidContext, InvalidData, StorageError, VerificationFailure
from quiverine.operators import attributes as A
from quiverine.operators import index as index_module
from quiverine.operators import query
from quiverine.operators.events import ASYNC_QUERY_EVENTS, BUILD_EVENTS, QUERY_EVENTS
from quiverine.operators.index import IndexBuilder, _bytes_of, _Resident, recall
from quiverine.operators.partitions import number_within
from quiverine.operators.sampling import in_order
from quiverine.operators.vectors import from_block, numbered
from quiverine.sources import storage, tables
from quiverine.streaming.queries import answer_stream


@pytest.fixture(scope="module")
def rows():
    return np.random.default_rng(7).normal(size=(300, 16))


@pytest.fixture(scope="module")
def index(spark, rows):
    vectors = from_block(spark, rows, 16)
    return IndexBuilder(6, 4, 8, rounds=15).build(vectors, "vec_ord", "vec")


def reconstructed(index):
    out = {}
    for r in index.encoded.collect():
        parts = [index.books[d, c] for d, c in enumerate(r["codes"])]
        out[r["partition_index"], r["vector_index"]] = index.centroids[r["partition_index"]] + np.concatenate(parts)
    return out


def test_accessors(index):
    assert (index.num_vectors, index.vector_size, index.num_partitions, index.num_divisions, index.num_codes, index.subvector_size) == (300, 16, 6, 4, 8, 4)
    sizes = {r["partition_index"]: r["num_vectors"] for r in index.partition_sizes().collect()}
    assert sum(sizes.values()) == 300
    assert [r["vector_index"] for r in index.partition(2).collect()] == list(range(sizes[2]))
    assert index.vector_ids().distinct().count() == 300
    assert index.encoded_vector(2, 0) == list(index.partition(2).first()["codes"])
    assert index.vector_id(2, 10_000) is None
    assert index.codebook(3).shape == (8, 4)
    for bad in (lambda: index.partition(6), lambda: index.codebook(4)):
        with pytest.raises(InvalidArgs):
            bad()


def test_places_follow_the_order_within_partitions(index):
    last = {}
    for r in index.encoded.orderBy("partition_index", "vector_index").collect():
        assert r["vec_ord"] > last.get(r["partition_index"], -1)
        last[r["partition_index"]] = r["vec_ord"]


def test_places_whatever_the_spread_of_ordinals(spark):
    """Many ordinals close together and a few far away; one group of nearly all."""
    orders = [*range(500), 10**15, -(10**15), 10**17]
    df = spark.createDataFrame([(0 if o % 50 else 1 + o % 3, o) for o in orders], "g int, o long").repartition(3)
    got = number_within(df, "g", "o", "n").orderBy("g", "o").collect()
    for g in {r["g"] for r in got}:
        assert [r["n"] for r in got if r["g"] == g] == list(range(len([r for r in got if r["g"] == g])))
    assert len(got) == len(orders)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join stretches as small as these
    tasks = in_order(df, "g", "o").groupBy("__task").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in tasks) < len(orders) / 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_encoded_once(index, rows):
    """The index reads its table of codes; a query runs Python only to look distances up."""
    assert plan(index.rows()).count("MapInArrow") == 0
    assert plan(index.query(rows[0], 3, 2)).count("MapInArrow") == 1
    assert plan(index.query_batch(rows[:9], 3, 2)).count("MapInArrow") == 1
    own = index.set_attribute_at(0, "n", 1)
    assert plan(own.attributes()).count("MapInArrow") == 0


def test_a_table_of_queries_answers_like_single_ones(spark, index, rows, monkeypatch):
    asked = spark.createDataFrame([(7 * k, v.tolist()) for k, v in enumerate(rows[:40])], "query_id long, vec array<double>")
    expected = sorted((7 * k, r["vector_id"], round(r["squared_distance"], 9)) for k in range(40) for r in index.query_batch(rows[k : k + 1], 5, 3).collect())
    for piece, most in ((1 << 18, 16_384), (10, 4)):  # whole partitions, then pieces and blocks
        monkeypatch.setattr(query, "PIECE", piece)
        monkeypatch.setattr(query, "QUERY_ROWS", most)
        got = index.query_table(asked, 5, 3).collect()
        assert sorted((r["query_id"], r["vector_id"], round(r["squared_distance"], 9)) for r in got) == expected
    assert index.query_table(asked.limit(0), 5, 3).count() == 0


def test_search_answers_like_queries(index, rows):
    key = lambda found: [(r.partition_index, r.vector_index, r.vector_id, round(r.squared_distance, 9)) for r in found]
    small = copy.copy(index)
    small._resident = type(index._resident)(1)  # holds nothing: the cluster searches
    for k, nprobe in ((5, 3), (500, 6), (1, 1)):
        for q in rows[:3]:
            expected = key(index.query(q, k, nprobe).collect())
            assert key(index.search(q, k, nprobe)) == key(index.search(q, k, nprobe)) == expected
            assert key(index.query_async(q, k, nprobe).result()) == expected
            assert key(small.search(q, k, nprobe)) == expected


def test_least_recently_asked_for_partitions_go():
    held = _Resident(3 * _bytes_of(10, 2))
    for p in range(3):
        held.put(p, np.arange(10), ["x"] * 10, np.zeros((10, 2), np.uint16))
    held.get(0)
    held.put(3, np.arange(10), ["x"] * 10, np.zeros((10, 2), np.uint16))
    assert [p for p in range(4) if held.get(p)] == [0, 2, 3]
    assert held.size == 3 * _bytes_of(10, 2)


def test_ordinals_must_tell_vectors_apart(spark):
    one = [1.0, 2.0]
    for bad, match in (([(1, one), (1, [3.0, 4.0])], "different ordinals"), ([(None, one), (1, one)], "no ordinal")):
        with pytest.raises(InvalidArgs, match=match):
            IndexBuilder(1, 1, 1).build(spark.createDataFrame(bad, "vec_id long, embedding array<double>"))


def test_distances_are_those_of_reconstructions(index, rows):
    back = reconstructed(index)
    q = rows[5] + 0.1
    found = index.query(q, 20, 6).collect()
    expected = sorted((float(((q - v) ** 2).sum()), p, i) for (p, i), v in back.items())[:20]
    assert [(r["partition_index"], r["vector_index"]) for r in found] == [(p, i) for _, p, i in expected]
    assert np.allclose([r["squared_distance"] for r in found], [d for d, _, _ in expected])


def test_probing_reads_the_nearest_partitions_only(index, rows):
    probes, _ = query.probe(rows[:1], index.centroids, 2)
    found = index.query(rows[0], 500, 2).collect()
    assert {r["partition_index"] for r in found} == set(probes[0].tolist())
    sizes = {r["partition_index"]: r["num_vectors"] for r in index.partition_sizes().collect()}
    assert len(found) == sum(sizes[p] for p in probes[0].tolist())


def test_batches_answer_like_single_queries(index, rows):
    got = index.query_batch(rows[:7], 5, 3).orderBy("query_id", "squared_distance", "partition_index", "vector_index").collect()
    for q in range(7):
        own = [(r["vector_id"], round(r["squared_distance"], 9)) for r in got if r["query_id"] == q]
        assert own == [(r["vector_id"], round(r["squared_distance"], 9)) for r in index.query(rows[q], 5, 3).collect()]
    assert index.query_batch(np.zeros((0, 16)), 5, 3).count() == 0


def test_the_sql_way_answers_alike(spark, index, rows):
    asked = spark.createDataFrame([(0, rows[9].tolist())], "query_id long, vec array<double>")
    probes = query.probe_sql(asked, index.centroid_table(), 3)
    table = query.distance_table_sql(probes, index.codebook_table(), 4, 16)
    got = query.best_rows(query.adc_sql(index.encoded, table), 8).orderBy("squared_distance").collect()
    assert [r["vector_id"] for r in got] == [r["vector_id"] for r in index.query(rows[9], 8, 3).collect()]


def test_events_of_queries_and_builds(spark, index, rows):
    seen = []
    found = index.search(rows[0], 3, 2, listener=seen.append)
    names = [e.name for e in seen]
    near = index.probed(rows[0], 2)
    of_partition = [(e.name, e.detail["partition"]) for e in seen if "partition" in e.detail]
    assert names[:4] == list(QUERY_EVENTS[:4])
    assert of_partition == [(f"{w}_partition_query", p) for p in near for w in ("start", "finish")]
    assert names[-2:] == ["start_select", "finish_select"]
    assert set(names) == set(QUERY_EVENTS)
    seen.clear()
    assert index.query_async(rows[0], 3, 2, listener=seen.append).result() == found
    assert {e.name for e in seen} == set(ASYNC_QUERY_EVENTS)
    for name in ASYNC_QUERY_EVENTS:
        if name.startswith("finish"):
            for e in (e for e in seen if e.name == name):
                first = next(i for i, o in enumerate(seen) if o.name == name.replace("finish", "start") and o.detail.get("partition") == e.detail.get("partition"))
                assert first < seen.index(e)
    seen.clear()
    IndexBuilder(3, 2, 3, rounds=2).build(from_block(spark, rows, 16), "vec_ord", "vec", listener=seen.append)
    assert {e.name for e in seen} == set(BUILD_EVENTS)
    for d in range(2):
        own = [e.name for e in seen if e.detail.get("division") == d]
        assert own[0] == "start_quantize" and own[-1] == "finish_quantize" and own.count("cluster") > 2


def test_one_partition(index, rows):
    found = index.query_partition(rows[0], 4, 1000).collect()
    assert {r["partition_index"] for r in found} == {4}


def test_futures(index, rows):
    asked = [index.query_async(rows[k], 3, 2) for k in range(3)]
    assert [[r.vector_id for r in f.result()] for f in asked] == [[r["vector_id"] for r in index.query(rows[k], 3, 2).collect()] for k in range(3)]


def test_what_is_refused(spark, index, rows):
    for bad in (lambda: index.query(rows[0], 0, 1), lambda: index.query(rows[0], 1, 7), lambda: index.query(rows[0][:3], 1, 1), lambda: index.query([float("nan")] * 16, 1, 1), lambda: index.query_partition(rows[0], 6, 1)):
        with pytest.raises(InvalidArgs):
            bad()
    vectors = from_block(spark, rows, 16)
    for builder in (IndexBuilder(6, 5, 8), IndexBuilder(301, 4, 8), IndexBuilder(6, 4, 301)):
        with pytest.raises(InvalidArgs):
            builder.build(vectors, "vec_ord", "vec")
    with pytest.raises(InvalidArgs):
        IndexBuilder().with_partitions(0)


def test_recall_grows_with_probes(index, spark, rows):
    vectors = from_block(spark, rows, 16)
    few, all_of_them = (recall(index, vectors, rows[:4], 10, n) for n in (1, 6))
    assert 0 < few <= all_of_them <= 1


def test_building_is_repeatable(spark, rows):
    vectors = from_block(spark, rows, 16)
    a, b = (IndexBuilder(4, 4, 4, seed=9, rounds=5).build(v, "vec_ord", "vec") for v in (vectors, vectors.repartition(5)))
    assert np.allclose(a.books, b.books)
    key = lambda i: sorted((r["vector_id"], r["partition_index"], r["vector_index"], tuple(r["codes"])) for r in i.encoded.collect())
    assert key(a) == key(b)


def test_attributes(index):
    top = (1 << 64) - 1
    own = index.set_attribute_at(3, "name", "first").set_attribute_at(3, "name", top).set_attribute_at(4, "name", "").set_attribute_at(3, "a", 0)
    ids = {r["vec_ord"]: r["vector_id"] for r in own.encoded.collect()}
    assert own.get_attribute(ids[3], "name") == top
    assert own.get_attribute(ids[4], "name") == ""
    assert own.get_attribute(ids[3], "a") == 0
    assert own.get_attribute(ids[5], "name") is None
    assert own.get_attribute_async(ids[4], "name").result() == ""
    assert own.names() == ["a", "name"]
    maps = {r["vector_id"]: r["attributes"] for r in own.all_attributes().collect()}
    assert len(maps) == 300
    assert set(maps[ids[3]]) == {"a", "name"}
    assert maps[ids[7]] == {}
    assert index.names() == []
    with pytest.raises(InvalidArgs):
        own.get_attribute("no such id", "name")
    with pytest.raises(InvalidArgs):
        own.set_attribute_at(300, "name", "x")
    for bad in (-1, top + 1, 1.5, True, None):
        with pytest.raises(InvalidArgs):
            A.value_of(bad)
    A.check_log(own.written(), own.encoded)


def test_many_values_set_one_by_one_run_no_job(spark, index, monkeypatch):
    def jobs():
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup())

    before, own = jobs(), index
    for k in range(2500):
        own = own.set_attribute_at(k % 300, "n", k)
    assert jobs() == before
    got = {r["vec_ord"]: int(r["value"]["uint64_value"]) for r in own.with_attribute(own.rows(), "n").collect()}
    assert got == {k: max(range(k, 2500, 300)) for k in range(300)}
    assert index.names() == []
    monkeypatch.setattr(index_module, "PENDING", 10)
    few = index
    for k in range(25):
        few = few.set_attribute_at(k, "n", k)
    assert few._pending[2] == 5
    assert few.attributes().count() == 25


def test_unknown_ordinals_among_gaps_are_noticed_when_read(spark, rows):
    vectors = spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(rows[:30])], "vec_ord long, vec array<double>")
    built = IndexBuilder(2, 2, 2, rounds=2).build(vectors, "vec_ord", "vec")
    with pytest.raises(InvalidArgs):
        built.set_attribute_at(88, "n", 1)
    with pytest.raises(InvalidArgs):
        built.set_attribute_at(4, "n", 1).attributes()


def test_a_results_attribute_reads_its_partitions_only(spark, index, rows, tmp_path):
    own = index.set_attributes(index.rows().select("vec_ord", A.number_value(F.col("vec_ord")).alias("value")), "n")
    near = own.probed(rows[0], 2)
    folder = str(tmp_path / "snapshot")
    storage.save(own, folder)
    for one in (own, storage.load(spark, folder)):
        found = one.with_attribute(one.query(rows[0], 5, 2), "n", partitions=near)
        filters = re.findall(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan(found))
        assert len(filters) == 2
        assert all(all(str(p) in f for p in near) and "partition_index" in f for f in filters)
        assert found.filter("value is null").count() == 0
    back = storage.load(spark, folder)
    for r in back.search(rows[0], 5, 2):
        assert back.get_attribute(r.vector_id, "n", r.partition_index) == own.get_attribute(r.vector_id, "n")
    assert set(back._logs) <= set(near)
    assert not back._checked["partitions"]  # the driver verified what it read; no job did
    with pytest.raises(InvalidArgs):
        back.get_attribute("no such id", "n", near[0])


def test_logs_that_contradict_themselves(spark, index):
    row = index.encoded.first()
    empty = spark.createDataFrame([(row["partition_index"], row["vector_id"], "n", (None, None), 0)], A.LOG)
    stray = spark.createDataFrame([(row["partition_index"] + 1, row["vector_id"], "n", ("x", None), 0)], A.LOG)
    for log in (empty, stray):
        with pytest.raises(InvalidData):
            A.check_log(log, index.encoded)
    with pytest.raises(InvalidData):
        A.python_value({"string_value": None, "uint64_value": None})


def test_snapshots(spark, index, rows, tmp_path):
    own = index.set_attribute_at(0, "n", 12).set_attribute_at(1, "s", "text")
    folder = str(tmp_path / "snapshot")
    name = storage.save(own, folder)
    assert storage.snapshot_id(spark, folder) == name
    back = storage.load(spark, folder)
    assert back.names() == ["n", "s"]
    assert (back.num_vectors, back.num_partitions, back.num_codes) == (300, 6, 8)
    assert [r["vector_id"] for r in back.query(rows[0], 9, 3).collect()] == [r["vector_id"] for r in own.query(rows[0], 9, 3).collect()]
    ids = {r["vec_ord"]: r["vector_id"] for r in own.encoded.collect()}
    assert back.get_attribute(ids[0], "n") == 12
    changed = back.set_attributes(spark.createDataFrame([(ids[0], (None, 13))], f"vector_id string, value {A.VALUE}".replace("decimal(20,0)", "long")).withColumn("value", F.col("value").cast(A.VALUE)), "n")
    assert changed.get_attribute(ids[0], "n") == 13
    assert storage.load_async(spark, folder).result().num_partitions == 6
    with pytest.raises(InvalidArgs):
        storage.save(own, folder)


def test_a_probed_scan_reads_the_probed_folders(spark, index, rows, tmp_path):
    folder = str(tmp_path / "snapshot")
    storage.save(index, folder)
    back = storage.load(spark, folder)
    plan = back.query(rows[0], 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_index" in plan or "PartitionFilters: [partition_index" in plan


def test_tampering_is_noticed(spark, index, rows, tmp_path):
    folder = tmp_path / "snapshot"
    storage.save(index.set_attribute_at(0, "n", 1), str(folder))
    def spoil(victim, checksum):
        whole = victim.read_bytes()
        victim.write_bytes(whole[:-9] + bytes([whole[-9] ^ 1]) + whole[-8:])
        crc = victim.with_name(f".{victim.name}.crc")
        if not checksum:
            crc.unlink()
        return whole

    victims = [next(folder.glob(f"{where}/*.parquet")) for where in ("codebooks/division=1", "centroids", "partitions/partition_index=2", "attributes/partition_index=*")]
    for checksum in (True, False):  # the file system's own checksum speaks first where there is one
        for victim in victims:
            whole = spoil(victim, checksum)
            for ask in (lambda i: i.search(rows[0], 3, 6), lambda i: i.query(rows[0], 3, 6).collect(), lambda i: i.all_attributes().collect()):
                loaded = storage.load(spark, str(folder))
                if victim is not victims[3] and not (ask.__code__.co_names[0] == "all_attributes" and victim is not victims[2]):
                    with pytest.raises(VerificationFailure):
                        ask(loaded)
            with pytest.raises(VerificationFailure):
                storage.load(spark, str(folder), check_files=True)
            if victim is victims[3]:
                with pytest.raises(VerificationFailure):
                    storage.load(spark, str(folder)).attributes()
            victim.write_bytes(whole)
    # What is not asked for is not read.
    spoil(victims[2], False) if victims[2].with_name(f".{victims[2].name}.crc").exists() else victims[2].write_bytes(b"x")
    other = storage.load(spark, str(folder))
    assert other.query_partition(rows[0], 3, 2).count() == 2
    with pytest.raises(VerificationFailure):
        other.query_partition(rows[0], 2, 2)
    with pytest.raises(StorageError):
        storage.load(spark, str(tmp_path / "nowhere"))
    (folder / "codebooks/division=0").rename(tmp_path / "gone")
    with pytest.raises(StorageError):
        storage.load(spark, str(folder)).codebook(0)
    manifest = next(folder.glob("*.manifest.json"))
    manifest.write_bytes(manifest.read_bytes() + b" ")
    next(folder.glob(".*manifest.json.crc")).unlink()
    with pytest.raises(VerificationFailure):
        storage.load(spark, str(folder))


def test_streams_of_queries(spark, index, rows, tmp_path):
    folder, seen = str(tmp_path / "asked"), []
    spark.createDataFrame([(100 + k, rows[k].tolist()) for k in range(3)], "query_id long, vec array<double>").write.parquet(folder)
    stream = spark.readStream.schema("query_id long, vec array<double>").parquet(folder)
    running = answer_stream(stream, index, 2, 2, lambda df, n: seen.extend(df.collect()), str(tmp_path / "checkpoint"))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted({r["query_id"] for r in seen}) == [100, 101, 102]
    assert len(seen) == 6


def test_numbered(spark):
    df = spark.createDataFrame([(4, [1.0])], "id int, v array<float>")
    assert numbered(df, "id", "v").first().asDict() == {"vec_ord": 4, "vec": [1.0]}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_recall_of_the_registered_batch(spark):
    from quiverine.plans import catalog

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    vectors = np.array([r["embedding"] for r in rows])
    got = {}
    for r in catalog.QUERIES["knn_batch_trained"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == {r["vec_id"] for r in rows if r["vec_id"] % 50 == 0}
    right = 0
    for k in got:
        nearest = np.argsort(((vectors - vectors[k]) ** 2).sum(axis=1), kind="stable")[:10]
        right += len(got[k] & {rows[i]["vec_id"] for i in nearest})
    assert right >= 0.9 * 10 * len(got)


def test_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(InvalidContext):
        tables.work_folder(Session())


def test_programs(spark, tmp_path, capsys):
    from quiverine.__main__ import main

    folder = str(tmp_path / "demo")
    small = ["--vectors", "200", "--size", "16", "--partitions", "4", "--divisions", "4", "--clusters", "8"]
    main(["generate", folder, *small], spark)
    first = capsys.readouterr().out
    assert "saved as" in first and "finish_quantize" in first and "datum-" in first
    main(["load", folder], spark)
    assert "query 1" in capsys.readouterr().out
    main(["load-async", folder], spark)
    heard = capsys.readouterr().out
    assert all(name in heard for name in ASYNC_QUERY_EVENTS)
    assert "datum-" in heard


def test_benchmarks_run_small(spark):
    from quiverine.plans import benchmarks

    out = benchmarks.published(spark, vectors=300, size=12, divisions=3, partitions=5, codes=8, k=4, nprobe=2, queries=3)
    assert {"build", "save", "load_header", "query_cold", "query_warm", "attributes_warm", "async_query_cold", "recall"} <= set(out)
    assert 0 <= out["recall"] <= out["recall_all_probed"] <= 1
    assert all(len(s) == 1 for s in benchmarks.kernels(spark, 20_000, 1000, 1).values())


def test_the_rest_stands_where_the_training_data_operators_are_deleted(tmp_path):
    root, copied = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    for part in ("quiverine", "tests", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / part), f"{copied.mkdir(exist_ok=True) or copied}/"], check=True)
    for gone in ("quiverine/llm", "tests/llm"):
        subprocess.run(["rm", "-rf", str(copied / gone)], check=True)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert e.llm is None and e.pipeline is None; assert not any(n.startswith('op') for n in e.queries()); print('stands')"
    assert "stands" in subprocess.run([sys.executable, "-c", code], cwd=copied, capture_output=True, text=True, check=True).stdout
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copied, capture_output=True, check=True)
