"""All queries of the engine's own operators, with their SQL.

The SQL works on fixed starting points: centres are the vectors 0 to 9, code
vectors the residual slices of the vectors 10 to 25, the query is vector 3.
Distances are summed in the order of divisions, so equal codes tie in either.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverine.functions import vector as V
from quiverine.functions.content import content_id
from quiverine.operators import attributes as A
from quiverine.operators import kmeans, partitions, quantize, query, sampling
from quiverine.operators.index import Index, IndexBuilder
from quiverine.operators.vectors import divided, matrix, numbered
from quiverine.sources import interchange, storage
from quiverine.sources.tables import work_path

P, D, C, SIZE, K, NPROBE = 10, 8, 16, 64, 10, 3
WIDTH = SIZE // D


def r6(x: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(_embeddings(spark, sf), "vec_id", "embedding")


def _rows(spark: SparkSession, sf: str, first: int, last: int) -> np.ndarray:
    found = _vectors(spark, sf).filter(F.col("vec_ord").between(first, last)).orderBy("vec_ord").toArrow()
    return matrix(found.column("vec").combine_chunks())


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, x, y): every vector beside vector 3."""
    return _vectors(spark, sf).select(F.col("vec_ord").alias("vec_id"), F.col("vec").alias("x"), V.literal(_rows(spark, sf, 3, 3)[0]).alias("y"))


def _scalar(value, name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _pairs(spark, sf).select("vec_id", r6(value()).alias(name))

    return run


def _cells(value):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _pairs(spark, sf).select("vec_id", F.posexplode(value()).alias("pos", "x")).select("vec_id", "pos", r6("x").alias("x"))

    return run


def _centres(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).filter(F.col("vec_ord") < P).select(F.col("vec_ord").cast("int").alias("cluster"), F.col("vec").alias("centroid"))


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.assign_sql(_vectors(spark, sf), _centres(spark, sf))


def _books(spark: SparkSession, sf: str) -> tuple[np.ndarray, np.ndarray]:
    """The fixed centres and codebooks."""
    centres, rows = _rows(spark, sf, 0, P - 1), _rows(spark, sf, P, P + C - 1)
    nearest, _ = kmeans.nearest_block(rows, centres)
    residues = rows - centres[nearest]
    return centres, residues.reshape(C, D, WIDTH).transpose(1, 0, 2).copy()


def _index(spark: SparkSession, sf: str) -> Index:
    return IndexBuilder(P, D, C).encode(_vectors(spark, sf), *_books(spark, sf))


# Vectors


def vec_chunk(spark: SparkSession, sf: str) -> DataFrame:
    cut = _embeddings(spark, sf).select("vec_id", F.posexplode(V.chunk("embedding", 16)).alias("chunk", "v"))
    return cut.select("vec_id", "chunk", r6(V.total("v")).alias("total"), F.size("v").alias("width"))


def vec_divide(spark: SparkSession, sf: str) -> DataFrame:
    return divided(_vectors(spark, sf), D, SIZE).select(F.col("vec_ord").alias("vec_id"), "division", r6(V.total("sub")).alias("total"), r6(F.get("sub", F.lit(0))).alias("first"))


# k-means


def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.assign(_vectors(spark, sf), _rows(spark, sf, 0, P - 1)).select(F.col("vec_ord").alias("vec_id"), "cluster", r6("squared_distance").alias("squared_distance"))


def kmeans_assign_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf).select(F.col("vec_ord").alias("vec_id"), "cluster", r6("squared_distance").alias("squared_distance"))


def _centre_cells(centres: DataFrame) -> DataFrame:
    return centres.select("cluster", F.posexplode("centroid").alias("pos", "x")).select("cluster", "pos", r6("x").alias("x"))


def kmeans_update(spark: SparkSession, sf: str) -> DataFrame:
    return _centre_cells(kmeans.means_sql(_vectors(spark, sf), _assigned(spark, sf)))


def kmeans_shift(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.shift_sql(_centres(spark, sf), kmeans.means_sql(_vectors(spark, sf), _assigned(spark, sf))).select(r6("shift").alias("shift"))


def kmeans_lloyd2(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds by the distributed pass."""
    centres = kmeans.fit(_vectors(spark, sf), P, init=_rows(spark, sf, 0, P - 1), rounds=2, epsilon=0.0)
    return _centre_cells(kmeans.centroid_table(spark, centres))


def kmeans_train_random(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn centres, trained over all vectors until they stand still: their number, the vectors they hold, and whether another round would move them."""
    vectors = _vectors(spark, sf)
    centres = kmeans.centroid_table(spark, kmeans.fit(vectors, P, seed=1, rounds=None))
    assigned = kmeans.assign_sql(vectors, centres)
    held = assigned.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), F.sum("n").alias("n"))
    moves = kmeans.shift_sql(centres, kmeans.means_sql(vectors, assigned)).select((F.col("shift") > 1e-3).alias("moves"))
    return held.join(moves)  # one row each


def kmeanspp_min_distance(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.least_distance(_vectors(spark, sf), _centres(spark, sf)).select(F.col("vec_ord").alias("vec_id"), r6("weight").alias("weight"))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return _embeddings(spark, sf).select("vec_id", F.col("label").cast("double").alias("weight"))


def weighted_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cumulative(_weights(spark, sf), "vec_id", "weight").select("vec_id", r6("cumulative").alias("cumulative"))


def weighted_sample_at(spark: SparkSession, sf: str) -> DataFrame:
    totals, found = sampling.cumulative(_weights(spark, sf), "vec_id", "weight"), None
    for u in (0.0, 10.5, 100.0, 1000.0):
        own = sampling.first_over(totals, "vec_id", "weight", F.lit(u)).select(F.lit(u).alias("u"), "vec_id")
        found = own if found is None else found.unionByName(own)
    return found


# Partitions and codes


def partition_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return partitions.sizes(partitions.residuals(_vectors(spark, sf), _rows(spark, sf, 0, P - 1)))


def partition_residuals(spark: SparkSession, sf: str) -> DataFrame:
    found = partitions.residuals(_vectors(spark, sf), _rows(spark, sf, 0, P - 1))
    return found.select(F.col("vec_ord").alias("vec_id"), "partition_index", F.posexplode("residue").alias("pos", "x")).select("vec_id", "partition_index", "pos", r6("x").alias("x"))


def partition_residuals_sql(spark: SparkSession, sf: str) -> DataFrame:
    found = partitions.residuals_sql(_vectors(spark, sf), _assigned(spark, sf), _centres(spark, sf))
    return found.select(F.col("vec_ord").alias("vec_id"), "partition_index", F.posexplode("residue").alias("pos", "x")).select("vec_id", "partition_index", "pos", r6("x").alias("x"))


def partition_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    found = partitions.residuals(_vectors(spark, sf), _rows(spark, sf, 0, P - 1))
    back = partitions.reconstruct(found, _centres(spark, sf))
    return back.select(F.col("vec_ord").alias("vec_id"), F.posexplode("vec").alias("pos", "x")).select("vec_id", "pos", r6("x").alias("x"))


def pq_codebook(spark: SparkSession, sf: str) -> DataFrame:
    cells = _index(spark, sf).codebook_table().select("division", "code", F.posexplode("code_vector").alias("pos", "x"))
    return cells.select("division", "code", "pos", r6("x").alias("x"))


def _codes(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.col("vec_ord").alias("vec_id"), "partition_index", F.posexplode("codes").alias("division", "code"))


def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _codes(quantize.encode(_vectors(spark, sf), *_books(spark, sf)))


def pq_encode_sql(spark: SparkSession, sf: str) -> DataFrame:
    found = partitions.residuals_sql(_vectors(spark, sf), _assigned(spark, sf), _centres(spark, sf))
    return _codes(quantize.encode_sql(found, _index(spark, sf).codebook_table(), D, SIZE))


def pq_vector_index(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).encoded.select(F.col("vec_ord").alias("vec_id"), "partition_index", "vector_index")


def pq_train_random(spark: SparkSession, sf: str) -> DataFrame:
    """Codebooks trained on a sample of at most 65,536 residuals: each division's codes that are in use, its vectors, and those whose code isn't the nearest by built-in expressions."""
    vectors, centres = _vectors(spark, sf), _rows(spark, sf, 0, P - 1)
    books = quantize.train_codebooks(partitions.residuals(vectors, centres), D, C, SIZE)
    rows = [(d, c, books[d, c].tolist()) for d in range(D) for c in range(C)]
    exact = quantize.encode_sql(partitions.residuals_sql(vectors, _assigned(spark, sf), _centres(spark, sf)), spark.createDataFrame(rows, "division int, code int, code_vector array<double>"), D, SIZE)
    both = _codes(quantize.encode(vectors, centres, books)).join(_codes(exact).withColumnRenamed("code", "nearest"), ["vec_id", "partition_index", "division"])
    return both.groupBy("division").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("n"), F.count(F.when(F.col("code") != F.col("nearest"), 1)).alias("wrong"))


# Queries


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).filter(F.col("vec_ord") == 3).select(F.col("vec_ord").alias("query_id"), "vec")


def _probes(spark: SparkSession, sf: str, index: Index) -> DataFrame:
    return query.probe_sql(_one(spark, sf), index.centroid_table(), NPROBE)


def probe_select(spark: SparkSession, sf: str) -> DataFrame:
    return _probes(spark, sf, _index(spark, sf)).select("query_id", "partition_index", "probe_rank", r6("squared_distance").alias("squared_distance"))


def distance_table(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return query.distance_table_sql(_probes(spark, sf, index), index.codebook_table(), D, SIZE).select("query_id", "partition_index", "division", "code", r6("squared_distance").alias("squared_distance"))


def adc_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of the probed partitions, codes joined to the table."""
    index = _index(spark, sf)
    table = query.distance_table_sql(_probes(spark, sf, index), index.codebook_table(), D, SIZE)
    return query.adc_sql(index.encoded, table).select("partition_index", "vector_index", r6("squared_distance").alias("squared_distance"))


def partition_query(spark: SparkSession, sf: str) -> DataFrame:
    return index_rows(_index(spark, sf).query_partition(_rows(spark, sf, 3, 3)[0], 3, K))


def index_rows(found: DataFrame) -> DataFrame:
    return found.select("partition_index", "vector_index", r6("squared_distance").alias("squared_distance"))


def knn_query(spark: SparkSession, sf: str) -> DataFrame:
    return index_rows(_index(spark, sf).query(_rows(spark, sf, 3, 3)[0], K, NPROBE))


def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    found = _index(spark, sf).query_batch(_rows(spark, sf, 0, 19), K, NPROBE)
    return found.select("query_id", "partition_index", "vector_index", r6("squared_distance").alias("squared_distance"))


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    found = query.knn_exact(_vectors(spark, sf), _rows(spark, sf, 3, 3)[0], K)
    return found.select(F.col("vec_ord").alias("vec_id"), r6("squared_distance").alias("squared_distance"))


def n_best(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).select(F.col("vec_ord").alias("vec_id"), r6(V.total("vec")).alias("total"))
    return query.n_best(rows, K, "total", "vec_id")


def _at_hand(spark: SparkSession, found: list[list]) -> DataFrame:
    rows = [(q, r.partition_index, r.vector_index, r.squared_distance) for q, own in enumerate(found) for r in own]
    table = spark.createDataFrame(rows, "query_id long, partition_index int, vector_index int, squared_distance double")
    return table.select("query_id", "partition_index", "vector_index", r6("squared_distance").alias("squared_distance"))


def knn_async(spark: SparkSession, sf: str) -> DataFrame:
    """Two queries side by side, as futures."""
    index = _index(spark, sf)
    asked = [index.query_async(v, K, NPROBE) for v in _rows(spark, sf, 3, 4)]
    return _at_hand(spark, [f.result() for f in asked])


def knn_search(spark: SparkSession, sf: str) -> DataFrame:
    """One query answered at once, from partitions that the driver keeps."""
    return _at_hand(spark, [_index(spark, sf).search(_rows(spark, sf, 3, 3)[0], K, NPROBE)]).drop("query_id")


def knn_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for its neighbours."""
    asked = _vectors(spark, sf).withColumnRenamed("vec_ord", "query_id")
    found = _index(spark, sf).query_table(asked, K, NPROBE)
    return found.select("query_id", "partition_index", "vector_index", r6("squared_distance").alias("squared_distance"))


# Attributes: label (a number), and lang (a text) where there is a document; label is set to 100 + label again where it is under 3.


def _with_attributes(spark: SparkSession, sf: str) -> Index:
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("vec_ord"), "label")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("vec_ord"), "lang").filter("lang is not null")
    index = _index(spark, sf).set_attributes(rows.select("vec_ord", A.number_value(F.col("label")).alias("value")), "label")
    index = index.set_attributes(rows.filter("label < 3").select("vec_ord", A.number_value(F.col("label") + 100).alias("value")), "label")
    langs = rows.join(docs, "vec_ord").select("vec_ord", A.text_value(F.col("lang")).alias("value"))
    return index.set_attributes(langs, "lang")


def _named(index: Index, attributes: DataFrame) -> DataFrame:
    return attributes.join(index.encoded.select("partition_index", "vector_id", F.col("vec_ord").alias("vec_id")), ["partition_index", "vector_id"])


def attr_set_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    index = _with_attributes(spark, sf)
    return _named(index, index.attributes()).select("vec_id", "name", F.col("value.string_value").alias("string_value"), F.col("value.uint64_value").cast("long").alias("number_value"))


def attr_get(spark: SparkSession, sf: str) -> DataFrame:
    index = _with_attributes(spark, sf)
    found = index.with_attribute(index.encoded, "label")
    return found.select(F.col("vec_ord").alias("vec_id"), F.col("value.uint64_value").cast("long").alias("label"))


def attr_missing_default(spark: SparkSession, sf: str) -> DataFrame:
    index = _with_attributes(spark, sf)
    maps = index.all_attributes().join(index.encoded.select("vector_id", F.col("vec_ord").alias("vec_id")), "vector_id")
    return maps.select("vec_id", F.size("attributes").alias("n"))


def attr_names_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return A.names(_with_attributes(spark, sf).attributes())


def attr_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    index = _with_attributes(spark, sf)
    log = index.attributes()
    dictionary = A.names(log)
    back = A.decode_names(A.encode_names(log, dictionary), dictionary)
    return back.groupBy("name").agg(F.count("*").alias("n"))


def knn_with_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return _with_label(_with_attributes(spark, sf), spark, sf).drop("squared_distance")


def _with_label(index: Index, spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of vector 3 with their label, from the logs of the probed partitions."""
    vector = _rows(spark, sf, 3, 3)[0]
    found = index.with_attribute(index.query(vector, K, NPROBE), "label", partitions=index.probed(vector, NPROBE))
    return found.select("partition_index", "vector_index", r6("squared_distance").alias("squared_distance"), F.col("value.uint64_value").cast("long").alias("label"))


# Storage


def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", content_id(F.col("text")).alias("content_id"))


def index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Save, load, and ask the loaded index, with an attribute."""
    folder = work_path(spark, "snapshot")
    storage.save(_with_attributes(spark, sf), folder)
    return _with_label(storage.load(spark, folder), spark, sf)


def messages_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The same by message files: every vector that comes back, with its attributes."""
    index = _with_attributes(spark, sf)
    folder = work_path(spark, "messages")
    interchange.export(index, folder)
    back = interchange.load(spark, folder)
    ids = index.rows().select("vector_id", F.col("vec_ord").alias("vec_id"))
    maps = back.all_attributes().select("vector_id", F.col("attributes")["label"]["uint64_value"].cast("long").alias("label"), F.col("attributes")["lang"]["string_value"].alias("lang"))
    rows = back.rows().join(maps, "vector_id").join(ids, "vector_id")
    return rows.select("vec_id", "partition_index", "vector_index", F.size("codes").alias("divisions"), "label", "lang")


def index_build_random(spark: SparkSession, sf: str) -> DataFrame:
    """A trained index asked for the neighbours of vector 3: places, and whether the distance is that of the vector put together from its codes."""
    index = IndexBuilder(P, D, C).build(_embeddings(spark, sf))
    vector = _rows(spark, sf, 3, 3)[0]
    found = index.query(vector, K, NPROBE).join(index.rows().select("vector_id", "codes"), "vector_id")
    cells = found.select("partition_index", "vector_index", "squared_distance", F.posexplode("codes").alias("division", "code")).join(index.codebook_table(), ["division", "code"])
    back = cells.groupBy("partition_index", "vector_index", "squared_distance").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("division", "code_vector"))), lambda c: c["code_vector"])).alias("residue"))
    back = back.join(index.centroid_table(), "partition_index").withColumn("d", V.squared_distance(V.add("residue", "centroid"), V.literal(vector)))
    place = F.row_number().over(Window.orderBy("squared_distance", "partition_index", "vector_index"))  # K rows
    return back.select(place.alias("place"), (F.abs(F.col("d") - F.col("squared_distance")) < 1e-9).alias("agrees"))


def knn_batch_trained(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by 50, by a trained index of one code for each element that probes all partitions."""
    index = IndexBuilder(P, SIZE, 64).build(_embeddings(spark, sf), order="vec_id", vec="embedding")
    asked = _vectors(spark, sf).filter(F.col("vec_ord") % 50 == 0).withColumnRenamed("vec_ord", "query_id")
    ids = index.rows().select("partition_index", "vector_index", F.col("vec_ord").alias("vec_id"))
    found = index.query_table(asked, K, P).join(ids, ["partition_index", "vector_index"])
    return found.select("query_id", "vec_id", r6("squared_distance").alias("squared_distance"))


QUERIES = {
    "vec_dot": _scalar(lambda: V.dot("x", "y"), "dot"),
    "vec_norm2": _scalar(lambda: V.norm2("x"), "norm2"),
    "vec_sum": _scalar(lambda: V.total("x"), "total"),
    "vec_min": _scalar(lambda: V.smallest("x"), "least"),
    "vec_max_abs": _scalar(lambda: V.max_abs("x"), "max_abs"),
    "vec_sqdist": _scalar(lambda: V.squared_distance("x", "y"), "squared_distance"),
    "vec_add": _cells(lambda: V.add("x", "y")),
    "vec_subtract": _cells(lambda: V.subtract("x", "y")),
    "vec_scale": _cells(lambda: V.scale("x", 2.5)),
    "vec_normalize": _cells(lambda: V.normalize(V.add("x", "y"))),
    "vec_chunk": vec_chunk,
    "vec_divide": vec_divide,
    "kmeans_assign": kmeans_assign,
    "kmeans_assign_sql": kmeans_assign_sql,
    "kmeans_update": kmeans_update,
    "kmeans_shift": kmeans_shift,
    "kmeans_lloyd2": kmeans_lloyd2,
    "kmeans_train_random": kmeans_train_random,
    "kmeanspp_min_distance": kmeanspp_min_distance,
    "weighted_cumulative": weighted_cumulative,
    "weighted_sample_at": weighted_sample_at,
    "partition_sizes": partition_sizes,
    "partition_residuals": partition_residuals,
    "partition_residuals_sql": partition_residuals_sql,
    "partition_reconstruct": partition_reconstruct,
    "pq_codebook": pq_codebook,
    "pq_encode": pq_encode,
    "pq_encode_sql": pq_encode_sql,
    "pq_vector_index": pq_vector_index,
    "pq_train_random": pq_train_random,
    "probe_select": probe_select,
    "distance_table": distance_table,
    "adc_scan": adc_scan,
    "partition_query": partition_query,
    "knn_query": knn_query,
    "knn_batch": knn_batch,
    "knn_exact": knn_exact,
    "knn_async": knn_async,
    "knn_search": knn_search,
    "knn_table": knn_table,
    "n_best": n_best,
    "attr_set_last_wins": attr_set_last_wins,
    "attr_get": attr_get,
    "attr_missing_default": attr_missing_default,
    "attr_names_sorted": attr_names_sorted,
    "attr_dictionary": attr_dictionary,
    "knn_with_attributes": knn_with_attributes,
    "content_id": content_ids,
    "index_roundtrip": index_roundtrip,
    "messages_roundtrip": messages_roundtrip,
    "index_build_random": index_build_random,
    "knn_batch_trained": knn_batch_trained,
}

# The same in SQL.

_SQD = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _sqd(x: str, y: str) -> str:
    return _SQD.format(x, y)


def _each(op: str, x: str, y: str) -> str:
    return f"list_transform(list_zip({x}, {y}), lambda p: p[1] {op} p[2])"


def _round(x: str) -> str:
    return f"round({x}, 6) + 0.0"


_STEPS = {
    "v": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    "pairs": "SELECT a.vec_id, a.vec AS x, b.vec AS y FROM v a, v b WHERE b.vec_id = 3",
    "centres": f"SELECT CAST(vec_id AS INTEGER) AS cluster, vec AS centroid FROM v WHERE vec_id < {P}",
    "far": f"SELECT vec_id, vec, cluster, centroid, {_sqd('vec', 'centroid')} AS d FROM v, centres",
    "assigned": "SELECT vec_id, arg_min(cluster, {'d': d, 'c': cluster}) AS cluster, min(d) AS d FROM far GROUP BY vec_id",
    "means": "SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v JOIN assigned USING (vec_id)) GROUP BY cluster, pos",
    "mean_vectors": "SELECT cluster, list(x ORDER BY pos) AS centroid FROM means GROUP BY cluster",
    "far2": f"SELECT vec_id, vec, cluster, {_sqd('vec', 'centroid')} AS d FROM v, mean_vectors",
    "assigned2": "SELECT vec_id, arg_min(cluster, {'d': d, 'c': cluster}) AS cluster FROM far2 GROUP BY vec_id",
    "means2": "SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v JOIN assigned2 USING (vec_id)) GROUP BY cluster, pos",
    "residues": f"SELECT vec_id, a.cluster AS partition_index, {_each('-', 'vec', 'centroid')} AS residue, centroid FROM v JOIN assigned a USING (vec_id) JOIN centres c ON c.cluster = a.cluster",
    "subs": f"SELECT vec_id, partition_index, CAST(t.d AS INTEGER) AS division, list_slice(residue, t.d * {WIDTH} + 1, t.d * {WIDTH} + {WIDTH}) AS sub FROM residues, range({D}) t(d)",
    "books": f"SELECT division, CAST(vec_id - {P} AS INTEGER) AS code, sub AS code_vector FROM subs WHERE vec_id BETWEEN {P} AND {P + C - 1}",
    "sub_far": f"SELECT vec_id, partition_index, s.division, code, {_sqd('sub', 'code_vector')} AS d FROM subs s JOIN books b ON s.division = b.division",
    "codes": "SELECT vec_id, partition_index, division, arg_min(code, {'d': d, 'c': code}) AS code FROM sub_far GROUP BY vec_id, partition_index, division",
    "places": "SELECT vec_id, partition_index, CAST(row_number() OVER (PARTITION BY partition_index ORDER BY vec_id) - 1 AS INTEGER) AS vector_index FROM residues",
    "asked": "SELECT vec_id AS query_id, vec FROM v",
    "near": f"SELECT query_id, cluster AS partition_index, {_sqd('vec', 'centroid')} AS d, {_each('-', 'vec', 'centroid')} AS localized FROM asked, centres",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, partition_index) - 1 AS INTEGER) AS probe_rank FROM near",
    "probes": f"SELECT * FROM ranked WHERE probe_rank < {NPROBE}",
    "slices": f"SELECT query_id, partition_index, CAST(t.d AS INTEGER) AS division, list_slice(localized, t.d * {WIDTH} + 1, t.d * {WIDTH} + {WIDTH}) AS sub FROM probes, range({D}) t(d)",
    "dtable": f"SELECT query_id, partition_index, s.division, code, {_sqd('sub', 'code_vector')} AS d FROM slices s JOIN books b ON s.division = b.division",
    "adc": "SELECT query_id, partition_index, vector_index, vec_id, list_sum(list(d ORDER BY division)) AS d FROM codes JOIN places USING (vec_id, partition_index) JOIN dtable USING (partition_index, division, code) GROUP BY query_id, partition_index, vector_index, vec_id",
    "best": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, partition_index, vector_index) AS r FROM adc",
    "found": f"SELECT * FROM best WHERE r <= {K}",
    "attrs": "SELECT vec_id, 'label' AS name, CAST(NULL AS VARCHAR) AS string_value, CAST(CASE WHEN label < 3 THEN label + 100 ELSE label END AS BIGINT) AS number_value FROM embeddings UNION ALL SELECT vec_id, 'lang', lang, NULL FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang IS NOT NULL",
    "running": "SELECT vec_id, CAST(label AS DOUBLE) AS weight, sum(CAST(label AS DOUBLE)) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS cumulative FROM embeddings",
}


def _sql(final: str) -> str:
    """A query with the steps that it mentions, and those that they mention."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in _STEPS:
            if name not in need and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                add(_STEPS[name])

    add(final)
    steps = ", ".join(f"{name} AS ({sql})" for name, sql in _STEPS.items() if name in need)
    return f"WITH {steps} {final}" if steps else final


def _cell_sql(value: str) -> str:
    return f"SELECT vec_id, pos, {_round('x')} AS x FROM (SELECT vec_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS x FROM (SELECT vec_id, {value} AS l FROM pairs))"


_SUM = _each("+", "x", "y")
_RESIDUE_CELLS = f"SELECT vec_id, partition_index, pos, {_round('x')} AS x FROM (SELECT vec_id, partition_index, CAST(generate_subscripts(residue, 1) - 1 AS INTEGER) AS pos, unnest(residue) AS x FROM residues)"
_ASSIGN = f"SELECT vec_id, cluster, {_round('d')} AS squared_distance FROM assigned"
_CODES = "SELECT vec_id, partition_index, division, code FROM codes"
_FOUND = f"SELECT partition_index, vector_index, {_round('d')} AS squared_distance FROM found WHERE query_id = 3"

ORACLES = {
    name: _sql(final)
    for name, final in {
        "vec_dot": f"SELECT vec_id, {_round('list_inner_product(x, y)')} AS dot FROM pairs",
        "vec_norm2": f"SELECT vec_id, {_round('sqrt(list_inner_product(x, x))')} AS norm2 FROM pairs",
        "vec_sum": f"SELECT vec_id, {_round('list_sum(x)')} AS total FROM pairs",
        "vec_min": f"SELECT vec_id, {_round('list_min(x)')} AS least FROM pairs",
        "vec_max_abs": f"SELECT vec_id, {_round('list_max(list_transform(x, lambda e: abs(e)))')} AS max_abs FROM pairs",
        "vec_sqdist": f"SELECT vec_id, {_round(_sqd('x', 'y'))} AS squared_distance FROM pairs",
        "vec_add": _cell_sql(_SUM),
        "vec_subtract": _cell_sql(_each("-", "x", "y")),
        "vec_scale": _cell_sql("list_transform(x, lambda e: e * 2.5)"),
        "vec_normalize": _cell_sql(f"list_transform({_SUM}, lambda e: e / sqrt(list_inner_product({_SUM}, {_SUM})))"),
        "vec_chunk": f"SELECT vec_id, CAST(t.c AS INTEGER) AS chunk, {_round('list_sum(list_slice(vec, t.c * 16 + 1, t.c * 16 + 16))')} AS total, CAST(len(list_slice(vec, t.c * 16 + 1, t.c * 16 + 16)) AS INTEGER) AS width FROM v, range({SIZE // 16}) t(c)",
        "vec_divide": f"SELECT vec_id, CAST(t.d AS INTEGER) AS division, {_round(f'list_sum(list_slice(vec, t.d * {WIDTH} + 1, t.d * {WIDTH} + {WIDTH}))')} AS total, {_round(f'vec[t.d * {WIDTH} + 1]')} AS first FROM v, range({D}) t(d)",
        "kmeans_assign": _ASSIGN,
        "kmeans_assign_sql": _ASSIGN,
        "kmeans_update": f"SELECT cluster, CAST(pos AS INTEGER) AS pos, {_round('x')} AS x FROM means",
        "kmeans_shift": f"SELECT {_round('max(sqrt(' + _sqd('m.centroid', 'c.centroid') + ')) / max(sqrt(list_inner_product(m.centroid, m.centroid)))')} AS shift FROM centres c JOIN mean_vectors m ON c.cluster = m.cluster",
        "kmeans_lloyd2": f"SELECT cluster, CAST(pos AS INTEGER) AS pos, {_round('x')} AS x FROM means2",
        "kmeanspp_min_distance": f"SELECT vec_id, {_round('d')} AS weight FROM assigned",
        "weighted_cumulative": f"SELECT vec_id, {_round('cumulative')} AS cumulative FROM running",
        "weighted_sample_at": "SELECT u, min(vec_id) AS vec_id FROM running, (VALUES (CAST(0.0 AS DOUBLE)), (10.5), (100.0), (1000.0)) d(u) WHERE cumulative > u AND weight > 0 GROUP BY u",
        "partition_sizes": "SELECT partition_index, count(*) AS num_vectors FROM residues GROUP BY partition_index",
        "partition_residuals": _RESIDUE_CELLS,
        "partition_residuals_sql": _RESIDUE_CELLS,
        "partition_reconstruct": f"SELECT vec_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, {_round('unnest(vec)')} AS x FROM v",
        "pq_codebook": f"SELECT division, code, CAST(generate_subscripts(code_vector, 1) - 1 AS INTEGER) AS pos, {_round('unnest(code_vector)')} AS x FROM books",
        "pq_encode": _CODES,
        "pq_encode_sql": _CODES,
        "pq_vector_index": "SELECT vec_id, partition_index, vector_index FROM places",
        "probe_select": f"SELECT query_id, partition_index, probe_rank, {_round('d')} AS squared_distance FROM probes WHERE query_id = 3",
        "distance_table": f"SELECT query_id, partition_index, division, code, {_round('d')} AS squared_distance FROM dtable WHERE query_id = 3",
        "adc_scan": f"SELECT partition_index, vector_index, {_round('d')} AS squared_distance FROM adc WHERE query_id = 3",
        "partition_query": f"SELECT partition_index, vector_index, {_round('d')} AS squared_distance FROM adc WHERE query_id = 3 AND partition_index = 3 ORDER BY d, vector_index LIMIT {K}",
        "knn_query": _FOUND,
        "knn_batch": f"SELECT query_id, partition_index, vector_index, {_round('d')} AS squared_distance FROM found WHERE query_id < 20",
        "knn_search": _FOUND,
        "knn_table": f"SELECT query_id, partition_index, vector_index, {_round('d')} AS squared_distance FROM found",
        "kmeans_train_random": f"SELECT CAST({P} AS BIGINT) AS clusters, count(*) AS n, false AS moves FROM embeddings",
        "pq_train_random": f"SELECT CAST(t.d AS INTEGER) AS division, CAST({C} AS BIGINT) AS codes, count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM embeddings, range({D}) t(d) GROUP BY t.d",
        "index_build_random": f"SELECT CAST(t.r AS INTEGER) AS place, true AS agrees FROM range(1, {K + 1}) t(r)",
        "messages_roundtrip": f"SELECT p.vec_id, p.partition_index, p.vector_index, {D} AS divisions, l.number_value AS label, t.string_value AS lang FROM places p LEFT JOIN attrs l ON l.vec_id = p.vec_id AND l.name = 'label' LEFT JOIN attrs t ON t.vec_id = p.vec_id AND t.name = 'lang'",
        "knn_async": f"SELECT query_id - 3 AS query_id, partition_index, vector_index, {_round('d')} AS squared_distance FROM found WHERE query_id IN (3, 4)",
        "knn_exact": f"SELECT vec_id, {_round(_sqd('x', 'y'))} AS squared_distance FROM pairs ORDER BY {_sqd('x', 'y')}, vec_id LIMIT {K}",
        "n_best": f"SELECT vec_id, {_round('list_sum(vec)')} AS total FROM v ORDER BY total, vec_id LIMIT {K}",
        "attr_set_last_wins": "SELECT vec_id, name, string_value, number_value FROM attrs",
        "attr_get": "SELECT v.vec_id, number_value AS label FROM v LEFT JOIN attrs a ON a.vec_id = v.vec_id AND a.name = 'label'",
        "attr_missing_default": "SELECT v.vec_id, CAST(count(a.vec_id) AS INTEGER) AS n FROM v LEFT JOIN attrs a ON a.vec_id = v.vec_id GROUP BY v.vec_id",
        "attr_names_sorted": "SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS name_index, name FROM (SELECT DISTINCT name FROM attrs)",
        "attr_dictionary": "SELECT name, count(*) AS n FROM attrs GROUP BY name",
        "knn_with_attributes": "SELECT partition_index, vector_index, number_value AS label FROM found f LEFT JOIN attrs a ON a.vec_id = f.vec_id AND a.name = 'label' WHERE query_id = 3",
        "content_id": "SELECT doc_id, translate(rtrim(base64(unhex(sha256(text))), '='), '+/', '-_') AS content_id FROM documents",
        "index_roundtrip": f"SELECT partition_index, vector_index, {_round('d')} AS squared_distance, number_value AS label FROM found f LEFT JOIN attrs a ON a.vec_id = f.vec_id AND a.name = 'label' WHERE query_id = 3",
    }.items()
}
