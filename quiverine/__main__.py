"""Programs of the engine: build, ask and save a demo index; load one and ask it twice, or asynchronously; benchmarks."""

from __future__ import annotations

import argparse
import json
import time

import numpy as np

from quiverine.operators.events import Event
from quiverine.operators.index import IndexBuilder
from quiverine.plans import benchmarks
from quiverine.session import local_session, ship
from quiverine.sources import storage


def unit_vector(width: int, seed: int) -> np.ndarray:
    row = np.random.default_rng(seed).normal(size=width)
    return row / np.linalg.norm(row)


def timed(what: str, began: float) -> None:
    print(f"{what}: {time.perf_counter() - began:.6f} s")


def show(index, found, names) -> None:
    for n, r in enumerate(found):
        values = {name: index.get_attribute(r.vector_id, name, r.partition_index) for name in names}
        print(f"{n}: {r.vector_id} partition {r.partition_index} distance {r.squared_distance:.6f} {values}")


def generate(spark, args: argparse.Namespace) -> None:
    df = benchmarks.random_vectors(spark, args.vectors, args.size, args.seed, unit=True)
    builder = IndexBuilder(args.partitions, args.divisions, args.clusters, seed=args.seed)
    began = time.perf_counter()
    index = builder.build(df, listener=lambda e: print(" ", e.name, e.detail) if e.name != "cluster" else None)
    timed("build", began)
    for k in range(0, args.vectors, 2):
        index = index.set_attribute_at(k, "datum_id", f"datum-{k}")
    began = time.perf_counter()
    found = index.search(unit_vector(args.size, args.seed + 1), args.k, args.nprobe, listener=lambda e: print(" ", e.name, e.detail))
    timed("query", began)
    show(index, found, ["datum_id"])
    began = time.perf_counter()
    print("saved as", storage.save(index, args.folder))
    timed("save", began)


def load(spark, args: argparse.Namespace) -> None:
    began = time.perf_counter()
    index = storage.load(spark, args.folder)
    timed("load", began)
    vector = unit_vector(index.vector_size, args.seed + 1)
    for number in range(2):
        began = time.perf_counter()
        found = index.search(vector, args.k, args.nprobe)
        timed(f"query {number}", began)
        began = time.perf_counter()
        show(index, found, index.names())
        timed(f"attributes {number}", began)


def load_async(spark, args: argparse.Namespace) -> None:
    began = time.perf_counter()
    index = storage.load_async(spark, args.folder).result()
    timed("load", began)
    asked = time.perf_counter()

    def heard(event: Event) -> None:
        timed(f"  {event.name} {event.detail}", asked)

    found = index.query_async(unit_vector(index.vector_size, args.seed + 1), args.k, args.nprobe, heard).result()
    timed("query", asked)
    began = time.perf_counter()
    values = [(name, [index.get_attribute_async(r.vector_id, name, r.partition_index) for r in found]) for name in index.names()]
    for n, r in enumerate(found):
        print(f"{n}: {r.vector_id} partition {r.partition_index} distance {r.squared_distance:.6f} { {name: own[n].result() for name, own in values} }")
    timed("attributes", began)


def published(spark, args: argparse.Namespace) -> None:
    print(json.dumps(benchmarks.published(spark)))


def kernels(spark, args: argparse.Namespace) -> None:
    for name, seconds in benchmarks.kernels(spark).items():
        print(name, *seconds)


VERBS = {"generate": generate, "load": load, "load-async": load_async, "published": published, "kernels": kernels}


def main(argv: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="quiverine")
    parser.add_argument("verb", choices=list(VERBS))
    parser.add_argument("folder", nargs="?")
    for name, value in (("vectors", 5000), ("size", 1024), ("partitions", 10), ("divisions", 8), ("clusters", 25), ("k", 10), ("nprobe", 3), ("seed", 0)):
        parser.add_argument(f"--{name}", type=int, default=value)
    args = parser.parse_args(argv)
    if args.verb in ("generate", "load", "load-async") and not args.folder:
        parser.error("name a folder")
    own = spark or local_session(memory="8g")
    own.sparkContext.setLogLevel("ERROR")
    ship(own)
    VERBS[args.verb](own, args)
    if spark is None:
        own.stop()


if __name__ == "__main__":
    main()
