"""Recall of op4_nn_descent against brute force over all queries: python tests/llm/recall.py DIR [CPUS]."""

import sys
import time

import numpy as np
from pyspark.sql import SparkSession

from tidewire.llm import ann


def brute(ids: np.ndarray, vectors: np.ndarray, every: int, k: int) -> dict[int, list[float]]:
    """The k largest inner products of each query with all other rows, in blocks of queries."""
    asked = np.flatnonzero(ids % every == 0)
    out = {}
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        scores = vectors[part] @ vectors.T
        scores[np.arange(len(part)), part] = -np.inf
        best = -np.sort(-np.partition(scores, -k, axis=1)[:, -k:], axis=1)
        out |= {int(ids[q]): row.tolist() for q, row in zip(part, best, strict=True)}
    return out


def main(folder: str, cpus: str = "8") -> None:
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = ann.usable(table).toArrow()
    ids, vectors = rows.column("vec_id").to_numpy(), np.array(rows.column("e").to_pylist(), np.float64)
    began = time.time()
    found: dict[int, list[float]] = {}
    for r in ann.nearest(table).toArrow().to_pylist():
        found.setdefault(r["query_id"], []).append(r["score"])
    seconds = time.time() - began
    want = brute(ids, vectors, 20, ann.NEAREST)
    # A score as large as the last of the true list is as good: ties are any of their rows.
    hits = sum(sum(s >= best[-1] - 1e-9 for s in found.get(q, [])) for q, best in want.items())
    print(f"{len(ids)} vectors, {len(want)} queries: recall {hits / (ann.NEAREST * len(want)):.4f} in {seconds:.0f} s")


if __name__ == "__main__":
    main(*sys.argv[1:])
