"""Rounds of nearest centres over many rows (C1, C2), several sets of centres at once.

The vectors are packed once: evenly over the slots, a run of rows as one binary cell.  In a round a task compares its rows
with the broadcast centres and gives back a row for each centre it met (size, vector sum, sum of squared distances); those are
summed by centre, and the centres' rows reach the driver.  No vector leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint

#: Values of a packed cell, and of a table of distances, at most (or one row).
CELL_VALUES = 1 << 20
#: Up to here the sums of centres are one product of 0/1 rows, beyond it sums over sorted rows.
FEW_CENTRES = 64


def evenly(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all slots: a table of few files, or of few row groups, would be the work of few tasks."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def matrix(vectors: pa.Array) -> np.ndarray:
    """An Arrow list of vectors, without nulls, as rows; they must be of one length."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def pack(rows: DataFrame, vec_col: str, own_col: str | None = None) -> DataFrame:
    """(``own``, ``v``, ``d``): cells of rows' vectors (float64, ``d`` values each) and of the first centres they are (int32, -1:
    none), written once."""
    own = F.col(own_col).cast("int") if own_col else F.lit(-1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            step = max(1, CELL_VALUES // max(x.shape[1], 1))
            cells = [(own[a : a + step].astype(np.int32).tobytes(), x[a : a + step].tobytes()) for a in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary()),
                                              pa.array([x.shape[1]] * len(cells), pa.int32())], ["own", "v", "d"])

    return reliable_checkpoint(evenly(rows.select(own.alias("own"), F.col(vec_col).alias("v"))).mapInArrow(part, "own binary, v binary, d int"))


def nearest(x: np.ndarray, centres: np.ndarray, own: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with their nearest centres and the squared distances less the rows' own squares.  Ties go to the first
    centre; a row that is a first centre (``own`` >= 0) keeps to its own among equal ones."""
    sq, twice = (centres * centres).sum(1), -2.0 * centres.T
    step = max(1, CELL_VALUES // len(centres))
    for a in range(0, len(x), step):
        run = slice(a, min(a + step, len(x)))
        d = x[run] @ twice
        d += sq
        near, r = d.argmin(1), np.arange(run.stop - a)
        if own is not None and (own[run] >= 0).any():
            slack = 1e-12 * (sq[near] + (x[run] * x[run]).sum(1))
            near = np.where((own[run] >= 0) & (d[r, own[run]] <= d[r, near] + slack), own[run], near)
        yield run, near, d[r, near]


def sums_by_centre(packed: DataFrame, sets: list[np.ndarray], own: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres: the sizes and the vector sums of the rows nearest to each centre, and the sum of the squared
    distances.  ``own``: see ``nearest``."""
    starts = np.cumsum([0] + [len(c) for c in sets])
    bc = packed.sparkSession.sparkContext.broadcast(sets)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = bc.value
        size = [np.zeros(len(c), np.int64) for c in sets]
        total, cost = [np.zeros(c.shape) for c in sets], [np.zeros(len(c)) for c in sets]
        for batch in batches:
            for cell in batch.to_pylist():
                mine, x = np.frombuffer(cell["own"], np.int32), np.frombuffer(cell["v"]).reshape(-1, cell["d"])
                squares = (x * x).sum(1)
                for s, centres in enumerate(sets):
                    for run, near, d in nearest(x, centres, mine if own else None):
                        if len(centres) <= FEW_CENTRES:
                            total[s] += (near == np.arange(len(centres))[:, None]).astype(np.float64) @ x[run]
                        else:
                            order = np.argsort(near, kind="stable")
                            met, first = np.unique(near[order], return_index=True)
                            total[s][met] += np.add.reduceat(x[run][order], first, axis=0)
                        size[s] += np.bincount(near, minlength=len(centres))
                        cost[s] += np.bincount(near, np.maximum(d + squares[run], 0.0), len(centres))
        for s, n in enumerate(size):
            met = np.flatnonzero(n)
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array(starts[s] + met), pa.array(n[met]), pa.array(cost[s][met]), pa.array(list(total[s][met]), pa.list_(pa.float64()))],
                                                 ["c", "n", "cost", "s"])

    parts = packed.mapInArrow(part, "c long, n long, cost double, s array<double>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), Summarizer.sum(array_to_vector("s")).alias("s"))
    rows = rows.select("c", "n", "cost", vector_to_array("s").alias("s")).collect()  # a row for each centre
    bc.destroy()
    out = [(np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0) for c in sets]
    for r in sorted(rows, key=lambda r: r["c"]):
        s = int(np.searchsorted(starts, r["c"], "right")) - 1
        size, total, cost = out[s]
        size[r["c"] - starts[s]], total[r["c"] - starts[s]] = r["n"], r["s"]
        out[s] = size, total, cost + r["cost"]
    return out


def lloyd(packed: DataFrame, sets: list[np.ndarray], max_iter: int, tol: float) -> list[tuple[float, np.ndarray]]:
    """(cost, centres) of Lloyd's rounds from each set of first centres, all sets in the same jobs.  A set is done when no centre
    of it moves farther than ``tol``, or after ``max_iter`` rounds; the cost is that of its last round.  A centre without rows
    stays where it is."""
    done = [(0.0, c) for c in sets]
    left = list(range(len(sets)))
    for _ in range(max_iter):
        if not left:
            break
        moving = []
        for i, (size, total, cost) in zip(left, sums_by_centre(packed, [done[i][1] for i in left])):
            old = done[i][1]
            new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], old)
            done[i] = cost, new
            if (((new - old) ** 2).sum(1) > tol * tol).any():
                moving.append(i)
        left = moving
    return done
