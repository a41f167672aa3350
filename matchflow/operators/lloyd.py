"""k-means of many models at once: every k and restart moves its centres in the same pass over the rows.

Rows are packed once into kept blocks of numbers. A pass compares each block with the centres of all models still moving, and adds up by a tree, per (model,
cluster), the number of rows, their sum, their squared norms and distances. So an iteration is one short job whatever the number of models, and what reaches the
driver is as large as the centres. Models are worked through in groups of at most ``CENTRE_NUMBERS`` numbers, which bounds what tasks are sent.

Starts are drawn by k-means++, either from at most ``SEED_ROWS`` rows (``start``: those with the smallest hashes, so the same on every run) or from all rows
(``starts``: one pass a centre, for all models at once); all rows take part in every pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_ROWS = 4096
CENTRE_NUMBERS = 4 << 20
BATCH_ROWS = 2048


@dataclass
class Fitted:
    """A model's centres and, from a pass over all rows with them: rows, mean and mean squared norm of each cluster, and the cost."""

    centres: np.ndarray
    sizes: np.ndarray
    means: np.ndarray
    norms: np.ndarray
    cost: float


def sample_rows(rows: DataFrame, vector: str, limit: int = SEED_ROWS) -> np.ndarray:
    got = rows.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64("v")).limit(limit).collect()
    return np.array([r["v"] for r in got], float)


def start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centre is drawn with the square of the distance to those drawn."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), rng.random() * total, side="right")) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(min(at, len(sample) - 1))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def blocks_of(rows: DataFrame, vector: str) -> RDD:
    """The rows as kept blocks of numbers, dealt as the rows are; to be unpersisted by the caller."""
    def pack(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                column = whole.column(0).slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([len(column)], pa.int32()), pa.array([column.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["n", "v"])

    packed = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(pack, "n int, v binary").rdd
    return packed.map(lambda r: np.frombuffer(r["v"]).reshape(r["n"], -1)).persist(StorageLevel.MEMORY_AND_DISK)


def starts(blocks: RDD, k: int, seeds: list[int]) -> list[np.ndarray]:
    """k-means++ over all rows, a model for each seed: a pass draws the next centre of every model. The row with the smallest
    -ln(u) / squared distance is drawn, u following from the row's numbers and the seed, so a draw does not depend on how rows are dealt; equal
    rows count once. A model gets fewer than k centres when no row lies apart from those drawn."""
    models: dict[int, list] = {m: [] for m in range(len(seeds))}
    growing = list(models)
    while growing and len(models[growing[0]]) < k:
        found = blocks.mapPartitions(_draws({m: np.array(models[m]) for m in growing}, seeds)).treeReduce(
            lambda a, b: {m: min(x for x in (a.get(m), b.get(m)) if x) for m in a.keys() | b.keys()})
        for m, (_, v) in found.items():
            models[m].append(v)
        growing = sorted(found)
    return [np.array(c, float) for c in models.values()]


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number between 0 and 1 for each row, from its numbers and the seed."""
    odd = np.random.default_rng(seed).integers(1, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = ((np.ascontiguousarray(x) + 0.0).view(np.uint64) * odd).sum(1, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _draws(models: dict[int, np.ndarray], seeds: list[int]):
    def run(blocks):
        best = {}
        for x in blocks:
            for m, centres in models.items():
                near = np.min([((x - c) ** 2).sum(1) for c in centres], 0) if len(centres) else np.ones(len(x))
                apart = np.flatnonzero(near > 0)
                if len(apart):
                    race = -np.log1p(-_uniform(x[apart], seeds[m] * 1_000_003 + len(centres))) / near[apart]
                    i = int(race.argmin())
                    best[m] = min(best.get(m, (np.inf, ())), (float(race[i]), tuple(x[apart[i]].tolist())))
        yield best
    return run


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            column = whole.column(0).slice(at, BATCH_ROWS)
            yield column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _labels(x: np.ndarray, centres: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nearest centre, the smallest number on a tie; squared distance) of each row, model by model."""
    stacked = np.concatenate(centres)
    far = (x ** 2).sum(1)[:, None] - 2 * x @ stacked.T + (stacked ** 2).sum(1)
    lo = 0
    for c in centres:
        mine = far[:, lo:lo + len(c)]
        label = mine.argmin(1)
        yield label, np.maximum(mine[np.arange(len(x)), label], 0)
        lo += len(c)


def _moved(centres: list[np.ndarray]):
    def run(blocks):
        n, cost, norm = ([np.zeros(len(c)) for c in centres] for _ in range(3))
        sums = [np.zeros(c.shape) for c in centres]
        for x in blocks:
            length = (x ** 2).sum(1)
            for m, (label, far) in enumerate(_labels(x, centres)):
                k = len(centres[m])
                n[m] += np.bincount(label, minlength=k)
                cost[m] += np.bincount(label, far, k)
                norm[m] += np.bincount(label, length, k)
                sums[m] += (label == np.arange(k)[:, None]).astype(float) @ x
        yield [np.concatenate(a) for a in (n, cost, norm, sums)]
    return run


def _pass(blocks: RDD, models: dict[int, np.ndarray]) -> dict[int, Fitted]:
    """One pass over all rows with the centres of all models."""
    n, cost, norm, sums = blocks.mapPartitions(_moved(list(models.values()))).treeReduce(lambda a, b: [x + y for x, y in zip(a, b)])
    out, lo = {}, 0
    for m, c in models.items():
        mine = slice(lo, lo := lo + len(c))
        many = np.maximum(n[mine], 1)
        means = np.where(n[mine, None] > 0, sums[mine] / many[:, None], c)
        out[m] = Fitted(c, n[mine].astype(np.int64), means, norm[mine] / many, float(cost[mine].sum()))
    return out


def fit_many(rows: DataFrame, vector: str, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[Fitted]:
    """All models from their starts to where no centre moves by more than ``tol``. A cluster that loses its rows keeps its centre."""
    blocks = blocks_of(rows, vector)
    fits = fit_blocks(blocks, starts, max_iter, tol)
    blocks.unpersist()
    return fits


def fit_blocks(blocks: RDD, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[Fitted]:
    """``fit_many`` on kept blocks, which are read once an iteration."""
    done: dict[int, Fitted] = {}
    group: dict[int, np.ndarray] = {}
    for number, first in enumerate(starts):
        group[number] = np.asarray(first, float)
        if number + 1 < len(starts) and sum(c.size for c in group.values()) + starts[number + 1].size <= CENTRE_NUMBERS:
            continue
        moving, still = dict(group), {}
        for _ in range(max_iter):
            passed = _pass(blocks, moving)
            for m, f in passed.items():
                if ((f.means - f.centres) ** 2).sum(1).max() <= tol * tol:
                    still[m] = f.means
            moving = {m: f.means for m, f in passed.items() if m not in still}
            if not moving:
                break
        done.update(_pass(blocks, {**still, **moving}))
        group = {}
    return [done[m] for m in range(len(starts))]


def silhouettes(rows: DataFrame, vector: str, models: list[Fitted]) -> list[float | None]:
    """Mean silhouette of each model (squared Euclidean distance, from size, mean and mean squared norm of the clusters), in one pass; None with
    fewer than two clusters in use."""
    dims = models[0].centres.shape[1]

    def run(batches):
        total, many = np.zeros(len(models)), 0
        for x in _batches(batches, dims):
            many += len(x)
            length = (x ** 2).sum(1)
            for m, (label, _) in enumerate(_labels(x, [f.centres for f in models])):
                f = models[m]
                used = np.flatnonzero(f.sizes)
                if len(used) < 2:
                    continue
                mean = np.full((len(x), len(f.sizes)), np.inf)
                mean[:, used] = np.maximum(length[:, None] - 2 * x @ f.means[used].T + f.norms[used], 0)
                at, own = np.arange(len(x)), f.sizes[label]
                a = mean[at, label] * own / np.maximum(own - 1, 1)
                mean[at, label] = np.inf
                b = mean.min(1)
                top = np.maximum(a, b)
                total[m] += np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(total), pa.array([many] * len(models), pa.int64())],
                                         ["model", "total", "n"])

    got = rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "model int, total double, n long").groupBy("model").agg(
        (F.sum("total") / F.sum("n")).alias("mean")).collect()
    mean = {r["model"]: r["mean"] for r in got}
    return [mean.get(m) if np.count_nonzero(f.sizes) > 1 else None for m, f in enumerate(models)]
