"""Hard negatives by angular triangle filtering.

Every vector keeps its angle to the nearest of a few reference directions. For a query with angle a and a row
with angle b to the same direction, the angle between them lies in [|a - b|, min(a + b, 2 pi - a - b)], so its cosine
times both norms bounds the score on both sides; angles are widened by `SLACK` against rounding. Within the rows of one
direction, sorted by angle, the rows whose bounds reach a query's window of wanted scores are one run,
found by binary search; only these rows are scored, in exact integer products.

Two searches run over all rows, in waves of queries of a bounded size (`WAVE_BYTES`): the first finds the positives of
each query, the second, with score windows from these, its negatives. A task keeps per query (and positive) only
the best rows so far, whose last score narrows the window for what follows; Spark merges what the tasks
kept. Rows are range-partitioned by direction, angle and id: a direction or a vector that holds a third of all rows
is spread like any other. The directions come from `SAMPLE_ROWS` rows (those of smallest hashed id), which also give
every query a first floor of the score of its positives; the result does not depend on them.

Defined results. Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that share an
id the one of smallest label, then components, stays. Shorter vectors are filled with zeros; a vector of zeros
scores 0 with all. An empty table, or one without queries, gives no rows. Other columns are left out. Components so
large that exact products would not fit a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.storage import shared_path, stored
from surveyframe.llm.vectors import check_range, extent, floored, packed, unpacked, usable

SAMPLE_ROWS = 2048
DIRECTIONS = 32
#: Integers of the queries that one pass over the rows serves.
WAVE_BYTES = 8 << 20
#: Scores held at a time.
TILE = 1 << 20
SLACK = 1e-6
_NONE = np.iinfo(np.int64).min


def _unit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
    return values / np.where(norms > 0, norms, 1.0)[:, None], norms


def directions(sample: np.ndarray, n: int = DIRECTIONS, rounds: int = 8) -> np.ndarray:
    """Unit vectors around which the sample's vectors lie: farthest starts, then means of what is nearest."""
    unit, norms = _unit(sample)
    unit = unit[norms > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    closest = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
    refs = unit[chosen]
    for _ in range(rounds):
        of = (unit @ refs.T).argmax(axis=1)
        sums = np.zeros_like(refs)
        np.add.at(sums, of, unit)
        fresh, size = _unit(sums)
        refs = np.where((size > 1e-9)[:, None], fresh, refs)
    return refs


def angles(values: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(values)[0] @ refs.T, -1.0, 1.0))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Queries:
    """A wave of queries: ids, labels, integers, angles, and score windows, several per query."""

    def __init__(self, ids, labels, values, refs, low, high):
        self.ids, self.labels, self.values = ids, labels, values
        self.norms = _unit(values)[1]
        self.angles = angles(values, refs)
        self.low, self.high = low, high  # (query, window); a window with low > high wants nothing


class Best:
    """The best rows per query and window so far: highest score first, then smallest id."""

    def __init__(self, queries: Queries, keep: int):
        shape = (*queries.low.shape, keep)
        self.score = np.full(shape, _NONE, dtype=np.int64)
        self.row = np.full(shape, np.iinfo(np.int64).max, dtype=np.int64)
        self.high, self.low = queries.high, queries.low.copy()
        self.keep = keep

    def least(self) -> np.ndarray:
        """Score that a row needs at least, per query and window."""
        return np.maximum(self.low, self.score[:, :, -1])

    def offer(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Take rows that some window of their query wants."""
        for w in range(self.low.shape[1]):
            last, last_row = self.score[query, w, -1], self.row[query, w, -1]
            fit = (score >= self.low[query, w]) & (score <= self.high[query, w]) & ((score > last) | ((score == last) & (row < last_row)))
            if not fit.any():
                continue
            q, s, r = query[fit], score[fit], row[fit]
            touched = np.unique(q)
            q = np.concatenate([q, np.repeat(touched, self.keep)])
            s = np.concatenate([s, self.score[touched, w].ravel()])
            r = np.concatenate([r, self.row[touched, w].ravel()])
            order = np.lexsort((r, -s.astype(np.float64) if np.abs(s[s != _NONE]).max(initial=0) < 2**53 else ~s, q))
            q, s, r = q[order], s[order], r[order]
            first = np.searchsorted(q, touched)
            take = first[:, None] + np.arange(self.keep)[None, :]
            self.score[touched, w], self.row[touched, w] = s[take], r[take]


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.diff(keys)) + 1
    yield from zip(np.append(0, at), np.append(at, len(keys)))


def _window(q: Queries, pick: np.ndarray, ref: int, angle: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Per picked query the run [start, end) of rows, sorted by angle, whose bounds reach [least, most]."""
    lo, hi = float(norm.min()), float(norm.max())
    own, size = q.angles[pick, ref], q.norms[pick]
    with np.errstate(divide="ignore", invalid="ignore"):
        # score <= cos(|a - b|) |q| |x|: below the floor for every norm in [lo, hi] outside this distance
        floor = np.where(least > 0, least / (size * hi), least / (size * lo))
        reach = np.arccos(np.clip(np.nan_to_num(floor, nan=0.0, posinf=2.0, neginf=-2.0), -1.0, 1.0))
        none = floor > 1.0 + SLACK
        # score >= cos(a + b) |q| |x|: above the ceiling for every norm where a + b is small enough
        ceiling = np.where(most >= 0, most / (size * lo), most / (size * hi))
        short = np.arccos(np.clip(np.nan_to_num(ceiling, nan=1.0, posinf=2.0, neginf=-2.0), -1.0, 1.0))
    start = np.searchsorted(angle, np.maximum(own - reach, short - own) - SLACK, side="left")
    end = np.searchsorted(angle, np.minimum(own + reach, 2 * math.pi - short - own) + SLACK, side="right")
    zero = size == 0
    start, end = np.where(zero, 0, start), np.where(zero, len(angle), end)
    return start, np.where(none & ~zero, start, end)


def _search(
    rows: DataFrame, length: int, wave, keep: int, same_label: bool, schema: str
) -> DataFrame:
    """(query, window, row, score): what each task keeps of the rows that the wave's windows want."""

    def run(batches):
        q: Queries = wave.value
        best = Best(q, keep)
        order = np.argsort(q.labels, kind="stable")
        for batch in batches:
            ids, label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            ref, angle = batch.column("ref").to_numpy(), batch.column("angle").to_numpy()
            values, norm = unpacked(batch.column("v"), length), batch.column("norm").to_numpy()
            sort = np.lexsort((angle, ref, label)) if same_label else np.lexsort((angle, ref))
            ids, label, ref, angle, values, norm = (x[sort] for x in (ids, label, ref, angle, values, norm))
            key = ref if not same_label else label.astype(np.int64) * (DIRECTIONS + 1) + ref
            for a, b in _runs(key):
                pick = order
                if same_label:
                    s, e = np.searchsorted(q.labels[order], [label[a], label[a] + 1])
                    pick = order[s:e]
                need = best.least()
                wants = q.low <= q.high
                least = np.where(wants, need, np.iinfo(np.int64).max).min(axis=1)
                most = np.where(wants, q.high, _NONE).max(axis=1)
                pick = pick[(wants.any(axis=1) & (least <= most))[pick]]
                if not len(pick):
                    continue
                if ref[a] < 0:  # zeros: score 0, whatever the query
                    start, end = np.zeros(len(pick), np.int64), np.full(len(pick), b - a)
                else:
                    start, end = _window(q, pick, int(ref[a]), angle[a:b], norm[a:b], least[pick].astype(np.float64), most[pick].astype(np.float64))
                reached = start < end
                pick, start, end = pick[reached], start[reached], end[reached]
                step = max(1, TILE // (b - a))
                for t in range(0, len(pick), step):
                    some, s, e = pick[t : t + step], start[t : t + step], end[t : t + step]
                    x, y = int(s.min()), int(e.max())
                    scores = _exact(q.values[some], values[a + x : a + y])
                    hit = (scores >= least[some][:, None]) & (scores <= most[some][:, None])
                    i, j = np.nonzero(hit)
                    at = a + x + j
                    good = ids[at] != q.ids[some[i]]
                    if not same_label:
                        good &= label[at] != q.labels[some[i]]
                    i, at, j = i[good], at[good], j[good]
                    if len(i):
                        best.offer(some[i], scores[i, j], ids[at])
        i, w, k = np.nonzero(best.score != _NONE)
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.ids[i]), pa.array(w), pa.array(best.row[i, w, k]), pa.array(best.score[i, w, k])],
                names=["query", "window", "row", "score"],
            )

    return rows.mapInArrow(run, schema)


_FOUND = "query long, window long, row long, score long"


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _in_waves(
    rows: DataFrame, queries: DataFrame, n_waves: int, length: int, refs: np.ndarray,
    windows: Callable[[list], tuple[np.ndarray, np.ndarray]], keep: int, same_label: bool,
) -> DataFrame:
    """Best rows per query and window: one pass over `rows` per wave of `queries`."""
    spark = rows.sparkSession
    path = shared_path(spark, "found")
    spark.createDataFrame([], _FOUND + ", rank int").write.parquet(path)
    for wave in range(n_waves):
        own = queries.where(F.col("wave") == wave).collect()
        if not own:
            continue
        values = np.array([np.frombuffer(r["v"], dtype="<i4") for r in own], dtype=np.int64)
        low, high = windows(own, values)
        ids, labels = np.array([r["vec_id"] for r in own], dtype=np.int64), np.array([r["label"] for r in own], dtype=np.int64)
        shared = spark.sparkContext.broadcast(Queries(ids, labels, values, refs, low, high))
        _ranked(_search(rows, length, shared, keep, same_label, _FOUND), keep).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(_FOUND + ", rank int").parquet(path)


def prepare(vectors: DataFrame, scale: int, n_ranges: int | None = None) -> tuple[DataFrame, int, np.ndarray, np.ndarray, np.ndarray]:
    """Stored rows (vec_id, label, ref, angle, norm, v), the length, the directions, and the sample's labels and integers."""
    kept = usable(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("e")), "e")
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    one = kept.groupBy("vec_id").agg(F.min(F.struct("label", "e")).alias("r")).select("vec_id", "r.label", "r.e")
    length, top = extent(kept, "e")
    length = max(length, 1)
    check_range(top, scale, length)

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), packed(floored(batch.column("e"), scale, length))], names=["vec_id", "label", "v"]
            )

    rows = stored(one.mapInArrow(pack, "vec_id long, label long, v binary"))
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    sample = np.array([np.frombuffer(r["v"], dtype="<i4") for r in first], dtype=np.int64).reshape(len(first), length)
    refs = directions(sample)

    def place(batches):
        for batch in batches:
            values = unpacked(batch.column("v"), length)
            all_angles = angles(values, refs)
            ref = all_angles.argmin(axis=1)
            norm = _unit(values)[1]
            own = np.where(norm > 0, all_angles[np.arange(len(ref)), ref], 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("vec_id", "label")), pa.array(np.where(norm > 0, ref, -1).astype(np.int32)), pa.array(own), pa.array(norm), batch.column("v")],
                names=["vec_id", "label", "ref", "angle", "norm", "v"],
            )

    placed = rows.mapInArrow(place, "vec_id long, label long, ref int, angle double, norm double, v binary")
    keys = ["ref", "angle", "vec_id"]
    placed = (placed.repartitionByRange(n_ranges, *keys) if n_ranges else placed.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    return stored(placed), length, refs, np.array([r["label"] for r in first], dtype=np.int64), sample


def _dealt(queries: DataFrame, length: int, wave_bytes: int) -> tuple[DataFrame, int]:
    """Queries in waves of about `wave_bytes`, neighbours in one wave; and the number of waves."""
    n = queries.count()
    n_waves = max(1, math.ceil(n * length * 4 / wave_bytes))
    dealt = queries.repartitionByRange(n_waves, "ref", "angle", "vec_id").withColumn("wave", F.spark_partition_id())
    return stored(dealt), n_waves


def hard_negatives(
    vectors: DataFrame,
    is_query: Column,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 3,
    share: tuple[int, int] = (50, 95),
    wave_bytes: int = WAVE_BYTES,
    n_ranges: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Queries are the rows for which `is_query` (over vec_id) holds. The positives of a query are its best
    `n_positives` other rows of its label; the negatives of a positive are the best `n_negatives` rows of other
    labels whose score is between `share` hundredths of the positive's.
    """
    rows, length, refs, sample_labels, sample = prepare(vectors, scale, n_ranges)
    queries, n_waves = _dealt(rows.where(is_query), length, wave_bytes)

    def floor_of_positives(own, values):
        """From the sample: a query's n-th best row of its label there is no better than its n-th best of all."""
        low = np.full(len(own), -(1 << 62), dtype=np.int64)
        labels = np.array([r["label"] for r in own])
        for label in np.unique(labels):
            there, here = np.flatnonzero(sample_labels == label), np.flatnonzero(labels == label)
            if len(there) > n_positives:  # one of them may be the query itself
                for at in range(0, len(here), 1024):
                    some = here[at : at + 1024]
                    low[some] = np.sort(_exact(values[some], sample[there]), axis=1)[:, -(n_positives + 1)]
        return low[:, None], np.full((len(own), 1), 1 << 62, dtype=np.int64)

    positives = _in_waves(rows, queries, n_waves, length, refs, floor_of_positives, n_positives, True)
    windows = positives.groupBy(F.col("query").alias("q")).agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    asked = stored(queries.join(windows, F.col("vec_id") == F.col("q")).drop("q"))
    least, most = share

    def windows_of_negatives(own, values):
        low = np.ones((len(own), n_positives), dtype=np.int64)
        high = np.zeros_like(low)
        for i, r in enumerate(own):
            for p in r["p"]:
                low[i, p["rank"] - 1] = -((-least * p["score"]) // 100)
                high[i, p["rank"] - 1] = (most * p["score"]) // 100
        return low, high

    negatives = _in_waves(rows, asked, n_waves, length, refs, windows_of_negatives, n_negatives, False)
    of = positives.select(
        F.col("query").alias("anchor_id"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("w")
    )
    return of.join(negatives, (F.col("anchor_id") == F.col("query")) & (F.col("w") == F.col("window"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
