"""Items packed into containers of one capacity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Lengths are counted in steps of so many tokens, rounded up.
GRAIN = 4
#: A combination has at most so many items.
DEPTH = 3
#: It may fall short of the capacity by so many steps: by none at first, by more for the items that are then left.
WINDOWS = (0, 2, 8)


@dataclass
class Plan:
    """Which items go together: rows of slots.

    Slot ``s`` takes ``count[s]`` items of ``bin[s]``, the first of them that of rank
    ``start[s]``; they go one each into the containers from ``container[s]`` on. Slots lie by bin and
    start, so that the ranks of a bin are covered once and without gaps.
    """

    bin: np.ndarray
    start: np.ndarray
    count: np.ndarray
    container: np.ndarray
    containers: int


def combinations(bins: np.ndarray, full: int, depth: int = DEPTH, window: int = WINDOWS[0]) -> np.ndarray:
    """Rising tuples of up to ``depth`` of the bins whose sum fills the last ``window`` steps of ``full``; unused places are 0."""
    have = np.zeros(full + 1, bool)
    have[bins[(bins > 0) & (bins <= full)]] = True
    sizes = np.flatnonzero(have)
    found: list[np.ndarray] = []
    partial = np.zeros((1, 0), np.int64)
    for d in range(1, depth + 1):
        sums, least = partial.sum(1), partial.max(1, initial=1)
        for short in range(window + 1):
            last = full - short - sums
            ok = (last >= least) & (last > 0)
            ok[ok] = have[last[ok]]
            rows = np.zeros((int(ok.sum()), depth), np.int64)
            rows[:, : d - 1], rows[:, d - 1] = partial[ok], last[ok]
            found.append(rows)
        if d < depth:
            wide = np.repeat(partial, len(sizes), axis=0)
            new = np.tile(sizes, len(partial))[:, None]
            wide = np.hstack([wide, new])
            ok = (wide[:, -1] >= np.repeat(least, len(sizes))) & (wide.sum(1) + wide[:, -1] <= full)
            partial = wide[ok]
    return np.concatenate(found)


def nnls(combos: np.ndarray, target: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """How often to use each combination, not less than never, so that the items used come nearest to ``target``.

    An active-set method: the combination that lowers the squared error fastest joins the set,
    and the least-squares solution of the set is cut back to where the first of it would fall
    below zero. The sets stay no larger than the number of bins.
    """
    n, m = len(combos), len(target)
    x = np.zeros(n)
    if not n:
        return x
    used = combos > 0
    index = np.where(used, combos, 0)
    dense = np.zeros((n, m + 1), np.float32)
    np.add.at(dense, (np.arange(n)[:, None], index), used.astype(np.float32))
    wanted = np.where(used, target[index], 0).sum(1).astype(float)
    active: list[int] = []
    # What the chosen combinations have in common, pair by pair; it grows and shrinks with them.
    gram = np.zeros((0, 0))
    scale = max(1.0, float(np.abs(target).max()))
    left = target.astype(float).copy()
    for _ in range(3 * m):
        slope = np.where(used, left[index], 0.0).sum(1)
        slope[active] = 0
        best = int(slope.argmax())
        if slope[best] <= tolerance * scale:
            break
        active.append(best)
        shared = (dense[active] @ dense[best]).astype(float)
        gram = np.block([[gram, shared[:-1, None]], [shared[None, :]]])
        while active:
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(active)), wanted[active])
            if z.min() > 0:
                x[active] = z
                break
            now = x[active]
            falls = z <= 0
            step = np.min(now[falls] / np.maximum(now[falls] - z[falls], 1e-12))
            now = now + step * (z - now)
            gone = (now <= 1e-9) & falls
            if not gone.any():
                gone = falls & (now == now[falls].min())
            x[active] = np.where(gone, 0.0, np.maximum(now, 0.0))
            active = [c for c, g in zip(active, gone.tolist(), strict=True) if not g]
            gram = gram[~gone][:, ~gone]
        left = target - (x[active] @ dense[active, :m] if active else 0.0)
    return x


def greedy(counts: np.ndarray, full: int) -> list[tuple[list[int], int]]:
    """Combinations for what is left, longest items first, each where the least room remains.

    Works on counts: equal containers are one group, so the work follows the number of bins.
    """
    open_groups: dict[int, list[tuple[list[int], int]]] = {}
    for size in range(full, 0, -1):
        todo = int(counts[size])
        while todo:
            room = min((r for r in open_groups if r >= size and open_groups[r]), default=None)
            if room is None:
                # One container takes as many of these items as fit, the last of them what is left.
                per = full // size
                whole, rest = divmod(todo, per)
                for k, n in ((per, whole), (rest, 1)):
                    if k and n:
                        open_groups.setdefault(full - k * size, []).append(([size] * k, n))
                todo = 0
                continue
            items, n = open_groups[room].pop()
            k = min(room // size, todo)
            take = min(n, todo // k)
            open_groups.setdefault(room - k * size, []).append((items + [size] * k, take))
            if n > take:
                open_groups[room].append((items, n - take))
            todo -= take * k
    return [g for groups in open_groups.values() for g in groups]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> Plan:
    """A plan for so many items of each bin; bin ``b`` holds lengths up to ``b`` steps of ``grain``.

    Non-negative least squares says how often each shallow combination that fills a window below the capacity
    is used; that is rounded, but never to more items than there are. The window is widened for what is left, and the last
    rest is packed greedily.
    """
    full = capacity // grain
    counts = np.zeros(full + 1, np.int64)
    for b, n in histogram.items():
        counts[b] = n
    chosen: list[tuple[list[int], int]] = []
    left = counts.copy()
    for window in WINDOWS:
        combos = combinations(np.flatnonzero(left), full, DEPTH, min(window, full - 1))
        times = nnls(combos, left)
        for c in np.argsort(-times, kind="stable").tolist():
            if times[c] < 0.5:
                break
            items = combos[c][combos[c] > 0]
            kinds, each = np.unique(items, return_counts=True)
            n = int(min(round(times[c]), (left[kinds] // each).min()))
            if n:
                left[kinds] -= n * each
                chosen.append((items.tolist(), n))
    chosen += greedy(left, full)
    slots, container = [], 0
    for items, n in chosen:
        slots += [(b, n, container) for b in items]
        container += n
    slots.sort(key=lambda s: s[0])
    b, n, c = (np.array([s[i] for s in slots], np.int64) for i in range(3))
    before = np.cumsum(n) - n
    start = before - before[np.searchsorted(b, b, side="left")] if len(b) else before
    return Plan(b, start, n, c, container)


def items_of(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, part, length``: each row of ``sizes`` as one item; only one larger than the capacity is split.

    It gives full items and one with what is left over. A NULL or negative size counts as 0.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    parts = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("int")
    return (
        sizes.select(F.col(key), n.alias("n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("part").cast("bigint") * capacity))
        .drop("n")
    )


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``key, part, length, container`` of each item.

    ``sizes`` is read three times, so it should be stored. The driver gets only the histogram of lengths,
    which has ``capacity / grain`` bins whatever the data, and makes the plan from it. Items then
    get ranks within their bin and find their container by rank. A bin that holds most items is
    no one task's: ranks are counted within slices of the bin, by the hash of the item, and moved up by the
    sizes of the slices before.

    Items of length 0 take no room and are spread over all containers; container 0 is there even
    if all items are such. Repeated and NULL keys are items like others. No item is lost or
    split that fits, and no container holds more than ``capacity``.
    """
    if capacity % grain:
        raise ValueError("the capacity must be a multiple of the grain")
    spark = sizes.sparkSession
    items = items_of(sizes.select(key, size), key, size, capacity).withColumn(
        "bin", F.ceil(F.col("length") / F.lit(grain)).cast("int")
    )
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = items.withColumn("slice", F.pmod(F.xxhash64(key, "part"), F.lit(slices)).cast("int"))
    per_slice = items.groupBy("bin", "slice").agg(F.count("*").alias("n"))
    histogram = {r["bin"]: r["n"] for r in per_slice.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan({b: n for b, n in histogram.items() if b > 0}, capacity, grain)

    before = per_slice.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("bin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("bin", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("bin", "slice").orderBy(key, "part")) - 1
    ranked = (
        items.withColumn("within", within)
        .join(before, ["bin", "slice"])
        .select(key, "part", "length", "bin", (F.col("before") + F.col("within")).alias("rank"))
    )
    schema = ranked.select(key, "part", "length", F.col("rank").alias("container")).schema
    # One number for bin and rank orders all slots, so that one search finds an item's slot.
    first = np.searchsorted(plan.bin, np.arange(capacity // grain + 1), side="left")
    total = np.concatenate([[0], np.cumsum(plan.count)])
    offset = total[first]

    def place(batches):
        for batch in batches:
            b = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            at = offset[b] + rank
            slot = np.maximum(np.searchsorted(total, at, side="right") - 1, 0)
            if plan.containers:
                slot = np.minimum(slot, len(plan.bin) - 1)
                container = np.where(b > 0, plan.container[slot] + at - total[slot], rank % plan.containers)
            else:
                container = np.zeros(len(b), np.int64)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(container, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(place, schema)
