"""Filling fixed-capacity containers with items, whole wherever they fit.

The configuration linear program: over all ways to fill a container, as few containers as cover the histogram of item
lengths. It is solved by multiplicative weights: a knapsack dynamic program prices the lengths by how little they are
covered yet and gives, for every length that is not covered, the dearest filling that holds it; those near the best are
taken, until every length is covered. The fractional solution is rounded down, what is left of the histogram is solved
again in the same way until nothing is left, and the loosest containers are opened and solved once more. A packing
longest first is made beside it as a measure, and taken only where it needs fewer containers; ``Plan`` says which. All
of this works on a histogram of at most ``capacity`` lengths, whatever the number of items; the items are then assigned
to the containers by their rank among items of equal length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 200_000
#: a length counts as covered but for this share
DONE = 1e-9
#: by what share of the best price a filling may fall short; the next is tried where the gap to the bound is over ``GAP``
NEAR, GAP = (0.5, 0.1, 0.03), 0.005
#: how often loose containers are opened again, and how many at first
TURNS, OPENED = 3, 100


def room_values(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room from 0 to ``capacity`` the largest total price that fits (unbounded knapsack; lengths ascending), and
    the index of a length to put there first, -1 where the room is better left smaller by one. Ties go to longer items."""
    low, top = int(lengths[0]), int(lengths[-1])
    falling = np.full(top + 1, -np.inf)  # price of length top, top - 1, ...
    falling[top - lengths] = prices
    index = np.zeros(top + 1, np.int32)
    index[lengths] = np.arange(len(lengths))
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int32)
    for c in range(low, capacity + 1):
        n = min(c, top)
        values = best[c - n:c - low + 1] + falling[top - n:top - low + 1]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], pick[c] = values[k], index[n - k]
        else:
            best[c] = best[c - 1]
    return best, pick


def fillings_with(lengths: np.ndarray, pick: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """One row for each index in ``first``: the dearest filling that holds this length, by the picks of ``room_values``."""
    rows = np.arange(len(first))
    used = np.zeros((len(first), len(lengths)), np.int64)
    used[rows, first] = 1
    room = capacity - lengths[first]
    filled = np.maximum.accumulate(np.where(pick >= 0, np.arange(len(pick)), 0))
    live = rows
    while live.size:
        room[live] = filled[room[live]]
        live = live[room[live] > 0]
        k = pick[room[live]]
        used[live, k] += 1
        room[live] -= lengths[k]
    return used


def _each_filling(lengths: np.ndarray, pick: np.ndarray, ask: np.ndarray, capacity: int, block: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(index, filling) for all of ``ask``, made a block at a time: a block takes 8 bytes a length and filling."""
    for at in range(0, len(ask), block):
        part = ask[at:at + block]
        yield from zip(part, fillings_with(lengths, pick, part, capacity))


@dataclass
class Program:
    """A fractional solution: ``columns`` in the order they came in, each (indexes, items of each, containers); ``value``
    containers in all, ``steps`` knapsack programs, no packing has fewer than ``bound`` containers."""

    columns: list[tuple[np.ndarray, np.ndarray, float]]
    value: float
    steps: int
    bound: float


def solve_program(lengths: np.ndarray, need: np.ndarray, capacity: int, step: float = 0.25, near: float = 0.1, rate: float = 1.0) -> Program:
    """Multiplicative weights until every length is covered.

    ``rate``: how fast the price of a length falls as it is covered; ``near``: a filling is taken while its price is at
    least this share below the best; ``step``: how much of the scarcest length one filling takes, one container at least."""
    covered = np.zeros(len(lengths))
    base, whole = lengths / capacity, need.astype(float)
    columns: dict[tuple[bytes, bytes], float] = {}
    steps, bound = 0, 0.0
    while (todo := np.flatnonzero(covered < 1 - DONE)).size:
        prices = base * np.exp(-rate * covered)
        best, pick = room_values(lengths, prices, capacity)
        steps += 1
        least = (1 - near) * best[capacity]
        bound = max(bound, float((need * prices).sum() / best[capacity]))
        worth = prices[todo] + best[capacity - lengths[todo]]
        ask = todo[worth >= least][::-1] if (worth >= least).any() else todo[[int(worth.argmax())]]
        missing = np.maximum(np.ceil(whole * (1 - covered) - DONE), 0).astype(np.int64)
        taken = False
        for i, used in _each_filling(lengths, pick, ask, capacity):
            if covered[i] >= 1 - DONE:
                continue
            used = np.minimum(used, missing)
            _fill_up(used, missing, lengths, capacity)
            on = np.flatnonzero(used)
            if not on.size:  # what is missing is below the precision
                covered[i], taken = 1.0, True
                continue
            n = used[on]
            if taken and (prices[on] * n).sum() < least:
                continue
            taken = True
            remains = whole[on] * (1 - covered[on])
            amount = min(max(step * float((whole[on] / n).min()), 1.0), float((remains / n).min()))
            key = (on.tobytes(), n.tobytes())
            columns[key] = columns.get(key, 0.0) + amount
            covered[on] += n * amount / whole[on]
            prices[on] = base[on] * np.exp(-rate * covered[on])
            missing[on] = np.maximum(np.ceil(whole[on] * (1 - covered[on]) - DONE), 0).astype(np.int64)
    made = [(np.frombuffer(on, np.int64), np.frombuffer(n, np.int64), x) for (on, n), x in columns.items()]
    return Program(made, sum(columns.values()), steps, bound)


def _fill_up(used: np.ndarray, missing: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
    """Puts further missing items into the room of a filling, longest first."""
    room = capacity - int((used * lengths).sum())
    if room < lengths[0]:
        return
    free = missing - used
    able = np.flatnonzero(free > 0)
    while (able := able[:np.searchsorted(lengths[able], room, "right")]).size:
        j = able[-1]
        n = min(int(free[j]), room // int(lengths[j]))
        used[j] += n
        room -= n * int(lengths[j])
        able = able[:-1]


Filling = tuple[int, dict[int, int]]


@dataclass
class Plan:
    """``fillings``: (containers, {length: items in each}); ``bound``: fewest containers any packing needs; ``value``: the
    program's fractional containers; ``columns`` and ``steps``: fillings it holds and knapsack programs it took;
    ``rounded``: containers of its rounding; ``greedy``: containers of a packing longest first; ``by``: whose it is."""

    capacity: int
    fillings: list[Filling]
    bound: int
    value: float = 0.0
    columns: int = 0
    steps: int = 0
    rounded: int = 0
    greedy: int = 0
    by: str = "program"

    @property
    def containers(self) -> int:
        return _count(self.fillings)


def _count(fillings: list[Filling]) -> int:
    return sum(k for k, _ in fillings)


def pack_histogram(histogram: dict[int, int], capacity: int) -> Plan:
    """A packing of ``histogram`` (length to number of items, lengths 1 to ``capacity``)."""
    histogram = {int(length): int(n) for length, n in histogram.items() if n > 0}
    if not histogram:
        return Plan(capacity, [], 0)
    if min(histogram) < 1 or max(histogram) > capacity:
        raise ValueError("lengths must be 1 to capacity")
    fillings, first, steps = _by_program(histogram, capacity)
    bound = max(-(-sum(length * n for length, n in histogram.items()) // capacity), math.ceil(first.bound - 1e-6))
    for turn in range(TURNS):
        if _count(fillings) <= bound:
            break
        fillings, more = _opened(fillings, capacity, turn)
        steps += more
    rounded, plain = _count(fillings), _longest_first(histogram, capacity)
    best, by = (fillings, "program") if rounded <= _count(plain) else (plain, "longest first")
    return Plan(capacity, best, bound, first.value, len(first.columns), steps, rounded, _count(plain), by)


def _closed(lengths: np.ndarray, need: np.ndarray, capacity: int, nears: tuple[float, ...]) -> Program:
    """The program, solved ever more closely until its gap to the bound is proven to be small; of all tries the best."""
    best, steps, bound = None, 0, 0.0
    for near in nears:
        program = solve_program(lengths, need, capacity, near=near)
        steps, bound = steps + program.steps, max(bound, program.bound)
        best = program if best is None or program.value < best.value else best
        if best.value <= bound * (1 + GAP) + 1:
            break
    return Program(best.columns, best.value, steps, bound)


def _by_program(histogram: dict[int, int], capacity: int, nears: tuple[float, ...] = NEAR) -> tuple[list[Filling], Program, int]:
    """The program, rounded down and solved again for what is left until nothing is: fillings, the first program, steps."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    fillings: list[Filling] = []
    first, steps = None, 0
    while (open_ := np.flatnonzero(left)).size:  # the first column of a program is always placed
        program = _closed(lengths[open_], left[open_], capacity, nears)
        first, steps = first or program, steps + program.steps
        for on, n, amount in program.columns:
            at = open_[on]
            k = min(int(amount + DONE), int((left[at] // n).min()))
            if k > 0:
                left[at] -= k * n
                fillings.append((k, {int(lengths[i]): int(c) for i, c in zip(at, n)}))
    return fillings, first, steps


def _opened(fillings: list[Filling], capacity: int, turn: int) -> tuple[list[Filling], int]:
    """The loosest containers opened and solved again, more of them and more closely at every turn; kept if fewer."""
    loose = sorted(fillings, key=lambda f: sum(length * n for length, n in f[1].items()))
    much, opened = 0, 0
    pool: dict[int, int] = {}
    while opened < len(loose) and much < OPENED << turn:
        k, used = loose[opened]
        for length, n in used.items():
            pool[length] = pool.get(length, 0) + k * n
        much, opened = much + k, opened + 1
    again, _, steps = _by_program(pool, capacity, NEAR[turn:])
    return (again + loose[opened:] if _count(again) < much else fillings), steps


def _longest_first(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """Each filling takes the longest items that fit and is repeated as often as its lengths last."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(x)] for x in lengths], np.int64)
    fillings: list[Filling] = []
    while left.any():  # each turn uses up at least one length
        used = np.zeros(len(lengths), np.int64)
        _fill_up(used, left, lengths, capacity)
        on = np.flatnonzero(used)
        k = int((left[on] // used[on]).min())
        left[on] -= k * used[on]
        fillings.append((k, {int(lengths[i]): int(used[i]) for i in on}))
    return fillings


def _places(plan: Plan) -> tuple[np.ndarray, ...]:
    """Where the ranks of each length go: sorted by length and first rank; (length, first rank, container, items in each)."""
    rows, base, rank = [], 0, {}
    for k, used in plan.fillings:
        for length, n in used.items():
            rows.append((length, rank.get(length, 0), base, n))
            rank[length] = rank.get(length, 0) + k * n
        base += k
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pieces_of(sized: DataFrame, ident: str, size: str, capacity: int) -> DataFrame:
    """(ident, piece, start, length): an item within the capacity is one piece; a larger one is cut at multiples of it."""
    n = F.col(size)
    cuts = F.when(n > capacity, F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    return sized.filter(n > 0).select(ident, size, F.explode(cuts).alias("piece")).select(
        ident, "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), n - F.col("piece").cast("bigint") * capacity).cast("bigint").alias("length"))


def pack(sized: DataFrame, ident: str, size: str, capacity: int) -> tuple[DataFrame, Plan]:
    """(ident, piece, start, length, container) of every piece, and the plan.

    Items of size 0 (or null) take no space: they are in container 0, piece 0. Null identifiers are items like others.
    No container holds more than ``capacity``; only larger items are cut. An empty table gives no rows. Rows that
    repeat an identifier are items of their own."""
    sized = sized.select(ident, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias(size))
    pieces = pieces_of(sized, ident, size, capacity)
    # at most `capacity` rows
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = pack_histogram(histogram, capacity)
    at_length, at_rank, base, each = _places(plan)
    buckets = max(1, -(-sum(histogram.values()) // ROWS_A_BUCKET))
    # rank among equal lengths: by bucket, then within it, so that a common length is no single task
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64(ident, "piece"), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(ident, "piece")) - 1
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))

    @F.pandas_udf("bigint")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        length, rank = length.to_numpy(), rank.to_numpy()
        lo = np.searchsorted(at_length, length, "left")
        span = int(at_rank.max()) + 1
        i = np.searchsorted(at_length * span + at_rank, length * span + np.minimum(rank, span - 1), "right") - 1
        i = np.maximum(i, lo)
        return pd.Series(base[i] + (rank - at_rank[i]) // each[i])

    placed = ranked.select(ident, "piece", "start", "length", container("length", "rank").alias("container"))
    empty = sized.filter(F.col(size) <= 0).select(ident, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(empty), plan
