"""Mixing sources to target weights, as a min-cost flow over membership patterns.

Equal texts that several sources hold are one record with several memberships. Records are aggregated by the set of
sources they belong to; the flow sends the tokens of each pattern to the quotas of its sources, where the second use of
a record costs more than the first, the third more than the second, and so on. The network has a node for each pattern
and source and is solved on the driver; the records are then chosen along a seeded order by their running total of
tokens, which is found with mergeable bucket sums.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import Scratch

ROWS_A_BUCKET = 100_000
#: so many routes at most are broadcast; beyond that Spark picks the join
FEW_ROUTES = 100_000


class MinCostFlow:
    """Successive shortest paths; integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, arc: int) -> int:
        return self.room[arc + 1]

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via = [math.inf] * len(self.out), [-1] * len(self.out)
            dist[s] = 0
            queue, queued = deque([s]), {s}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and dist[x] + self.cost[e] < dist[y]:
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if via[t] < 0:
                return total
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            total += amount


@dataclass
class Mix:
    """``total`` tokens aimed at; ``routes``: tokens sent from a membership pattern (a bit mask) to a source."""

    total: int
    routes: dict[tuple[int, int], int]


def _route(tokens: dict[int, int], shares: list[float], repeats: list[int], total: int) -> tuple[int, dict[tuple[int, int], int]]:
    patterns = sorted(tokens)
    n, m = len(patterns), len(shares)
    net = MinCostFlow(n + m + 2)
    s, t = n + m, n + m + 1
    arcs = {}
    for i, mask in enumerate(patterns):
        own = [k for k in range(m) if mask >> k & 1]
        for use in range(min(repeats[k] for k in own)):
            net.arc(s, i, tokens[mask], use)
        for k in own:
            arcs[mask, k] = net.arc(i, n + k, tokens[mask] * repeats[k])
    for k, share in enumerate(shares):
        net.arc(n + k, t, int(share * total))
    sent = net.run(s, t)
    return sent, {key: net.sent(a) for key, a in arcs.items() if net.sent(a) > 0}


def plan_mix(tokens: dict[int, int], shares: list[float], repeats: list[int], total: int | None = None) -> Mix:
    """Routes for ``total`` tokens, by default the largest total at which every source that has records at all reaches
    its share. Sources without records get nothing; a total too large for some leaves their quotas partly unfilled."""
    has = [any(mask >> k & 1 and n > 0 for mask, n in tokens.items()) and shares[k] > 0 and repeats[k] > 0 for k in range(len(shares))]
    tokens = {mask: n for mask, n in tokens.items() if mask and n > 0}
    shares = [x if ok else 0.0 for x, ok in zip(shares, has)]
    if not tokens or not any(has):
        return Mix(0, {})
    if total is None:
        lo, hi = 0, sum(n for n in tokens.values()) * max(repeats) + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            sent, _ = _route(tokens, shares, repeats, mid)
            lo, hi = (mid, hi) if sent >= sum(int(x * mid) for x in shares) else (lo, mid)
        total = lo
    return Mix(total, _route(tokens, shares, repeats, total)[1])


def mix(records: DataFrame, ident: str, text: str, source: str, size: str, targets: list[tuple[str, float, int]], seed: int = 7, total: int | None = None,
        scratch: Scratch | None = None) -> tuple[DataFrame, Mix]:
    """(ident, source, repeats, size): the chosen records, the source each counts for and how often it is used.

    ``targets`` is (source, share, most repeats); a record is used at most as often as the strictest of its sources
    allows, over all sources together. Equal texts are one record, the one with the smallest ``ident``. Records whose
    sources have no target, with null source or ``ident``, or of size 0 are not used. The choice depends on the seed
    and the texts only, never on row order. Shares are met but for one record at each border of a route.
    """
    targets = sorted(targets)
    names = [t[0] for t in targets]
    spark = records.sparkSession
    place = F.coalesce(*[F.when(F.col(source) == s, F.lit(k)) for k, s in enumerate(names)]) if names else F.lit(None).cast("int")
    held = records.select(F.col(ident).alias("ident"), F.col(size).cast("bigint").alias("n"), place.alias("k"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), text).alias("k2"))
    held = held.filter("ident is not null and n > 0 and k is not null")
    # texts become two hashes; a record is written without its text, and read three times
    single = held.groupBy("k1", "k2").agg(F.min("ident").alias("ident"), F.max("n").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("k")), lambda k: k.cast("string"))).alias("pattern"))
    single = (scratch or Scratch(spark)).write(single.withColumn("h", F.xxhash64(F.lit(seed), "k1", "k2")))
    # one row a membership pattern that occurs
    sums = single.groupBy("pattern").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("records")).collect()
    mask_of = {r["pattern"]: sum(1 << int(k) for k in r["pattern"].split(",")) for r in sums}
    pattern_of = {m: p for p, m in mask_of.items()}
    tokens = {mask_of[r["pattern"]]: int(r["tokens"]) for r in sums}
    plan = plan_mix(tokens, [t[1] for t in targets], [t[2] for t in targets], total)
    schema = f"{ident} {records.schema[ident].dataType.simpleString()}, source string, repeats int, {size} bigint"
    rows, used = [], {}
    for (mask, k), amount in sorted(plan.routes.items()):
        lo = used.get(mask, 0)
        rows.append((pattern_of[mask], lo, lo + amount, names[k]))
        used[mask] = lo + amount
    if not rows:
        return spark.createDataFrame([], schema), plan
    routes = spark.createDataFrame(rows, "pattern string, lo bigint, hi bigint, source string")
    axes = spark.createDataFrame([(pattern_of[m], tokens[m], u) for m, u in used.items()], "pattern string, round bigint, used bigint")
    if len(rows) <= FEW_ROUTES:
        routes, axes = F.broadcast(routes), F.broadcast(axes)
    bits = max(0, math.ceil(math.log2(max(1, sum(int(r["records"]) for r in sums) / ROWS_A_BUCKET))))
    cut = single.withColumn("bucket", F.shiftright("h", 63 - bits) if bits else F.lit(0).cast("bigint"))
    before = cut.groupBy("pattern", "bucket").agg(F.sum("n").alias("s")).select(
        "pattern", "bucket", (F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("pattern", "bucket").orderBy("h", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = cut.withColumn("inside", inside).join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.col("inside")).join(axes, "pattern")
    # the n-th use of a record lies one round of its pattern's tokens further on
    uses = placed.filter("at < used").withColumn("use", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("used") - 1 - F.col("at")) / F.col("round")))))
    spot = F.col("at") + F.col("use") * F.col("round")
    chosen = uses.withColumn("spot", spot).join(routes, "pattern").filter("spot >= lo and spot < hi")
    return chosen.groupBy("ident", "source", "n").agg(F.count(F.lit(1)).cast("int").alias("repeats")).select(
        F.col("ident").alias(ident), "source", "repeats", F.col("n").alias(size)), plan
