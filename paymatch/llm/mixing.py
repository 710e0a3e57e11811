"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them). Words flow from patterns to the quotas of their sources; each further
use of a pattern costs more than the one before (convex), so the cheapest flow
repeats as little as the quotas allow. A pattern's flow becomes whole uses of
all its documents, and one use more for those first in a seeded hash order, up
to a cut found by histograms. Only sums per source and pattern reach the driver
(as many as the source catalogue has, whatever the number of documents).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.llm.histogram import KEY, find_cuts
from paymatch.llm.store import drop, save

WEIGHTS = (5, 2, 1)
#: Cost of the first, second and third use of a document; there is no fourth.
USE_COSTS = (0, 1, 3)
SEED = 20240229


def words_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS,
           most: float = len(USE_COSTS)) -> dict[str | None, float]:
    """Targets by source: all words shared by weight (sources in code point order, null
    last, weights in turn), none above ``most`` times its size; what is over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def cheapest_flow(patterns: dict[str, tuple[int, list[int]]], demand: list[int]) -> dict[str, list[tuple[int, int]]]:
    """Words from each pattern (capacity a use, its sources) to each source's demand.

    Successive shortest paths on the graph start - pattern (one arc a use) -
    source - end. Returns (source, words) by pattern; demand that no pattern
    can serve stays unmet.
    """
    names = sorted(patterns)
    start, end = 0, 1 + len(names) + len(demand)
    arcs: list[list[int]] = [[] for _ in range(end + 1)]
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(head))
            head.append(y)
            room.append(c)
            cost.append(p)

    whole = sum(demand) + 1
    for i, name in enumerate(names):
        for price in USE_COSTS:
            arc(start, 1 + i, patterns[name][0], price)
        for s in patterns[name][1]:
            arc(1 + i, 1 + len(names) + s, whole, 0)
    for s, d in enumerate(demand):
        arc(1 + len(names) + s, end, d, 0)
    while True:
        distance: list[float] = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        distance[start] = 0
        queue, queued = deque([start]), [False] * (end + 1)
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in arcs[x]:
                y = head[e]
                if room[e] and distance[x] + cost[e] < distance[y]:
                    distance[y], via[y] = distance[x] + cost[e], e
                    if not queued[y]:
                        queue.append(y)
                        queued[y] = True
        if via[end] < 0:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = head[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    sources = range(1 + len(names), end)
    return {name: [(head[e] - 1 - len(names), room[e ^ 1]) for e in arcs[1 + i]
                   if head[e] in sources and room[e ^ 1]] for i, name in enumerate(names)}


def mix(docs: DataFrame, members: Column, weights: Sequence[float] = WEIGHTS, seed: int = SEED,
        keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, else all) with ``size`` (words), ``uses``
    (how often the mix takes the row, 0 to 3) and ``pattern``.

    ``members``: array of the names of all sources that hold the row; a null
    name is a source of its own, a null or empty array is in none and is not
    taken. The size of a source counts all rows that it holds. Rows are chosen
    by a seeded hash of doc_id and text, so reruns agree; repeated rows are
    chosen together. Null texts have no words. Columns of ``docs`` with these
    names are replaced. No rows give no rows.
    """
    text = F.col("text").cast("string")
    base = docs.drop("size", "uses", "pattern")
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))),
                        {"ignoreNullFields": "false"})
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 1).cast(KEY)
    # the rows travel as one column, so no name of theirs can clash
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or base.columns) if c in base.columns]).alias("row")
    rows = base.select(row, words_of(text).alias("size"), pattern.alias("pattern"), chance.alias("_chance"),
                       members.alias("_members"))
    narrow = save(rows.select(F.col("pattern").alias("group"), F.col("_chance").alias("key"),
                              F.col("size").alias("weight"), "_members"), "mix-sizes")
    # one row per pattern: bounded by the source catalogue
    found = narrow.groupBy("group").agg(F.sum("weight").alias("words"), F.first("_members").alias("members")).collect()
    uses, cuts = _plan(found, narrow, weights)
    drop(narrow)
    planned = docs.sparkSession.createDataFrame(
        [(p, n, str(cuts[p][0]) if p in cuts else "0") for p, n in uses.items()], "p string, whole int, cut string")
    chosen = rows.join(F.broadcast(planned), F.col("pattern") == F.col("p"), "left")
    more = F.when(F.col("_chance") < F.col("cut").cast(KEY), 1).otherwise(0)
    uses = F.coalesce(F.col("whole") + more, F.lit(0)).alias("uses")
    return chosen.select("row.*", "size", "pattern", uses)


def _plan(found: list, narrow: DataFrame, weights: Sequence[float]) -> tuple[dict[str, int], dict[str, list[int]]]:
    """Whole uses of each pattern, and the cut below which its documents get one more."""
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in set(r.members or ()):
            sizes[s] = sizes.get(s, 0) + r.words
    target = quotas(sizes, weights)
    order = list(target)
    place = {s: i for i, s in enumerate(order)}
    patterns = {r.group: (r.words, sorted(place[s] for s in set(r.members))) for r in found if r.members}
    flow = cheapest_flow(patterns, [round(target[s]) for s in order])
    uses, rest = {}, {}
    for p, parts in flow.items():
        words, capacity = sum(w for _, w in parts), patterns[p][0]
        uses[p], over = divmod(words, capacity) if capacity else (0, 0)
        if over:
            rest[p] = [float(over)]
    return uses, find_cuts(narrow, rest)


def source_targets(docs: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Per source: name, source_size (words of all its rows), target."""
    rows = docs.groupBy(F.col(source).cast("string").alias("s")).agg(
        F.sum(words_of(F.col("text").cast("string"))).alias("n")).collect()  # one row per source
    sizes = {r.s: r.n for r in rows}
    target = quotas(sizes, weights)
    return docs.sparkSession.createDataFrame([(s, sizes[s], target[s]) for s in target],
                                             "name string, source_size long, target double")


def repeated(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they are."""
    # columns that mix() would replace travel under other names
    held = {f"_doc_{i}": c for i, c in enumerate(docs.columns)}
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(h) for h, c in held.items()])
    source = F.col(f"_doc_{docs.columns.index('source')}").cast("string")
    mixed = mix(renamed, F.array(source), weights, seed, keep=list(held))
    return (mixed.where("uses > 0").withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
            .select(*[F.col(h).alias(c) for h, c in held.items()]))
