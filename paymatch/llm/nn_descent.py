"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Equal vectors become one node (with the smallest ids that a top-k list can
need). The graph starts from brute force inside small cells around sampled
pivots (crowded cells are split again around pivots of their own, until all are
small) and is refined by joins of neighbours of neighbours: every node brings
its nearest forward and reverse neighbours together, and each keeps the nearest
it has met, until few entries change. A query starts at its nearest pivots (and at itself, if it is a
node) and expands its best open nodes, step by step for all queries at once,
until its ``BEAM`` best nodes are all expanded. On the way vectors travel with
all their digits (float32 where the input is, else double), so that the members
of a dense cluster are told apart; the result is scored in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paymatch.llm.store import drop, save

NEIGHBOURS = 20
#: Rounds go on until at most this share of the neighbour entries is new.
DELTA = 0.02
#: Sampled pivots: one for so many nodes, up to a bound (the only part that reaches the driver).
NODES_PER_PIVOT = 64
MOST_PIVOTS = 4096
#: Each node joins the cells of so many nearest pivots; a cell above CELL rows is split around pivots of its own, one
#: for so many rows (at most SPLIT at a time), by tasks that see CHUNK of its rows.
CELLS = 12
CELL = 2048
ROWS_PER_SPLIT = 512
SPLIT = 128
CHUNK = 16384
ENTRIES = 16
BEAM = 224
EXPAND = 72
#: Neighbours that one meeting proposes to each of its members.
PROPOSED = 8

_LISTS = "node long, ids array<long>, gaps array<float>"


# ---- helpers for tasks


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal first columns from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in range(keys))
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if change[a] and held:
                yield tuple(held[0].column(i)[0].as_py() for i in range(keys)), pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield tuple(held[0].column(i)[0].as_py() for i in range(keys)), pa.Table.from_batches(held)


def _packed(vectors: np.ndarray, width: int) -> list[bytes]:
    """Each vector as one byte ``width`` and its components in so many bytes."""
    mark = bytes([width])
    return [mark + row.tobytes() for row in vectors.astype(np.float32 if width == 4 else np.float64)]


def _vectors(column: pa.ChunkedArray | pa.Array | list[bytes]) -> np.ndarray:
    packed = column if isinstance(column, list) else column.to_pylist()
    if not packed:
        return np.zeros((0, 1))
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return raw[:, 1:].copy().view(np.float32 if raw[0, 0] == 4 else np.float64).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; centred first, so that a common offset costs no digits."""
    middle = b.mean(0)
    a, b = a - middle, b - middle
    gaps = a @ b.T
    gaps *= -2
    gaps += (a * a).sum(1)[:, None]
    gaps += (b * b).sum(1)[None, :]
    return np.maximum(gaps, 0, out=gaps)


def _nearest(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row the ``keep`` nearest other rows of one group: ids and distances."""
    gaps = _distances(vectors, vectors)
    np.fill_diagonal(gaps, np.inf)
    keep = min(keep, len(ids) - 1)
    near = np.argpartition(gaps, keep - 1, axis=1)[:, :keep]
    return ids[near], np.take_along_axis(gaps, near, 1)


def _lists(nodes: list[int], ids: list[np.ndarray], gaps: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(gaps, pa.list_(pa.float32()))],
        ["node", "ids", "gaps"])


def _meet(keys: int, keep: int) -> Callable:
    """Sorted groups (key.., node, vector) to the nearest others of each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, ids, gaps = [], [], []
        for _, table in _groups(batches, keys):
            members, first = np.unique(np.asarray(table.column(keys)), return_index=True)
            if len(members) < 2:
                continue
            near, far = _nearest(members, _vectors(table.column(keys + 1))[first], keep)
            nodes += members.tolist()
            ids += list(near)
            gaps += list(far)
            if len(nodes) > 4000:
                yield _lists(nodes, ids, gaps)
                nodes, ids, gaps = [], [], []
        yield _lists(nodes, ids, gaps)

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, ids, gaps) rows to one row a node with its nearest."""
    nodes, ids, gaps = [], [], []
    for (node,), table in _groups(batches):
        near, far = _merge(np.concatenate([np.asarray(x) for x in table.column(1).to_pylist()]),
                           np.concatenate([np.asarray(x, np.float32) for x in table.column(2).to_pylist()]), NEIGHBOURS)
        nodes.append(node)
        ids.append(near)
        gaps.append(far)
        if len(nodes) > 4000:
            yield _lists(nodes, ids, gaps)
            nodes, ids, gaps = [], [], []
    yield _lists(nodes, ids, gaps)


def _merge(ids: np.ndarray, gaps: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, gaps))
    ids, gaps = ids[order], gaps[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:keep]
    return ids[first].astype(np.int64), gaps[first]


def _cells(pivots: tuple[np.ndarray, np.ndarray], keep: int) -> Callable:
    """(node, vector) to one row for each of its nearest pivots: (pivot, node, vector, gap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = pivots
        count = min(keep, len(names))
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                gaps = _distances(_vectors(part.column(1)), places)
                near = np.argpartition(gaps, count - 1, axis=1)[:, :count]
                for j in range(count):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[near[:, j]], pa.int64()), part.column(0), part.column(1),
                         pa.array(np.take_along_axis(gaps, near[:, j:j + 1], 1)[:, 0], pa.float32())],
                        ["cell", "node", "vector", "gap"])

    return run


# ---- index


def _proper(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes_of(embeddings: DataFrame, copies: int) -> DataFrame:
    """One row per distinct vector: node (smallest vec_id), exact (array<double>),
    vector (packed), ids (the ``copies`` smallest vec_ids).

    Rows with a null id, or a vector that is null, empty, zero, of another than
    the most frequent length or has a null or non-finite component are left
    out. Repeated rows count once.
    """
    width = 4 if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else 8
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("exact"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("exact") > 0) & _proper(F.col("exact")))
    length = rows.groupBy(F.size("exact").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size("exact") == (length[0].n if length else 0)).distinct()
    place = F.row_number().over(Window.partitionBy("exact").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= copies)
    found = first.groupBy("exact").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    packed = found.select(F.get("ids", F.lit(0)).alias("node"), "ids", "exact")
    return packed.mapInArrow(_pack(width), "node long, vector binary, exact array<double>, ids array<long>")


def _pack(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = batch.column(2)
            if batch.num_rows:
                flat = np.asarray(exact.flatten(), np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_packed(flat, width), pa.binary()), exact,
                                                  batch.column(1)], ["node", "vector", "exact", "ids"])

    return run


def _sample(nodes: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots: the first ``count`` nodes in hash order, on the driver.

    A limit alone would send the first ``count`` rows of every task there; so tasks first drop what lies above a hash
    that a few more than ``count`` nodes lie below (hashes are spread evenly; a bound that proves too low is doubled).
    """
    total = nodes.count()
    count = min(count, total)
    lot = F.xxhash64("node", F.lit("pivot"))
    share = (count + 6 * count ** 0.5 + 16) / max(total, 1)
    while True:
        bound = min(int(share * 2.0 ** 64) - (1 << 63), (1 << 63) - 1)
        rows = nodes.select("node", "vector").where(lot <= bound).orderBy(lot, "node").limit(count).collect()
        if len(rows) == count:
            return np.array([r.node for r in rows], np.int64), _vectors([bytes(r.vector) for r in rows])
        share *= 2


def _regroup(df: DataFrame, *keys: str) -> DataFrame:
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys).sortWithinPartitions(*keys)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, chunk, kind, node, vector), kind 0: the cell's own pivots, to its rows with their new cells.

    Each row goes to its nearest pivot; equal distances are dealt by hash, so a split always makes a cell smaller.
    """
    for (cell, _), table in _groups(batches, 2):
        kinds = np.asarray(table.column(2))
        pivots = table.filter(pa.array(kinds == 0))
        rows = table.filter(pa.array(kinds == 1)).combine_chunks()
        names, first = np.unique(np.asarray(pivots.column(3)), return_index=True)
        places = _vectors(pivots.column(4))[first]
        mixed = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) + np.uint64(cell & (1 << 64) - 1)
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        for batch in rows.to_batches(max_chunksize=1024):
            nodes = np.asarray(batch.column(3))
            gaps = _distances(_vectors(batch.column(4)), places)
            gaps[nodes[:, None] == names[None, :]] = -1
            dealt = (nodes.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9)) ^ mixed[None, :]
            dealt = (dealt ^ (dealt >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(1)
            near = np.where(gaps == gaps.min(1, keepdims=True), dealt, np.uint64(0xFFFFFFFFFFFFFFFF)).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(mixed[near].view(np.int64), pa.int64()), batch.column(3),
                                              batch.column(4)], ["cell", "node", "vector"])


def _small_cells(cells: DataFrame) -> list[DataFrame]:
    """All of ``cells`` (cell, node, vector) as saved tables whose cells have at most ``CELL`` rows each."""
    done: list[DataFrame] = []
    while True:
        crowded = save(cells.groupBy(F.col("cell").alias("at")).agg(F.count("*").alias("n"))
                       .where(F.col("n") > CELL), "crowded")
        if not crowded.limit(1).count():
            drop(crowded)
            return [*done, cells]
        done.append(save(cells.join(crowded, F.col("cell") == F.col("at"), "left_anti"), "cells"))
        wide = save(cells.join(crowded, F.col("cell") == F.col("at")).select("cell", "node", "vector", "n"), "wide")
        drop(cells)
        # pivots: about as many as wanted by hash, and always the two first nodes
        wanted = F.least(F.lit(SPLIT), F.ceil(F.col("n") / ROWS_PER_SPLIT))
        lot = F.pmod(F.xxhash64("node", "cell", F.lit("split")), F.lit(1 << 40)) / F.lit(float(1 << 40))
        ends = wide.groupBy(F.col("cell").alias("at")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
        chosen = (wide.join(ends, F.col("cell") == F.col("at"))
                  .where((lot < wanted / F.col("n")) | F.col("node").isin(F.col("low"), F.col("high"))))
        chunks = F.ceil(F.col("n") / CHUNK).cast("long")
        columns = ["cell", "chunk", "kind", "node", "vector"]
        pivots = chosen.select("*", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"),
                               F.lit(0).alias("kind")).select(*columns)
        rows = wide.select("*", F.pmod(F.xxhash64("node"), chunks).alias("chunk"), F.lit(1).alias("kind")).select(*columns)
        cells = save(_regroup(pivots.union(rows), "cell", "chunk")
                     .mapInArrow(_split, "cell long, node long, vector binary"), "cells")
        drop(wide)
        drop(crowded)


def build_graph(nodes: DataFrame, pivots: tuple[np.ndarray, np.ndarray], delta: float = DELTA) -> DataFrame:
    """NN-descent: (node, ids, gaps), the nearest neighbours found of every node."""
    vectors = nodes.select("node", "vector")
    cells = _small_cells(save(vectors.mapInArrow(_cells(pivots, CELLS), "cell long, node long, vector binary, gap float")
                              .drop("gap"), "cells"))
    graph = None
    for level in cells:
        met = _regroup(level, "cell").mapInArrow(_meet(1, NEIGHBOURS), _LISTS)
        graph = met if graph is None else graph.union(met)
    graph = save(_regroup(graph, "node").mapInArrow(_best, _LISTS), "graph")
    for level in cells:
        drop(level)
    while True:
        better = _refine(graph, vectors)
        share = _changed(graph, better)
        drop(graph)
        graph = better
        if share <= delta:
            return graph


def _changed(graph: DataFrame, better: DataFrame) -> float:
    """Share of the neighbour entries of ``better`` that ``graph`` has not."""
    before = graph.select(F.col("node").alias("at"), F.col("ids").alias("had"))
    both = better.select("node", "ids").join(before, F.col("node") == F.col("at"), "left")
    new = F.coalesce(F.size(F.array_except("ids", "had")), F.size("ids"))
    row = both.agg(F.sum(new).alias("new"), F.sum(F.size("ids")).alias("all")).first()
    return row["new"] / row["all"] if row["all"] else 0.0


def _both_ways(graph: DataFrame) -> DataFrame:
    """(center, member): forward neighbours, and the nearest as many reverse ones."""
    forward = graph.select("node", F.explode(F.arrays_zip("ids", "gaps")).alias("x")).select(
        "node", F.col("x.ids").alias("other"), F.col("x.gaps").alias("gap"))
    place = F.row_number().over(Window.partitionBy("other").orderBy("gap", "node"))
    reverse = forward.withColumn("place", place).where(F.col("place") <= NEIGHBOURS)
    return forward.select(F.col("node").alias("center"), F.col("other").alias("member")).union(
        reverse.select(F.col("other").alias("center"), F.col("node").alias("member")))


def _refine(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """One round: all neighbours of a node meet; everybody keeps the nearest met."""
    pairs = save(_both_ways(graph).union(graph.select(F.col("node").alias("center"), F.col("node").alias("member"))),
                 "pairs")
    brought = pairs.join(vectors, pairs.member == vectors.node).select("center", "member", "vector")
    met = _regroup(brought, "center").mapInArrow(_meet(1, PROPOSED), _LISTS)
    better = save(_regroup(met.union(graph), "node").mapInArrow(_best, _LISTS), "graph")
    drop(pairs)
    return better


# ---- search


_STATE = "q long, vector binary, ids array<long>, gaps array<float>, open array<boolean>"


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a query (its state, and new nodes with vectors) to its next state.

    Input: q, kind (0: state, 1: new node), node, vector, ids, gaps, open.
    """
    q, vectors, ids, gaps, opened = [], [], [], [], []

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(vectors, pa.binary()), pa.array(ids, pa.list_(pa.int64())),
             pa.array(gaps, pa.list_(pa.float32())), pa.array(opened, pa.list_(pa.bool_()))],
            ["q", "vector", "ids", "gaps", "open"])

    for (query,), table in _groups(batches):
        kinds = np.asarray(table.column(1))
        state = table.take([int(np.flatnonzero(kinds == 0)[0])]).to_pylist()[0]
        fresh = table.filter(pa.array(kinds == 1))
        old = np.array(state["ids"] or [], np.int64)
        best, far, still = old, np.array(state["gaps"] or [], np.float32), np.array(state["open"] or [], bool)
        if fresh.num_rows:
            names, first = np.unique(np.asarray(fresh.column(2)), return_index=True)
            new = ~np.isin(names, old)
            names, places = names[new], _vectors(fresh.column(3))[first][new]
            if len(names):
                here = _distances(_vectors([state["vector"]]), places)[0]
                best, far = np.concatenate([best, names]), np.concatenate([far, here])
                still = np.concatenate([still, np.ones(len(names), bool)])
        order = np.lexsort((best, far))[:BEAM]
        q.append(query)
        vectors.append(state["vector"])
        ids.append(best[order])
        gaps.append(far[order])
        opened.append(still[order])
        if len(q) > 2000:
            yield emit()
            q, vectors, ids, gaps, opened = [], [], [], [], []
    yield emit()


def search(nodes: DataFrame, graph: DataFrame, pivots: tuple[np.ndarray, np.ndarray], queries: DataFrame) -> DataFrame:
    """Greedy search: ``queries`` (q, vector) to (q, ids): the nearest nodes found, nearest first."""
    vectors = nodes.select("node", "vector")
    edges = save(_both_ways(graph).distinct(), "adjacent")
    adjacent = save(edges.groupBy("center").agg(F.collect_list("member").alias("members")), "lists")  # bounded lists
    drop(edges)
    empty = [F.array().cast(t).alias(n) for n, t in (("ids", "array<long>"), ("gaps", "array<float>"),
                                                     ("open", "array<boolean>"))]
    state = save(queries.select("q", "vector", *empty), "state")
    entry = (queries.select(F.col("q").alias("node"), "vector")
             .mapInArrow(_cells(pivots, ENTRIES), "cell long, node long, vector binary, gap float")
             .select(F.col("node").alias("q"), F.col("cell").alias("at")))
    wanted = entry.union(queries.select("q", F.col("q").alias("at")))
    while True:
        fresh = wanted.join(vectors, wanted["at"] == vectors.node).select(
            "q", F.lit(1).alias("kind"), "node", "vector", *empty)
        held = state.select("q", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("node"), "vector", "ids", "gaps",
                            "open")
        after = save(_regroup(held.union(fresh), "q").mapInArrow(_advance, _STATE), "state")
        drop(state)
        if not after.where(F.exists("open", lambda x: x)).limit(1).count():
            break
        # the best open nodes of each query, closed in its state as they go out
        places = F.filter(F.sequence(F.lit(0), F.size("open") - 1), lambda i: F.get("open", i))
        chosen = F.slice(places, 1, EXPAND)
        open_now = after.where(F.exists("open", lambda x: x))
        frontier = open_now.select("q", F.explode(F.transform(chosen, lambda i: F.get("ids", i))).alias("from"))
        wanted = (frontier.join(adjacent, F.col("from") == adjacent.center)
                  .select("q", F.explode("members").alias("at")).distinct())
        closed = F.when(F.size("open") > 0, F.transform("open", lambda x, i: x & ~F.array_contains(chosen, i))).otherwise(
            F.col("open"))
        state = after.withColumn("open", closed)
    drop(adjacent)
    return after.select("q", "ids")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """Each query's ``k`` nearest other rows found: query_id, rank, vec_id, score.

    ``is_query``: condition on ``vec_id`` of ``embeddings`` (vec_id, embedding).
    Score: Euclidean distance in double on the original vectors; ties go to the
    smaller vec_id. Rows that :func:`nodes_of` leaves out take no part, as
    queries or candidates; fewer candidates than ``k`` give fewer rows.
    """
    nodes = save(nodes_of(embeddings, k + 1), "vectors")
    count = nodes.count()
    if not count:
        return nodes.select(F.col("node").alias("query_id"), F.lit(0).alias("rank"), F.col("node").alias("vec_id"),
                            F.lit(0.0).alias("score"))
    pivots = _sample(nodes, min(MOST_PIVOTS, -(-count // NODES_PER_PIVOT)))
    graph = build_graph(nodes, pivots)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.col("embedding").cast("array<double>").alias("same")).where(is_query).distinct()
    asked = save(rows.join(nodes.select("exact", "node"), F.col("same") == F.col("exact"))
                 .select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")), "queries")
    starts = save(asked.select("q").distinct().join(nodes, F.col("q") == F.col("node")).select("q", "vector", "exact"),
                  "starts")
    found = search(nodes, graph, pivots, starts.select("q", "vector"))
    pairs = found.select("q", F.explode("ids").alias("near"))
    scored = (pairs.join(starts.select("q", F.col("exact").alias("from")), "q")
              .join(nodes.select("node", F.col("exact").alias("to"), "ids"), F.col("near") == F.col("node"))
              .select("q", "ids", F.sqrt(F.aggregate(F.zip_with("from", "to", lambda a, b: (a - b) * (a - b)),
                                                     F.lit(0.0), lambda s, x: s + x)).alias("score"))
              .select("q", F.explode("ids").alias("vec_id"), "score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    top = scored.withColumn("place", place).where(F.col("place") <= k + 1)  # one may be the query itself
    lists = save(top.groupBy(F.col("q").alias("at")).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id")))
                                                         .alias("near")), "nearest")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asked.join(lists, F.col("q") == F.col("at")).select("query_id", F.posexplode(own).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    F.col("x.score").alias("score")))
