"""MinHash near-duplicates by an LSH forest.

Every document becomes its set of distinct word shingles. Equal sets fall
together by grouping on a set digest, so copies cost one row each and never
meet in pairs. One representative per distinct set then goes through:

1. *Forest.* Each tree reads its own run of MinHash values as a label and all
   representatives are sorted by it. Neighbours that share a prefix of at
   least ``MIN_DEPTH`` values form a region; a region above ``REGION`` rows is
   cut again at the next depth until it fits (adaptive depth). Rows equal over
   the whole label are taken in overlapping stretches. Within a region,
   documents whose signatures agree in :func:`estimate` of all values are
   candidates; only a spanning forest of them leaves the task. Rows of a
   region that was cut, or that may go on in another task, are marked and meet
   again in whole regions of further trees, as many as the depth needs for a
   miss chance of ``MISS``; those of crowded regions at the next depth. At the
   last depth a crowded region is one candidate component as a whole.
2. *Confirmation.* Candidate components (a superset of the true ones) receive
   the whole texts once; links are confirmed on full sets. A large component
   is dealt in blocks, each pair of blocks being one group of bounded weight.
   Again only a spanning forest of confirmed links leaves a task.
3. Connected components of the confirmed links are the classes.

With 10 trees at depth 2, a pair at similarity 0.85 shares no region with
chance (1 - 0.85^2)^10 = 3e-6, one at ``LEAST_PERCENT`` with 4e-5; each further
depth adds at most ``MISS`` for the pairs that get there. Lower similarities
would need more trees and are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paymatch.llm.components import components
from paymatch.llm.nn_descent import _groups
from paymatch.llm.store import drop, save
from paymatch.llm.words import shingle_sets

PERMUTATIONS = 128
TREES = 10
DEPTH = 12
MIN_DEPTH = 2
REGION = 2048
#: Depths of the further trees, and the chance that a pair at the similarity asked for shares none of their regions.
FURTHER = (2, 4, 8)
MISS = 1e-5
#: Lowest similarity, in per cent, that the trees are made for.
LEAST_PERCENT = 80
#: Standard deviations of an estimate below the similarity that are let pass.
DEVIATIONS = 5.38
GROUP_DOCS = 1024
GROUP_SHINGLES = 1_000_000
_CHUNK = 1 << 16

_MULTIPLY = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
             | np.uint64(1))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows x permutations, uint32) of non-empty sets."""
    out = np.zeros((len(sets), PERMUTATIONS), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at + 1, len(sets[at])
        while to < len(sets) and size + len(sets[to]) <= _CHUNK:
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        first = np.cumsum([0] + [len(s) for s in sets[at:to - 1]])
        for j in range(PERMUTATIONS):
            out[at:to, j] = np.minimum.reduceat(flat * _MULTIPLY[j], first) >> np.uint64(32)
        at = to
    return out


def _node(one: np.ndarray) -> int:
    """Id of a shingle set: 64 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(one.tobytes(), digest_size=8).digest(), "big", signed=True)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, node, signature)."""
    for batch in batches:
        sets = shingle_sets(batch.column(1))
        full = [i for i, s in enumerate(sets) if len(s)]
        sign = signatures([sets[i] for i in full])
        node: list[int | None] = [None] * len(sets)
        packed: list[bytes | None] = [None] * len(sets)
        for k, i in enumerate(full):
            node[i] = _node(sets[i])
            packed[i] = sign[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()),
             pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "node", "signature"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, signature) to one row per tree: (tree, label, node, brief)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
        brief = pa.array([row.tobytes() for row in sign.astype(np.uint8)], pa.binary())
        for tree in range(TREES):
            order = np.ascontiguousarray(sign[:, tree * DEPTH:(tree + 1) * DEPTH].astype(">u4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(sign), pa.int32()), pa.array([r.tobytes() for r in order], pa.binary()),
                 batch.column(0), brief], ["tree", "label", "node", "brief"])


def estimate(percent: int) -> int:
    """Values of two signatures that agree at least, but for a chance of 4e-8, in a pair of so many per cent."""
    p = percent / 100
    return int((p - DEVIATIONS * (p * (1 - p) / PERMUTATIONS) ** 0.5) * PERMUTATIONS)


class _Forest:
    """Union-find over positions of one region; yields a spanning forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            top = self.up[self.up]
            if (top == self.up).all():
                return top
            self.up = top

    def link(self, i: int, others: np.ndarray) -> None:
        a = self.root(i)
        for j in others:
            b = self.root(int(j))
            if a != b:
                a, b = min(a, b), max(a, b)
                self.up[b] = a


def _close(nodes: np.ndarray, brief: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Spanning forest of one region's candidate graph."""
    forest = _Forest(len(nodes))
    for i in range(len(nodes) - 1):
        same = (brief[i + 1:] == brief[i]).sum(1, dtype=np.int32)
        forest.link(i, i + 1 + np.flatnonzero(same >= need))
    top = forest.roots()
    return [(int(nodes[i]), int(nodes[t])) for i, t in enumerate(top) if t != i]


def _regions(shared: np.ndarray, a: int, b: int, depth: int) -> Iterator[tuple[int, int]]:
    """Cut the sorted stretch a..b into regions; ``shared[i]``: prefix in common with row i - 1."""
    cuts = np.flatnonzero(shared[a + 1:b] < depth) + a + 1
    for x, y in zip([a, *cuts], [*cuts, b]):
        if y - x < 2:
            continue
        if y - x <= REGION:
            yield x, y
        elif depth < DEPTH:
            yield from _regions(shared, x, y, depth + 1)
        else:
            for at in range(x, y - 1, REGION // 2):
                yield at, min(at + REGION, y)


def _candidates(batches: Iterator[pa.RecordBatch], need: int = estimate(85)) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, label, node, brief) rows to candidate edges (a, b)."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    opened = True  # the next region may have begun elsewhere

    def emit(rows, last: bool = False) -> pa.RecordBatch:
        label, node, brief = (np.concatenate(x) for x in zip(*rows))
        shared = np.zeros(len(node), np.int64)
        differ = label[1:] != label[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), DEPTH)
        edges = []
        for x, y in _regions(shared, 0, len(node), MIN_DEPTH):
            edges += _close(node[x:y], brief[x:y], need)
        # regions that are not whole here are marked: (node, null)
        cuts = [0, *np.flatnonzero(shared[1:] < MIN_DEPTH) + 1, len(node)]
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y - x > REGION or (i == 0 and opened) or (last and y == len(node)):
                edges += [(int(n), None) for n in node[x:y]]
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        # the tree counts as part of the first value, so trees never share a prefix
        first = np.asarray(batch.column(0), np.uint64)
        label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint64)
        label[:, 0] += first << np.uint64(32)
        brief = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
        kept.append((label, np.asarray(batch.column(2)), brief))
        # all before the last change of prefix is complete
        label = kept[-1][0]
        cuts = np.flatnonzero((label[1:, :MIN_DEPTH] != label[:-1, :MIN_DEPTH]).any(1))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            done = [*kept[:-1], tuple(x[:cut] for x in kept[-1])]
            kept = [tuple(x[cut:] for x in kept[-1])]
            yield emit(done)
            opened = False
        elif sum(len(k[1]) for k in kept) > 16 * REGION:
            # a very long stretch goes on in parts that share half a region
            yield emit(kept)
            opened = True
            kept = [tuple(x[-REGION // 2:] for x in kept[-1])]
    if kept:
        yield emit(kept, last=True)


def _trees(depth: int, percent: int) -> int:
    """Trees of ``depth`` values each, drawn from one signature, that miss a pair of so many per cent with chance
    ``MISS`` at most."""
    n, p = PERMUTATIONS, percent / 100
    chance = [comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]
    trees = 1
    while sum(c * (1 - comb(k, depth) / comb(n, depth)) ** trees for k, c in enumerate(chance)) > MISS:
        trees += 1
    return trees


def _keyed(depth: int, percent: int):
    """(node, signature) to one row per further tree: (region, node, brief)."""
    draw = np.random.Generator(np.random.PCG64(100 + depth))
    choices = [draw.permutation(PERMUTATIONS)[:depth] for _ in range(_trees(depth, percent))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
            brief = pa.array([row.tobytes() for row in sign.astype(np.uint8)], pa.binary())
            for tree, places in enumerate(choices):
                key = np.full(len(sign), tree + 1, np.uint64) * _MULTIPLY[0]
                for p in places:
                    key = (key ^ sign[:, p]) * _MULTIPLY[1]
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), brief],
                                                 ["region", "node", "brief"])

    return run


def _within(batches: Iterator[pa.RecordBatch], need: int) -> Iterator[pa.RecordBatch]:
    """Sorted (region, node, brief) rows, regions of bounded size, to candidate edges (a, b)."""
    for _, table in _groups(batches):
        brief = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
        edges = _close(np.asarray(table.column(1)), brief, need)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _further(one: DataFrame, marked: DataFrame, partitions: int, percent: int) -> list[DataFrame]:
    """Candidate edges among the marked nodes from whole regions of further trees, as saved tables."""
    found: list[DataFrame] = []
    for depth in FURTHER:
        rows = one.join(marked, F.col("node") == F.col("at")).select("node", "signature")
        labels = save(rows.mapInArrow(_keyed(depth, percent), "region long, node long, brief binary"), "labels")
        crowded = save(labels.groupBy(F.col("region").alias("hot")).agg(F.count("*").alias("n"), F.min("node").alias("least"))
                       .where(F.col("n") > REGION), "crowded")
        small = labels.join(crowded, F.col("region") == F.col("hot"), "left_anti")
        found.append(save(small.repartition(partitions, "region").sortWithinPartitions("region", "node")
                          .mapInArrow(partial(_within, need=estimate(percent)), "a long, b long"), "further"))
        hot = labels.join(crowded, F.col("region") == F.col("hot"))
        marked = save(hot.select(F.col("node").alias("at"), "least").distinct(), "marked")
        if not marked.limit(1).count():
            break
        if depth == FURTHER[-1]:
            found.append(marked.where("at != least").select(F.col("at").alias("a"), F.col("least").alias("b")))
        else:
            marked = marked.select("at").distinct()
        drop(labels)
    return found


def _confirm(percent: int):
    """Rows sorted by group to spanning edges of the confirmed links."""

    def linked(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flag = np.zeros(int(codes.max()) + 1, np.int32)
        forest = _Forest(len(sets))
        for i in range(len(sets) - 1):
            # sizes ascend: beyond this bound the union is too large
            end = int(np.searchsorted(sizes, 100 * sizes[i] / percent, "right"))
            if end <= i + 1:
                continue
            flag[codes[at[i]:at[i + 1]]] = 1
            both = np.add.reduceat(flag[codes[at[i + 1]:at[end]]], at[i + 1:end] - at[i + 1])
            flag[codes[at[i]:at[i + 1]]] = 0
            union = sizes[i] + sizes[i + 1:end] - both
            forest.link(i, i + 1 + np.flatnonzero(100 * both >= percent * union))
        return [(nodes[order[i]], nodes[order[t]]) for i, t in enumerate(forest.roots()) if t != i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, seen = None, [], [], set()

        def edges() -> pa.RecordBatch:
            found = linked(nodes, sets) if len(nodes) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            ids = batch.column(3).to_pylist()
            for k, node, one in zip(keys, ids, shingle_sets(batch.column(4))):
                if k != key:
                    if len(nodes) > 1:
                        yield edges()
                    key, nodes, sets, seen = k, [], [], set()
                # ids that repeat bring other texts and copies along
                if len(one) and _node(one) == node and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(one)
        yield edges()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Classes of near-duplicate documents.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are not read.
    Returns per row: doc_id, n_shingles, component_id (smallest doc_id that can
    be reached over links of at least ``percent`` per cent, from ``LEAST_PERCENT`` to 100), kept.

    Null or blank texts have no shingles and no links: each is its own class.
    Rows with equal sets are one node, so repeated rows share their class. A
    null doc_id takes part in links but never names a class unless all ids of
    the class are null; it is kept only then. No rows give no rows.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is from {LEAST_PERCENT} to 100, not {percent}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = save(rows.mapInArrow(_digest, "doc_id long, n_shingles long, node long, signature binary"), "signatures")
    # one representative row per distinct set: the smallest doc_id
    reps = save(table.where("node is not null").groupBy("node")
                .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("weight")), "nodes")
    one = save(table.where("node is not null").alias("t")
           .join(reps.alias("r").hint("merge"), (F.col("t.node") == F.col("r.node")) & F.col("t.doc_id").eqNullSafe(F.col("r.rep")))
           .select("t.node", "t.signature").dropDuplicates(["node"]), "representatives")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (one.mapInArrow(_labels, "tree int, label binary, node long, brief binary")
                   .repartitionByRange(partitions, "tree", "label", "node")
                   .sortWithinPartitions("tree", "label", "node"))
    candidates = save(sorted_rows.mapInArrow(partial(_candidates, need=estimate(percent)), "a long, b long"), "candidates")
    edges = candidates.where("b is not null")
    for more in _further(one, candidates.where("b is null").select(F.col("a").alias("at")).distinct(), partitions, percent):
        edges = edges.union(more)
    cluster = components(edges)
    links = _confirmed(rows, reps, cluster, percent, partitions)
    label = components(links)
    for used in (candidates, links):
        drop(used)
    return _classes(table, reps, label)


def _confirmed(rows: DataFrame, reps: DataFrame, cluster: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Confirmed spanning edges (a, b) within candidate components."""
    members = save(cluster.join(reps, "node").select("node", "label", "rep", "weight"), "members")
    blocks = members.groupBy("label").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(GROUP_DOCS), F.sum("weight") / F.lit(GROUP_SHINGLES)))
        .cast("int").alias("blocks"))
    dealt = save(members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))),
                 "dealt")
    # texts are shuffled at every size: one plan, whose cost grows with the input
    found = (rows.join(dealt.hint("merge"), rows.doc_id.eqNullSafe(dealt.rep))
             .select("label", "block", "blocks", "node", "weight", "text"))
    single = found.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    groups = (single.select("label", F.least("block", "other").cast("long").alias("low"),
                            F.greatest("block", "other").cast("long").alias("high"), "node", "text")
              .repartition(partitions, "label", "low", "high").sortWithinPartitions("label", "low", "high"))
    links = save(groups.mapInArrow(_confirm(percent), "a long, b long"), "links")
    drop(members)
    drop(dealt)
    return links


def _classes(table: DataFrame, reps: DataFrame, label: DataFrame) -> DataFrame:
    """Every row with the smallest doc_id of its class."""
    linked = reps.join(label, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component"))
    classes = save(linked.join(smallest, "label").select(F.col("node").alias("at"), "component"), "classes")
    out = table.select("doc_id", "n_shingles", "node").join(classes, F.col("node") == F.col("at"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_duplicates`, all columns kept.

    Repeated rows of a kept doc_id are of its class: the first by text hash
    stays. Rows without an id can't be named by a class and stay.
    """
    kept = (near_duplicates(docs, percent).where("kept and doc_id is not null")
            .select(F.col("doc_id").alias("kept")).distinct())
    # the rows travel as one column, so no name of theirs can clash
    named = docs.where("doc_id is not null").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                                    F.col("doc_id").cast("long").alias("id"))
    found = named.join(kept, F.col("id") == F.col("kept"))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row.text")))
    one = found.withColumn("n", first).where("n = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))
