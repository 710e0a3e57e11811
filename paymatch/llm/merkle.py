"""Merkle manifest of a dataset as a postorder append log.

Rows become leaves; the leaves of one source, in doc_id order, are those of a
tree whose nodes hash up to 16 consecutive nodes below them, and the roots of
the sources, in source order, are the leaves of one more tree. Every tree is a log
to which nodes are appended in the order in which they are complete (postorder).
The place of a node in its log follows from subtree sizes alone
(:func:`position`), so siblings are addressed without any index.

A builder takes an aligned block of 16^3 nodes and appends the three levels
above them; its topmost nodes are the input of the next round's builders, so a
tree of n leaves takes log(n) / log(4096) rounds and no task holds more than a block,
however large a source is. Proofs are read off downwards over the same blocks:
a block receives the path from its top node to the root and extends it to each
of its nodes by the siblings that the closed form addresses in the log.

A node's hash is the lowercase hex sha256 of its children's hex digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.llm.nn_descent import _groups
from paymatch.llm.ordering import in_order, numbered, partitions_of, stretches
from paymatch.llm.store import save

#: Children of a node as a power of two, and the levels that one builder appends.
BITS = 4
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tree number of the tree over the sources.
TOP = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOG = "tree long, n long, level int, at long, position long, digest string"
_PATH = "tree long, block long, slots array<int>, siblings array<string>, subroot string, root string"


def height(n: int) -> int:
    """Level of the root above ``n`` leaves (one leaf is its own root)."""
    h = 0
    while 1 << BITS * h < n:
        h += 1
    return h


def position(level: int, at: int, n: int) -> int:
    """Place in the postorder log of ``n`` leaves of node ``at`` of ``level``, in closed form.

    Once a leaf count ``m`` is appended, floor(m / 16^k) nodes of level k are
    complete. A node with all its leaves follows, ``level`` places on, the last
    of them; the others (the last of their level) close the log from below.
    """
    last = (at + 1) << BITS * level
    if last <= n:
        before = last - 1
        return sum(before >> BITS * k for k in range(height(n) + 1)) + level
    whole = sum(n >> BITS * k for k in range(height(n) + 1))
    return whole + sum(n % (1 << BITS * k) != 0 for k in range(1, level))


def hash_of(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def append_block(base: int, block: int, n: int, digests: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """Nodes (level, at, position, digest) that one builder appends, in the order of their completion.

    ``digests``: those of the nodes of level ``base`` in the aligned block; they are
    appended too where they are leaves.
    """
    top = min(base + LEVELS, height(n))
    open_runs: list[list[str]] = [[] for _ in range(LEVELS + 1)]
    first = block << BITS * LEVELS
    for i, digest in enumerate(digests):
        if base == 0:
            yield 0, first + i, position(0, first + i, n), digest
        open_runs[0].append(digest)
        level = base
        while level < top and len(open_runs[level - base]) == 1 << BITS:
            digest = hash_of("".join(open_runs[level - base]))
            open_runs[level - base] = []
            level += 1
            at = first + i >> BITS * (level - base)
            yield level, at, position(level, at, n), digest
            open_runs[level - base].append(digest)
    for level in range(base, top):
        run = open_runs[level - base]
        if run:
            digest = hash_of("".join(run))
            at = first + len(digests) - 1 >> BITS * (level + 1 - base)
            yield level + 1, at, position(level + 1, at, n), digest
            open_runs[level + 1 - base].append(digest)


def block_paths(base: int, block: int, n: int, log: dict[int, str]) -> Callable[[int], tuple[list[int], list[str]]]:
    """How a node of the block reaches the block's top: per level its place in its run, and the run's other digests."""
    top = min(base + LEVELS, height(n))

    def upward(at: int) -> tuple[list[int], list[str]]:
        slots, siblings = [], []
        for level in range(base, top):
            low = at >> BITS << BITS
            high = min(low + (1 << BITS), -(-n >> BITS * level))
            slots.append(at - low)
            siblings.append("".join(log[position(level, k, n)] for k in range(low, high) if k != at))
            at >>= BITS
        return slots, siblings

    return upward


def fold(digest: str, slots: list[int], siblings: list[str]) -> str:
    """Root that a leaf's digest and its siblings give."""
    for slot, others in zip(slots, siblings):
        digest = hash_of(others[:64 * slot] + digest + others[64 * slot:])
    return digest


def leaf_of(text: Column) -> Column:
    """Hash of a row: of each field ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


@dataclass
class Manifest:
    """``leaves``: (tree, at, n, source, digest and the columns kept); ``log``: the nodes of all trees, one
    written table per round (tree, n, level, at, position, digest); ``roots``: (tree, subroot); ``top``: the same
    two for the tree over the sources; ``root``: its digest (None without rows)."""

    leaves: DataFrame
    log: list[DataFrame]
    roots: DataFrame
    top_log: list[DataFrame]
    root: str | None


def _blocks(rows: DataFrame, at: str = "at") -> DataFrame:
    return rows.withColumn("block", F.shiftright(F.col(at), BITS * LEVELS))


def _append(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), table in _groups(batches, 2):
            n = table.column(2)[0].as_py()
            nodes = list(append_block(base, block, n, table.column(4).to_pylist()))
            if nodes:
                levels, ats, positions, digests = zip(*nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(nodes), pa.int64()), pa.array([n] * len(nodes), pa.int64()),
                     pa.array(levels, pa.int32()), pa.array(ats, pa.int64()), pa.array(positions, pa.int64()),
                     pa.array(digests, pa.string())], ["tree", "n", "level", "at", "position", "digest"])

    return run


def append(leaves: DataFrame) -> list[DataFrame]:
    """Logs of all trees from their leaves (tree, at, n, digest): one written table a round."""
    rounds, nodes = [], leaves
    while True:
        base = LEVELS * len(rounds)
        dealt = (_blocks(nodes).select("tree", "block", "n", "at", "digest")
                 .repartition(partitions_of(leaves), "tree", "block").sortWithinPartitions("tree", "block", "at"))
        rounds.append(save(dealt.mapInArrow(_append(base), _LOG), "merkle-log"))
        base += LEVELS
        nodes = rounds[-1].where((F.col("level") == base) & (F.col("n") > F.lit(1 << BITS * base)))
        if not nodes.limit(1).count():
            return rounds


def roots(log: list[DataFrame]) -> DataFrame:
    """(tree, n, subroot) of every tree of the logs."""
    width = F.expr(f"shiftleft(1L, {BITS} * level)")
    below = F.expr(f"if(level = 0, 0L, shiftleft(1L, {BITS} * (level - 1)))")
    found = [part.where((width >= F.col("n")) & (below < F.col("n"))) for part in log]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("tree", "n", F.col("digest").alias("subroot"))


def build(docs: DataFrame, kept: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are not read).

    ``kept`` names further columns of the leaves. Sources go by their UTF-8 bytes,
    null first; leaves by doc_id, null first, then by digest, so that repeated ids have
    a defined order; equal rows are leaves of their own. No rows give no trees.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf_of(text).alias("digest"), *[c.alias(k) for k, c in (kept or {}).items()])
    ordered = in_order(rows, ["source", "doc_id", "digest"], "merkle-leaves")
    found = stretches(ordered, ["source"])
    names = in_order(found.select("source").distinct(), ["source"], "merkle-sources")
    count = names.count()
    tree = numbered(names, [], stretches(names, [])).select(F.col("source").alias("_name"), F.col("at").alias("tree"))
    found = found.join(tree, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    leaves = save(numbered(ordered, ["source"], found).drop("place"), "merkle-numbered")
    log = append(leaves)
    below = save(roots(log), "merkle-roots")
    top_leaves = below.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"),
                              F.lit(count).cast("long").alias("n"), F.col("subroot").alias("digest"))
    top_log = append(top_leaves)
    root = roots(top_log).first()
    return Manifest(leaves, log, below, top_log, root.subroot if root else None)


def _down(base: int):
    """Log rows and the path of a block to the paths of its nodes, as blocks of the round below."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), table in _groups(batches, 2):
            r = {c: table.column(c).to_pylist() for c in table.column_names}
            log = {p: d for p, d in zip(r["position"], r["digest"]) if p is not None}
            upward = block_paths(base, block, r["n"][-1], log)
            out = {c: [] for c in ("at", "slots", "siblings")}
            for kind, level, at in zip(r["kind"], r["level"], r["at"]):
                if kind == 1 and level == base:
                    slots, siblings = upward(at)
                    out["at"].append(at)
                    out["slots"].append(slots + r["slots"][0])
                    out["siblings"].append(siblings + r["siblings"][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree] * len(out["at"]), pa.int64()), pa.array(out["at"], pa.int64()),
                 pa.array(out["slots"], pa.list_(pa.int32())), pa.array(out["siblings"], pa.list_(pa.string())),
                 pa.array([r["subroot"][0]] * len(out["at"]), pa.string()),
                 pa.array([r["root"][0]] * len(out["at"]), pa.string())],
                ["tree", "block", "slots", "siblings", "subroot", "root"])

    return run


def _meeting(log: DataFrame, base: int, entry: DataFrame) -> DataFrame:
    """Log rows of a round's blocks after the path row of each block (kind 0)."""
    inner = log.where((F.col("level") >= base) & (F.col("level") < base + LEVELS)).withColumn(
        "block", F.expr(f"shiftright(at, cast({BITS} * ({base + LEVELS} - level) as int))"))
    return (entry.withColumn("kind", F.lit(0))
            .unionByName(inner.withColumn("kind", F.lit(1)), allowMissingColumns=True))


def _dealt(rows: DataFrame) -> DataFrame:
    first = ["tree", "block", "kind", "position"]
    return (rows.select(*first, *[c for c in rows.columns if c not in first])
            .repartition(partitions_of(rows), "tree", "block").sortWithinPartitions(*first))


def block_entries(log: list[DataFrame], entry: DataFrame) -> DataFrame:
    """Paths down to the bottom blocks.

    ``entry``: one row per tree (tree, n, slots, siblings, subroot, root) with the path above its root. Returns
    the same per bottom block (``_PATH``).
    """
    entering = entry.withColumn("block", F.lit(0).cast("long"))
    above = None
    for k in range(len(log) - 1, -1, -1):
        base = LEVELS * k
        # trees whose root is among this round's levels enter here
        n = F.col("n")
        here = entering.where((n <= F.lit(1 << BITS * (base + LEVELS))) & ((n > F.lit(1 << BITS * base)) | F.lit(k == 0)))
        here = here.select("tree", "block", "slots", "siblings", "subroot", "root")
        above = here if above is None else above.unionByName(here)
        if k:
            # nodes of the round's bottom level were appended by the round below
            rows = log[k].unionByName(log[k - 1].where((F.col("level") == base) & (n > F.lit(1 << BITS * base))))
            above = save(_dealt(_meeting(rows, base, above)).mapInArrow(_down(base), _PATH), "merkle-paths")
    return above


def _proofs(emit: Callable, names: list[str], types: list):
    """Bottom blocks with their paths and the leaves that ask for a proof (kind 2), each given to ``emit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block), table in _groups(batches, 2):
            r = {c: table.column(c).to_pylist() for c in table.column_names}
            if r["kind"][-1] != 2:
                continue
            log = {p: d for p, d in zip(r["position"], r["digest"]) if p is not None}
            n = r["n"][-1]
            upward = block_paths(0, block, n, log)
            found = []
            for i, kind in enumerate(r["kind"]):
                if kind == 2:
                    slots, siblings = upward(r["at"][i])
                    found.append(emit({c: v[i] for c, v in r.items() if c not in ("slots", "siblings")},
                                      log[position(0, r["at"][i], n)], slots + r["slots"][0], siblings + r["siblings"][0],
                                      r["subroot"][0], r["root"][0]))
            for a in range(0, len(found), 1024):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found[a:a + 1024]), types)], names)

    return run


def _whole_proof(row: dict, leaf: str, slots: list[int], siblings: list[str], subroot: str, root: str) -> tuple:
    return row["tree"], row["at"], row["doc_id"], leaf, slots, siblings, subroot, root


def _checked(row: dict, leaf: str, slots: list[int], siblings: list[str], subroot: str, root: str) -> tuple:
    folded = fold(row["changed"] or leaf, slots, siblings)
    return row["doc_id"], leaf, subroot, root, hash_of("".join(siblings)), folded, folded == root


def _asked(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    sizes = manifest.top_log[0].where("level = 0").select(
        F.col("tree"), "n", F.array().cast("array<int>").alias("slots"), empty.alias("siblings"),
        F.lit(None).cast("string").alias("subroot"), F.lit(manifest.root).cast("string").alias("root")).limit(1)
    # paths of the sources' roots: leaves of the top tree
    top = block_entries(manifest.top_log, sizes)
    meeting = _dealt(_meeting(manifest.top_log[0], 0, top))
    of_source = meeting.mapInArrow(_down(0), _PATH).select(F.col("block").alias("tree"), "slots", "siblings", "root")
    entry = save(of_source.join(manifest.roots, "tree").select("tree", "n", "slots", "siblings", "subroot", "root"),
                 "merkle-entries")
    bottom = block_entries(manifest.log, entry)
    asked = _blocks(wanted).withColumn("kind", F.lit(2)).drop("digest")
    return _dealt(_meeting(manifest.log[0], 0, bottom).unionByName(asked, allowMissingColumns=True))


def proofs(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """Proofs of some or all leaves (rows of ``manifest.leaves``).

    Returns tree, at, doc_id, leaf, slots (place in the run, per level up to the root), siblings (digests of the
    run's others, left to right, as one string per level), subroot, root; :func:`fold` gives the root back.
    """
    rows = wanted.select("tree", "at", "n", "doc_id")
    names = ["tree", "at", "doc_id", "leaf", "slots", "siblings", "subroot", "root"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(),
             pa.string()]
    return _asked(manifest, rows).mapInArrow(
        _proofs(_whole_proof, names, types), "tree long, at long, doc_id long, leaf string, slots array<int>, "
                                             "siblings array<string>, subroot string, root string")


def verify(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """Leaves checked against the root: proofs are folded where they are read, so none leaves its task.

    ``wanted``: rows of ``manifest.leaves`` with ``changed`` (digest of the row as it is now, null if
    unchanged). Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    rows = wanted.select("tree", "at", "n", "doc_id", "changed")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return _asked(manifest, rows).mapInArrow(
        _proofs(_checked, names, types), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                         "folded_root string, verified boolean")
