"""The Merkle manifest against a plain tree, and its logs, proofs and awkward rows."""

import hashlib
import zlib

import pytest

from paymatch.llm import merkle, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = row[name]
        if value is not None and lower and name == "text":
            value = value.translate(LOWER)
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    """Per row, in source and leaf order: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
          for s in sources}
    trees = [levels([leaf(r) for r in by[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(by[s]):
            path = []
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    low = at // 16 * 16
                    run = level[low:low + 16]
                    path.append((run[:at - low], run[at - low + 1:]))
                    at //= 16
            tampered = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            folded = leaf(row, tampered)
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            out.append((row.doc_id, trees[k][0][i], trees[k][-1][0], top[-1][0],
                        sha("".join("".join(a) + "".join(b) for a, b in path)), folded, folded == top[-1][0]))
    return out


def test_positions_are_those_of_an_append_log():
    for n in [*range(1, 40), 255, 256, 257, 271, 300, 4095, 4096, 4097, 5000]:
        top = merkle.height(n)
        done = [0] * (top + 1)
        log = []
        for _ in range(n):
            log.append((0, done[0]))
            done[0] += 1
            level = 0
            while level < top and done[level] % 16 == 0:
                log.append((level + 1, done[level + 1]))
                done[level + 1] += 1
                level += 1
        for level in range(top):
            if done[level] > 16 * done[level + 1]:
                log.append((level + 1, done[level + 1]))
                done[level + 1] += 1
        assert log[-1] == (top, 0)
        assert [merkle.position(level, at, n) for level, at in log] == list(range(len(log)))


def test_query(spark):
    found = queries.queries()["op11_merkle"](spark, SF).collect()
    expected = brute(spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, found)) == sorted(expected)
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 4097])
def test_one_source_of_many_leaves(spark, n):
    """Blocks of several rounds, in the order of completion; every proof folds to the root."""
    rows = [(i, None, "en", i, "Text") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(docs.repartition(3))
    plain = levels([leaf({"doc_id": i, "source": None, "lang": "en", "n_chars": i, "text": "Text"}) for i in range(n)])
    log = [r for part in manifest.log for r in part.collect()]
    assert sorted(r.position for r in log) == list(range(len(log)))
    assert {(r.level, r.at): r.digest for r in log} == {(k, i): d for k, level in enumerate(plain) for i, d in enumerate(level)}
    wanted = manifest.leaves.where(f"doc_id in (0, {n - 1}, {n // 2})")
    proofs = merkle.proofs(manifest, wanted).collect()
    assert len(proofs) == len({0, n - 1, n // 2})
    for p in proofs:
        assert p.leaf == plain[0][p.doc_id]
        assert merkle.fold(p.leaf, p.slots, p.siblings) == manifest.root
        assert merkle.fold(sha("x"), p.slots, p.siblings) != manifest.root


def test_awkward_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, at string, n int, place string"
    extra = ["x", "y", 1, "z"]
    rows = [(1, "b", None, None, None, *extra), (1, "b", None, None, None, *extra), (1, "b", "en", 3, "ÀBc", *extra),
            (None, None, None, None, "", *extra), (5, "", "de", -1, "A" * 100_000, *extra), (6, "é", "x:y", 0, "-", *extra),
            (None, "b", "fr", 1, "A", *extra)]
    docs = spark.createDataFrame(rows, schema)
    manifest = merkle.build(docs, {"changed": merkle.F.when(merkle.F.crc32(merkle.F.col("doc_id").cast("string")) % 5 == 0,
                                                            merkle.leaf_of(merkle.lowered(merkle.F.col("text"))))})
    found = [tuple(r) for r in merkle.verify(manifest, manifest.leaves).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute(docs.collect())))
    none = merkle.build(docs.where("false"), {"changed": merkle.F.lit(None).cast("string")})
    assert none.root is None and merkle.verify(none, none.leaves).count() == 0
