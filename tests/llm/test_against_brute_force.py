"""The operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from helpers import digest, duck_digest, spark_digest
from paymatch.llm import decontaminate, mixing, nn_descent, pii_crf, queries, sharding, warc
from paymatch.llm.histogram import find_cuts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def run(spark, name):
    return queries.queries()[name](spark, SF)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_classes(rows, percent=85):
    """doc_id to (set size, smallest id of its class), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cols, expected = duck_digest(con, queries.oracle_sql()[name])
    df = run(spark, name)
    assert sorted(df.columns) == cols
    assert spark_digest(df) == expected


def test_near_dups(spark, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op7_near_dups").collect()}
    assert found == brute_classes([(r.doc_id, r.text) for r in documents])


def test_near_dups_of_one_large_family(spark):
    """A family of near copies at all distances, and links that hang on one hub alone."""
    from paymatch.llm.near_dups import near_duplicates
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(150)] = f"x{r.randrange(10_000)}"
        rows.append((i + 1, " ".join(words)))
    found = {x.doc_id: (x.n_shingles, x.component_id)
             for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_classes(rows)


def test_regions_are_cut_deeper_and_whole_labels_overlap(monkeypatch):
    from paymatch.llm import near_dups
    monkeypatch.setattr(near_dups, "REGION", 4)
    shared = np.array([0, 12, 12, 12, 12, 12, 12, 1, 3, 3, 5, 5, 5, 2])
    regions = list(near_dups._regions(shared, 0, len(shared), near_dups.MIN_DEPTH))
    covered = {i for a, b in regions for i in range(a, b)}
    assert all(b - a <= 4 for a, b in regions)
    assert set(range(7)) <= covered and {9, 10, 11, 12} <= covered | {8, 9}


def test_near_dups_in_crowded_and_cut_regions(spark, monkeypatch):
    """Texts on one template, linked in pairs alone: regions far above the bound, cut between tasks too."""
    from paymatch.llm import near_dups
    monkeypatch.setattr(near_dups, "REGION", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for p in range(10, 200, 20):
            words[p] = f"p{i}x{p}"
        rows.append((2 * i + 1, " ".join(words)))
        for p in r.sample(range(0, 200, 20), 2):
            words[p] = f"q{i}x{p}"
        rows.append((2 * i + 2, " ".join(words)))
    found = {x.doc_id: (x.n_shingles, x.component_id)
             for x in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected = brute_classes(rows)
    print("wrong rows", sum(found[i] != expected[i] for i in expected), "classes", len({c for _, c in expected.values()}))
    assert found == expected


def test_rows_of_regions_cut_between_tasks_are_marked():
    import pyarrow as pa
    from paymatch.llm import near_dups
    sign = np.ones((1, 128), np.uint32).tobytes()
    marked = set()
    for node in (1, 2):  # two equal signatures, each in a task of its own
        batch = pa.RecordBatch.from_pydict({"node": [node], "signature": [sign]})
        rows = list(near_dups._labels(iter([batch])))
        for out in near_dups._candidates(iter(rows)):
            marked |= {a for a, b in zip(*(c.to_pylist() for c in out.columns)) if b is None}
    assert marked == {1, 2}


def test_shards(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op1_sharding").collect()}
    assert len(rows) == len(documents)
    for d in documents:
        data = (d.text or "").encode()
        assert (rows[d.doc_id].size, rows[d.doc_id].text_crc32) == (len(data) + 16, zlib.crc32(data))
    most = max(r.size for r in rows.values())
    sums = [sum(r.size for r in rows.values() if r.shard == s) for s in range(40)]
    assert max(sums) - min(sums) <= 2 * most
    for s in range(40):
        slots = sorted(r.slot for r in rows.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_stretches_follow_the_weight(spark):
    """A hot text with clustered ids and many small texts: stretches within their bytes, the same slots as one sort."""
    r = random.Random(4)
    rows = [(i if i < 900 else 10 ** 15 + i, "hot text " * 5) for i in range(1500)]
    rows += [(2 * 10 ** 16 + i, f"text {r.randrange(700)} " * 5) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    fine = {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 4, stretch=1000).collect()}
    assert fine == {r.doc_id: (r.shard, r.slot) for r in sharding.shards(docs, 4).collect()}
    narrow = docs.select(sharding.key_of(docs.text, docs.doc_id).alias("_key"), sharding.size_of(docs.text).alias("weight"))
    levels, counted = sharding._stretches(narrow, [], 1000)
    assert len(levels) >= 2
    assert counted.where("low < high").agg({"weight": "max"}).first()[0] <= 2000
    sizes = {i: len(t) + 16 for i, t in rows}
    sums = [sum(sizes[i] for i, (s, _) in fine.items() if s == n) for n in range(4)]
    share = sum(sizes.values()) / 4
    assert all(abs(x - share) <= 2 * (sharding.SLACK * share + max(sizes.values())) for x in sums)
    # only the hot text, which is larger than a shard, lies in more than one
    homes: dict[str, set[int]] = {}
    for i, t in rows:
        homes.setdefault(t, set()).add(fine[i][0])
    assert {t for t, found in homes.items() if len(found) > 1} == {"hot text " * 5}


def test_cuts_are_exact(spark):
    r = random.Random(1)
    rows = [("g", r.choice([7, 10 ** 30, r.randrange(10 ** 37)]), r.randrange(50)) for _ in range(3000)]
    table = spark.createDataFrame([(g, str(k), w) for g, k, w in rows], "group string, key string, weight long")
    table = table.withColumn("key", table.key.cast("decimal(38,0)"))
    total = sum(w for _, _, w in rows)
    targets = [total * i / 9 for i in range(1, 9)]
    keys = sorted({k for _, k, _ in rows})
    below = [0]
    for k in keys:
        below.append(below[-1] + sum(w for _, x, w in rows if x == k))
    for target, cut in zip(targets, find_cuts(table, {"g": targets})["g"]):
        got = sum(w for _, k, w in rows if k < cut)
        assert abs(got - target) == min(abs(b - target) for b in below)


def test_quotas_and_flow():
    got = mixing.quotas({"a": 10, "b": 5, None: 100})
    assert got == {"a": 30.0, "b": 15.0, None: 70.0}
    flow = mixing.cheapest_flow({"ab": (10, [0, 1]), "b": (5, [1])}, [12, 20])
    into = [sum(w for parts in flow.values() for s, w in parts if s == i) for i in (0, 1)]
    assert into == [12, 20]
    used = {p: sum(w for _, w in parts) for p, parts in flow.items()}
    # the cheapest: both twice (10 + 10 + 5 + 5), and the rest from a third use
    assert used["ab"] + used["b"] == 32 and used["ab"] >= 20 and used["b"] >= 10


def test_flow_is_cheapest():
    """Against all whole flows of a small instance."""
    import itertools
    cost = lambda used, cap: sum(min(max(used - k * cap, 0), cap) * c for k, c in enumerate(mixing.USE_COSTS))
    for seed in range(20):
        r = random.Random(seed)
        caps, demand = [r.randint(1, 3) for _ in range(3)], [r.randint(1, 5), r.randint(1, 5)]
        members = [[0], [1], [0, 1]]
        flow = mixing.cheapest_flow({str(i): (caps[i], members[i]) for i in range(3)}, demand)
        got = [dict(flow[str(i)]) for i in range(3)]
        served = sum(sum(x.values()) for x in got)
        price = sum(cost(sum(x.values()), c) for x, c in zip(got, caps))
        best = None
        for a, b, c0, c1 in itertools.product(range(10), repeat=4):
            if a <= 3 * caps[0] and b <= 3 * caps[1] and c0 + c1 <= 3 * caps[2] and a + c0 <= demand[0] and b + c1 <= demand[1]:
                key = (-(a + b + c0 + c1), cost(a, caps[0]) + cost(b, caps[1]) + cost(c0 + c1, caps[2]))
                best = key if best is None else min(best, key)
        assert (-served, price) == best


def test_mix(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op2_mixing").collect()}
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in documents}
    by: dict = {}
    for d in documents:
        by.setdefault(d.source, []).append(d.doc_id)
    target = mixing.quotas({s: sum(size[i] for i in ids) for s, ids in by.items()})
    for s, ids in by.items():
        assert all(rows[i].size == size[i] and rows[i].target == target[s] for i in ids)
        assert all(rows[i].taken in {k * size[i] for k in range(4)} for i in ids)
        assert abs(sum(rows[i].taken for i in ids) - target[s]) <= max(size[i] for i in ids)


def test_overlapping_sources(spark):
    """Documents of two sources serve both quotas before anything is repeated."""
    from pyspark.sql import functions as F
    rows = [(i, "w " * 10, ["a"] if i < 20 else ["b"] if i < 25 else ["a", "b"]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    out = mixing.mix(table, F.col("held"), weights=(1, 1)).collect()
    assert all(r.uses >= 1 for r in out)
    assert abs(sum(r.uses * r.size for r in out) - 950) <= 20  # both sources' sizes: 550 and 400


def plain_base(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True,
                    12 <= len(digits) <= 19 and pii_crf.luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice("01259.- +@()ab\né%x1234567890") for _ in range(r.randint(0, 60)))
        assert pii_crf.base_spans(text) == plain_base(text)


def test_pii(spark, documents):
    texts = {d.doc_id: d.text for d in documents}
    for r in run(spark, "op4_pii").collect():
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii_crf.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(pii_crf.written(base).split(",")) <= set(r.spans.split(","))


def test_crf_on_held_out_sentences():
    model = pii_crf.fit()
    table = pii_crf.labelled_table(300, seed=99)
    tags = pii_crf.viterbi(model, [model.unary(w) for w, _ in table])
    right = sum([pii_crf.LABELS[t] for t in row] == labels for row, (_, labels) in zip(tags, table))
    assert right >= 0.97 * len(table)
    text = "ring (030) 123-4567 or write anna (at) example (dot) com, pay 4111.1111.1111.1111 thanks"
    found = [text[a:b] for a, _, b in pii_crf.added_spans(model, [text], [[]])[0]]
    assert found == ["(030) 123-4567", "anna (at) example (dot) com", "4111.1111.1111.1111"]


def test_viterbi_is_best():
    import itertools
    r = np.random.default_rng(0)
    model = pii_crf.Crf({}, np.zeros((0, 9)), r.normal(size=(9, 9)))
    batch = [r.normal(size=(n, 9)) for n in (1, 4, 2, 3)]
    for unary, got in zip(batch, pii_crf.viterbi(model, batch)):
        def score(path, unary=unary):
            return sum(unary[t, y] + model.moves[path[t - 1] if t else 0, y] for t, y in enumerate(path))
        best = max(itertools.product(range(9), repeat=len(unary)), key=score)
        assert tuple(got) == best


def test_segments_give_the_whole_texts_labels():
    model = pii_crf.fit(steps=30)
    r = random.Random(8)
    for _ in range(200):
        words = [w for _ in range(3) for w in r.choice(pii_crf.labelled_table(60, seed=r.randrange(99)))[0]]
        words += ["plain"] * r.randint(0, 6) + ["555-123-4567"] * r.randint(0, 2)
        text = " ".join(words)
        whole = pii_crf.viterbi(model, [model.unary(words)])[0]
        tagged, at = {}, 0
        for w, t in zip(words, whole):
            at = text.index(w, at)
            tagged[at] = t
            at += len(w)
        parts = list(pii_crf._segments(text))
        unary = [model.unary([text[a:b] for a, b in part]) for part in parts]
        got = {a: t for part, tags in zip(parts, pii_crf.viterbi(model, unary)) for (a, _), t in zip(part, tags)}
        assert {a: t for a, t in tagged.items() if t} == {a: t for a, t in got.items() if t}


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.union(pages.selectExpr("page_id + 100000", "url", "html"))
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(twice).collect()}
    for p in pages.collect():
        data = p.html.encode()
        key = (len(data), hashlib.sha256(data).hexdigest())
        assert found[p.page_id] == (*key, "response", None)
        assert found[p.page_id + 100000] == (*key, *(("revisit", p.page_id) if len(data) >= 100 else ("response", None)))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    """Every kind of damage costs its own record alone; the gap is exact."""
    plain = [warc.record_bytes(i, "http://x/", b"<p>%d</p>" % i * 40, hashlib.sha256(b"<p>%d</p>" % i * 40).hexdigest(), None)
             for i in range(6)]
    blocks = [p.partition(b"\r\n\r\n")[2][:-4] for p in plain]
    parts = [warc.member(p) for p in plain] if packed else plain
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    r = random.Random(2)
    for damage in ("flip", "cut", "insert", "zero"):
        for _ in range(25):
            k = r.randrange(6)
            at = r.randrange(len(parts[k]))
            bad = bytearray(parts[k])
            if damage == "flip":
                bad[at] ^= 1 << r.randrange(8)
            elif damage == "cut":
                del bad[at:at + 20]
            elif damage == "insert":
                bad[at:at] = b"WARC/1.1\r\nnoise"
            else:
                bad[at:at + 9] = bytes(len(bad[at:at + 9]))
            data = b"".join([*parts[:k], bytes(bad), *parts[k + 1:]])
            items = list(warc.salvage(data))
            # the header of a plain record has no checksum, so records are told by their block
            ids = [blocks.index(x.block) if x.block in blocks else k for x in items if not isinstance(x, tuple)]
            assert [i for i in ids if i != k] == [i for i in range(6) if i != k]
            gaps = [x for x in items if isinstance(x, tuple)]
            if k not in ids:
                assert [(a, b) for a, b, _ in gaps] == [(starts[k], starts[k] + len(bad))] or not bad


def test_nearest(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in rows}
    found: dict = {}
    for r in run(spark, "op8_nn_descent").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in data if i % 100 == 0}
    hits = total = 0
    for q, got in found.items():
        near = sorted((float(np.sqrt(((data[q] - v) ** 2).sum())), i) for i, v in data.items() if i != q)[:10]
        assert [k for k, _, _ in sorted(got)] == list(range(1, 11))
        assert all(abs(s - float(np.sqrt(((data[q] - data[i]) ** 2).sum()))) < 1e-12 for _, i, s in got)
        hits += len({i for _, i in near} & {i for _, i, _ in got})
        total += 10
    assert hits >= 0.9 * total


def test_nearest_with_many_equal_vectors(spark):
    from pyspark.sql import functions as F
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [float(i), 1.0, -2.0]) for i in range(200, 260)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nn_descent.nearest(table, F.col("vec_id") % 50 == 0).where("query_id < 200").collect()
    for q in (0, 50, 100, 150):
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert got == [(k + 1, v, 0.0) for k, v in enumerate([i for i in range(12) if i != q][:10])]


def test_nearest_in_a_dense_cluster(spark):
    """Near copies whose differences are far below a hundredth of the components."""
    from pyspark.sql import functions as F
    r = np.random.default_rng(11)
    center = r.normal(size=16)
    data = np.concatenate([center + 1e-3 * r.normal(size=(2000, 16)), r.normal(size=(1000, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found: dict = {}
    for x in nn_descent.nearest(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    hits = 0
    for q, got in found.items():
        gaps = ((data - data[q]) ** 2).sum(1)
        hits += len(got & {int(i) for i in np.argsort(gaps)[1:11]})
    print("recall", hits / (10 * len(found)))
    assert hits >= 0.95 * 10 * len(found) and len(found) == 30


def test_crowded_cells_are_split_around_near_pivots(spark, monkeypatch):
    """Few pivots for many nodes, as above the bound on pivots: the nearest still meet, and no cell stays crowded."""
    monkeypatch.setattr(nn_descent, "CELL", 64)
    monkeypatch.setattr(nn_descent, "ROWS_PER_SPLIT", 32)
    monkeypatch.setattr(nn_descent, "CHUNK", 500)
    r = np.random.default_rng(12)
    data = r.normal(size=(3000, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    nodes = nn_descent.save(nn_descent.nodes_of(table, 11), "vectors")
    pivots = nn_descent._sample(nodes, 4)
    # every vector is in the one cell of all nodes
    one = nodes.selectExpr("0L AS cell", "node", "vector")
    levels = nn_descent._small_cells(nn_descent.save(one, "cells"))
    sizes = [x["count"] for level in levels for x in level.groupBy("cell").count().collect()]
    assert max(sizes) <= 64 and sum(sizes) == 3000
    graph = {x.node: set(x.ids[:10]) for x in nn_descent.build_graph(nodes, pivots).where("node % 50 = 0").collect()}
    hits = 0
    for q, got in graph.items():
        gaps = ((data - data[q]) ** 2).sum(1)
        hits += len(got & {int(i) for i in np.argsort(gaps)[1:11]})
    print("graph recall", hits / (10 * len(graph)))
    assert len(graph) == 60 and hits >= 0.95 * 600


def test_pivots_reach_the_driver_from_few_rows(spark):
    """The first nodes in hash order, though what the driver may take is less than so many rows of every task."""
    from pyspark.sql import functions as F
    r = np.random.default_rng(13)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(20000, 64)))],
                                  "vec_id long, embedding array<double>")
    nodes = nn_descent.nodes_of(table, 2).repartition(40).cache()
    lots = nodes.select("node", "vector", F.xxhash64("node", F.lit("pivot")).alias("lot")).collect()
    first = sorted(lots, key=lambda x: (x.lot, x.node))[:300]
    conf = spark.sparkContext._conf
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")
    try:
        names, places = nn_descent._sample(nodes, 300)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert names.tolist() == [x.node for x in first]
    assert (places == nn_descent._vectors([bytes(x.vector) for x in first])).all()
    # fewer nodes than asked for, and none
    assert sorted(nn_descent._sample(nodes.where("node % 500 = 0"), 300)[0].tolist()) == list(range(0, 20000, 500))
    assert len(nn_descent._sample(nodes.where("false"), 300)[0]) == 0
    nodes.unpersist()


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_classes_at_other_similarities(spark, percent):
    """Planted pairs just above and below the similarity asked for; lower ones are refused."""
    from paymatch.llm import near_dups
    rng = random.Random(percent)
    rows = []
    for k in range(150):
        words = [f"w{k}x{i}" for i in range(rng.randint(60, 160))]
        other = list(words)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = f"o{k}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other[:len(other) - rng.randint(0, 9)]))]
    sets = {i: shingles(t) for i, t in rows}
    expected = {}
    for k in range(150):
        a, b = sets[2 * k], sets[2 * k + 1]
        linked = 100 * len(a & b) >= percent * len(a | b)
        expected |= {2 * k: 2 * k, 2 * k + 1: 2 * k if linked else 2 * k + 1}
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert found == expected and 20 < sum(i != c for i, c in found.items()) < 150
    for refused in (60, 101):
        with pytest.raises(ValueError):
            near_dups.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string"), refused)


def plain_leak(doc, item):
    """Best stretch along any diagonal that shares a mask hit."""
    best, n = 0, len(item)
    for shift in range(-n + 1, len(doc)):
        on = [i for i in range(n) if 0 <= i + shift < len(doc)]
        hits = any(all(i + k in on and doc[i + k + shift] == item[i + k] for k in m)
                   for m in decontaminate.MASKS for i in on if i + m[-1] < n)
        if hits:
            now = 0
            for i in on:
                now = max(0, now + (1 if doc[i + shift] == item[i] else -decontaminate.PENALTY))
                best = max(best, now)
    return best


def test_substituted_passages(spark):
    r = random.Random(4)
    items = [[f"b{k}w{r.randrange(900)}" for _ in range(r.randint(12, 50))] for k in range(6)]
    docs = []
    for i in range(60):
        words = [f"d{r.randrange(5000)}" for _ in range(r.randint(5, 60))]
        if i % 2:
            part = list(r.choice(items))
            for _ in range(r.randint(0, 8)):
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(words))
            words[at:at] = part[r.randint(0, 5):]
        docs.append((i, " ".join(words)))
    found = {(x.doc_id, x.item_id): x.score for x in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w).upper()) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    expected = {}
    for i, text in docs:
        for k, item in enumerate(items):
            best = plain_leak(text.split(), item)
            if best >= min(decontaminate.LEAST, len(item)):
                expected[i, k] = best
    assert found == expected and len(found) > 10


def test_long_and_short_items_with_substitutions(spark):
    """A 400-word item scores whole; any item of 8 words or more is found with any one word substituted."""
    long = [f"L{i}" for i in range(400)]
    items = [(0, " ".join(long))] + [(n, " ".join(f"s{n}x{i}" for i in range(n))) for n in range(4, 20)]
    docs = [(0, "before " + " ".join(long) + " after")]
    whole, changed = {}, {}
    for n in range(4, 20):
        for gone in [None, *range(n)]:
            words = items[n - 3][1].split()
            if gone is not None:
                words[gone] = "other"
            key = len(docs)
            docs.append((key, f"w{key} v{key} " + " ".join(words) + f" u{key}"))
            (whole if gone is None else changed)[key] = n
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(
        frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found[0, 0] == 400
    assert {k for k in whole if (k, whole[k]) in found} == {k for k, n in whole.items() if n >= 5}
    assert {k for k, n in changed.items() if (k, n) in found} >= {k for k, n in changed.items() if n >= 8}
    assert not [k for k, n in changed.items() if (k, n) in found and n < 8]


def test_whole_tables_by_brute_force(spark, documents):
    """The registered query against every diagonal of every document and item that share five words in a row."""
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    starts = {}
    for k, words in items.items():
        for m in decontaminate.MASKS:
            for i in range(len(words) - m[-1]):
                starts.setdefault(tuple(words[i + j] for j in m) + (m,), []).append((k, i))
    expected = {}
    for row in documents:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (row.text or "").strip(" \t\n\x0b\x0c\r").lower())]
        diagonals = set()
        for at in range(len(words)):
            for m in decontaminate.MASKS:
                if at + m[-1] < len(words):
                    diagonals |= {(k, at - i) for k, i in starts.get(tuple(words[at + j] for j in m) + (m,), ())}
        for k, shift in diagonals:
            now = best = 0
            for i, w in enumerate(items[k]):
                if 0 <= i + shift < len(words):
                    now = max(0, now + (1 if words[i + shift] == w else -decontaminate.PENALTY))
                    best = max(best, now)
            if best >= min(decontaminate.LEAST, len(items[k]) - 3):
                expected[row.doc_id, k] = max(best, expected.get((row.doc_id, k), 0))
    found = {(r.doc_id, r.item_id): r.score for r in run(spark, "op9_decontaminate").collect()}
    assert found == expected and expected


def test_no_text_leaves_with_the_seeds(spark):
    """The exchange by seed holds no words, and the plan is one at every size."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    found = decontaminate.leaks(rows, spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(seed" in x and "words" in x]
    assert "ArrowEval" not in plan and "MapIn" not in plan and "Python" not in plan


def _rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.queries()["op10_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_every_part_of_a_long_text_counts():
    """Texts far beyond the compressor's window score like their parts, wherever these stand."""
    from paymatch.llm import quality
    r = random.Random(6)
    words = {v: [f"{v}{r.randrange(10 ** 6)}" for _ in range(3000)] for v in ("good", "bad")}
    text = lambda v, size: " ".join(r.choice(words[v]) for _ in range(size // 9)).encode()
    model = quality.Model(*(quality._dictionary([text(v, 2000) for _ in range(300)]) for v in ("good", "bad")), 1.0, 0.0)
    compressors = model.compressors()
    x = lambda t: quality._difference(compressors, t)
    good, bad = text("good", 4 << 20), text("bad", 4 << 20)
    for part in (good, bad):
        assert abs(x(part * 3) - x(part[:60_000])) < 0.2
    assert x(good) > 1 and x(bad) < -1
    assert abs(x(good + b" " + bad) - x(bad + b" " + good)) < 0.05
    assert x(good + b" " + bad * 3) < -0.5
    solid = b"x" * 200_000
    assert b"".join(quality._pieces(solid)) == solid and b"".join(quality._pieces(good)) == good
