"""Awkward inputs for every operator and stage: nulls in any column, empty and very
long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paymatch.llm import (decontaminate, licenses, line_dedup, mixing, near_dups, nn_descent, pii_crf, quality, sharding,
                          warc)
from paymatch.llm.store import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, " \
         "slot string, uses string, pattern string, removed string, pii string, digest string, label string"
LONG = " ".join(f"word{i}" for i in range(60_000))


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None, *["x"] * 10)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, "one two three four five six seven"), row(1, "one two three four five six seven"),
            row(2, None), row(3, ""), row(4, " \n\t \n"), row(5, LONG, "b"), row(6, LONG + " end", "b"),
            row(None, "one two three four five six seven"), row(None, None, None), row(7, "ONE two three four five six seven"),
            row(8, "short", None), row(9, "é ß \U0001f600   x"), row(10, "x" * 50_000, "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (6, None, 1), (None, 1, 0), (99, 1, 0), (7, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "three four five six seven"), (2, None), (3, ""), (4, "tiny"),
                                  (5, " ".join(f"word{i}" for i in range(1000, 1030)))], "item_id long, text string")


def test_near_duplicates(docs, empty):
    found = {}
    for r in near_dups.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert found[1] == [(3, 1, True)] * 2
    assert found[7] == [(3, 1, False)]
    assert found[2] == [(0, 2, True)] and found[3] == [(0, 3, True)] and found[4] == [(0, 4, True)]
    assert found[5][0][1:] == (5, True) and found[6][0][1:] == (5, False)
    assert sorted(found[None], key=str) == [(0, None, True), (3, 1, False)]
    assert near_dups.near_duplicates(empty).count() == 0


def test_keep_one(docs, empty):
    kept = near_dups.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 8, 9, 10]
    assert near_dups.keep_one(empty).count() == 0


def test_shards(docs, empty):
    rows = sharding.shards(docs, 3).collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r.size for r in rows if r.text is None} == {16}
    assert sharding.shards(empty, 3).count() == 0
    assert {"shard", "slot", "size", "score"} <= set(sharding.shards(empty, 3).columns)


def test_mix(docs, empty):
    rows = mixing.mix(docs, F.array("source")).collect()
    assert len(rows) == docs.count() and all(0 <= r.uses <= 3 for r in rows)
    again = mixing.mix(docs.repartition(5), F.array("source")).collect()
    assert sorted((str(r.doc_id), str(r.text), r.uses) for r in rows) == sorted(
        (str(r.doc_id), str(r.text), r.uses) for r in again)
    none = mixing.mix(docs, F.lit(None).cast("array<string>")).collect()
    assert {r.uses for r in none} == {0}
    assert mixing.mix(empty, F.array("source")).count() == 0
    assert mixing.repeated(empty).columns == empty.columns


def test_quality(docs, empty, labels):
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(empty, labels).count() == 0
    nothing = labels.where("false")
    assert {r.score for r in quality.scores(docs, nothing).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_lines(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].text is None and by[3].text == "" and by[4].text == " \n\t \n"
    assert by[5].text == LONG and by[6].text == LONG + " end"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_licenses(docs, empty):
    assert licenses.scan(docs).count() == 0
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs, templates=[("none", "word")]).count() == 0


def test_decontamination(docs, empty, benchmark):
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == {(1, 1), (7, 1), (None, 1), (5, 5), (6, 5)}
    left = decontaminate.drop_leaked(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["2", "3", "4", "8", "9", "10", "None"])
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.where("false")).count() == 0


def test_pii(spark, docs, empty):
    model = pii_crf.fit()
    rows = spark.createDataFrame([(1, "mail a.b@c.de now", "x"), (2, None, "y"), (3, "", None), (None, "+1 (403) 555-9312", "z"),
                                  (5, "1" * 30_000 + " 1.2.3.4", "w")], "doc_id long, text string, pii string")
    found = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.pii if s.base] for r in pii_crf.find(rows, model).collect()}
    assert found == {1: [("email", 5, 13)], 2: [], 3: [], None: [("phone", 0, 17)], 5: [("ip", 30_001, 30_008)]}
    assert pii_crf.find(docs, model).count() == docs.count()
    assert pii_crf.find(empty, model).count() == 0


def test_warc(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = spark.createDataFrame([(1, "http://a/ b\r\nc", page, 1), (2, None, page, 2), (2, None, page, 2), (None, "u", page, 3),
                                  (3, "", None, 4), (4, "v", "", 5), (5, "w", "WARC/1.1\r\nx\r\n\r\n", 6)],
                                 "page_id long, url string, html string, digest int")
    found = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(rows).collect())
    assert found == [("1", "response", None, 207), ("2", "revisit", 1, 207), ("2", "revisit", 1, 207),
                     ("3", "response", None, 0), ("4", "response", None, 0), ("5", "response", None, 15),
                     ("None", "revisit", 1, 207)]
    assert warc.round_trip(rows.where("false")).count() == 0
    nothing = new_path(spark, "nothing")
    assert warc.write_archives(rows.where("false"), nothing).count() == 0


def test_warc_large_ids_and_long_urls(spark):
    page = "<p>" + "x" * 200 + "</p>"
    ids = [10 ** 18, 2 ** 63 - 1, -2 ** 63, 7]
    rows = spark.createDataFrame([(i, "http://a/" + "u" * n, page + str(k // 2)) for k, (i, n) in
                                  enumerate(zip(ids, (1, 70_000, 200_000, 10)))], "page_id long, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(rows).collect()}
    assert found == {10 ** 18: ("response", None), 2 ** 63 - 1: ("revisit", 10 ** 18),
                     -2 ** 63: ("response", None), 7: ("revisit", -2 ** 63)}
    assert warc._number(str(2 ** 63)) is None


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [1.0, None], 1), (None, [1.0, 1.0], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1),
            (2, [0.0, 1.0], None), (100, [2.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nn_descent.nearest(table, F.col("vec_id") % 100 == 0).collect())
    assert found == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 2, 2.0 ** 0.5), (100, 1, 0, 1.0), (100, 2, 1, 1.0),
                     (100, 3, 2, 5.0 ** 0.5)]
    assert nn_descent.nearest(table.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_stages_take_awkward_rows(spark, docs, empty, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for given in (docs, empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given.select(plain), str(tmp_path))
            out.collect()
            assert out.columns[:5] == plain and (i == len(corpus_pipeline.STAGES) - 1 or out.columns == plain)


CLASHING = ["_id", "_n", "_key", "_chance", "_text_hash", "_kept", "_hash", "row", "id", "kept", "n", "hash", "_low", "_part", "p",
            "cut", "whole", "_members", "group", "weight", "_removed", "first", "place", "words", "seed", "at", "a.b"]


def test_no_column_name_clashes(spark, benchmark):
    """Columns that are called like the operators' own come back as they went in."""
    rows = [(i, "en", f"s{i % 3}", f"text {i // 2} " * 20, *[f"{c}{i}" for c in CLASHING]) for i in range(30)]
    schema = ", ".join(["doc_id long", "lang string", "source string", "text string", *[f"`{c}` string" for c in CLASHING]])
    docs = spark.createDataFrame(rows, schema)
    for out in (near_dups.keep_one(docs), sharding.shards(docs, 3), mixing.mix(docs, F.array("source")), mixing.repeated(docs),
                line_dedup.dedup_lines(docs), decontaminate.drop_leaked(docs, benchmark)):
        found = out.collect()
        assert set(docs.columns) <= set(out.columns) and found
        for r in found:
            assert [r[c] for c in CLASHING] == [f"{c}{r.doc_id}" for c in CLASHING]


def test_a_label_repeated_very_often_is_one_text(spark):
    """Neither repeated documents nor long ones send more than the bound to the driver."""
    rows = [(1, "good words here", 0)] * 3000 + [(i, f"bad {i}" * 50, 0) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, 1)] * 500 + [(i, i % 2) for i in range(2, 40)], "doc_id long, quality int")
    taken = quality._sample(docs, labels)
    assert len(taken[0]) + len(taken[1]) <= 39
    assert all(0 <= r.score <= 1 for r in quality.scores(docs, labels).collect())
    before = quality.LABEL_BYTES
    quality.LABEL_BYTES = 1000
    try:
        assert sum(len(t) for v in (0, 1) for t in quality._sample(docs, labels)[v]) <= 2000
    finally:
        quality.LABEL_BYTES = before


def _archive(n, **change):
    """``n`` records in one member, the payload of record ``k`` damaged where ``change`` says."""
    out = b""
    for k in range(n):
        block = (f"payload {k} " + "x" * 50 * k).encode()
        import hashlib
        digest = hashlib.sha256(block).hexdigest()
        if k == change.get("bad"):
            block = block.replace(b"p", b"q", 1)
        out += (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Block-Digest: sha256:{digest}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    return out


def _salvaged(data):
    found = list(warc.salvage(data))
    return ([f.fields["warc-record-id"] for f in found if isinstance(f, warc.Record)],
            [f for f in found if not isinstance(f, warc.Record)])


def test_salvage_inside_a_member_of_many_records():
    import gzip
    ids = [f"<urn:{k}>" for k in range(5)]
    plain = _archive(5)
    assert _salvaged(gzip.compress(plain)) == (ids, [])
    # a record that fails its digest costs itself alone
    packed = gzip.compress(_archive(5, bad=2)) + gzip.compress(plain)
    records, gaps = _salvaged(packed)
    assert records == ids[:2] + ids[3:] + ids and len(gaps) == 1 and "unpacked bytes" in gaps[0][2]
    # compressed bytes that are damaged or cut off: what stands before is kept, and so are the next members
    whole = gzip.compress(_archive(400))
    for broken in (whole[:len(whole) // 2], whole[:len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40:],
                   whole[:-8] + b"12345678"):
        records, gaps = _salvaged(broken + gzip.compress(plain))
        assert records[-5:] == ids and len(records) >= 100 and records[:100] == [f"<urn:{k}>" for k in range(100)]
        assert gaps or records == [f"<urn:{k}>" for k in range(400)] + ids


def test_shapes_read_whole_words():
    """Evidence and digits beyond the first 80 characters of a word count."""
    assert pii_crf.shape("x" * 200) == "plain"
    assert pii_crf.shape("x" * 200 + "@mail.com") == pii_crf.shape("x@mail.com")
    assert pii_crf.shape("x" * 200 + "12345").endswith(":5/5")
    assert pii_crf.shape("a-" * 200 + "7") == "long:1/1"
