"""Encoding and decoding against the sentencepiece library, and the normaliser against its compiled maps."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from paymatch.llm import pieces, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [*"abe \n\tAéß▁⁇", "<s>", "</s>", "<0x0A>", "😀", "\0", "中", "   ", "the ", "▁▁", "​", "﻿", "a" * 100]
LONG = ["", " ", "  ", "▁", "a" * 5000, "ab" * 3000, "1234567890" * 500, "é" * 3000, " " * 500, "x" * 70 + "中" * 80,
        "lorem" * 1000, "word " * 40_000]


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def mixed(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + LONG


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_query(spark):
    found = {r.doc_id: tuple(r)[1:4] for r in queries.queries()["op13_pieces"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_bos=True, add_eos=True)
        assert found.pop(r.doc_id) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(LIBRARY.decode(ids).encode()))
    assert not found


def test_ids_spans_and_texts(model):
    for text in mixed(1500):
        proto = LIBRARY.encode(text, return_type="proto").pieces
        ids, spans = model.encode(text)
        assert ids.tolist() == [p.id for p in proto]
        assert spans.tolist() == [[p.begin, p.end] for p in proto]
        assert model.decode(ids) == LIBRARY.decode(ids.tolist())


def test_any_ids_decode_alike(model):
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), 0, 1, 2, model.ids["▁"]])
               for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.uint32)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("dummy,squeeze,escape", [(False, False, True), (True, True, True), (False, True, False), (True, False, False)])
def test_compiled_character_maps(rule, dummy, squeeze, escape):
    """Texts and source offsets by the longest prefixes of the library's own maps."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze,
                                                    escape_whitespaces=escape)
    spec = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
    own = object.__new__(pieces.Model)
    own.map = pieces.CharacterMap(spec.get(2, b""))
    own.dummy, own.squeeze, own.escape, own.suffix = dummy, squeeze, escape, False
    for text in [*mixed(200)[:-1], "ﬁ ＡＢ　ｃ  ①½ … é 가 ", "①", "  ﬀ  x  ", " a", "ｶﾞｷﾞ"]:
        normal, offsets = library.normalize(text, with_offsets=True)
        found, starts = own.normalize(text)
        assert found == normal
        raw = text.encode()
        assert [len(raw[:s].decode()) for s in starts] == list(offsets)


def test_awkward_rows(spark, model):
    rows = [(1, None, "a", 1), (1, "", "b", 2), (1, "", "b", 2), (None, "x" * 100_000, None, 3), (2, "A b\nc", "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = pieces.encode(docs, model, ["doc_id", "decoded", "ids"], arrays=True).collect()
    assert sorted(r.decoded for r in found) == [1, 2, 2, 3, 4]
    assert [r.ids for r in found if r.decoded < 3] == [[1, 2]] * 3 and found[0].spans == [0, 0, 0, 0]
    last = next(r for r in found if r.decoded == 4)
    assert [b"A b\nc"[a:b] for a, b in zip(last.spans[::2], last.spans[1::2])][1:-1] == [b"A", b" b", b"\n", b"c"]
    packed = pieces.encode(docs, model, ["doc_id"], ends=False)
    texts = pieces.decode(packed, model, ["doc_id"]).collect()
    assert sorted(r.decoded for r in texts) == sorted((r[1] or "") for r in rows)
    assert pieces.encode(docs.where("false"), model, ["doc_id"]).count() == 0
    assert pieces.decode(packed.where("false"), model, ["doc_id"]).count() == 0
