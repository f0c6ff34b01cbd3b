"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlink.llm import lexicon as lx
from ledgerlink.llm import packing, registry
from ledgerlink.llm import word_bpe as wb

TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, it's I'LL don't 123 ½² a b \x1c\x1d x\x85y ΑΣ ΣΑΣ. <|endoftext|> <|startoftext|>a<|x İstanbul é ñ 中文字 🎉 a",
    "A" * 200 + " " + "ab" * 40,
    "!!!???...'s's 'S foo_bar--baz@x.com/123?x=1",
    "\x00\x07 \x7f \xadsoft ÀÉÎ ªº µ ß ÿÞ×÷ á",
    "the of and the of and thouinor thshtiti " * 40,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(wb.default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], 7), (None, "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long")


def want_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_encode_and_decode_equal_the_library(spark, docs, library, with_lexicon):
    name = wb.compile_lexicon(docs, size=5) if with_lexicon else None
    encoded = wb.encode(docs, lexicon=name)
    rows = docs.collect()
    want = sorted(((r.doc_id, want_ids(library, r.text)) for r in rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=repr) == want
    back = sorted(map(tuple, wb.decode(encoded).collect()), key=repr)
    assert back == sorted(((i, library.decode(x, skip_special_tokens=False)) for i, x in want), key=repr)


def test_registered_query_on_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, registry.QUERIES["op7_bpe_lexicon"](spark, sf).collect()))
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = want_ids(library, r.text)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_packing_is_a_partition_without_padding(spark, docs, library):
    packed = [r for r in registry.piece_digests(packing.pack(docs, limit=16)).collect()]
    assert len({r.sequence_id for r in packed}) == len(packed)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 16 and r.offset == 0 and 1 << r.bucket == r.length for r in packed)
    got = sorted(((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in packed), key=repr)
    want = []
    for r in docs.collect():
        ids = want_ids(library, r.text) + [1]
        at = 0
        while at < len(ids):
            n = min(16, 1 << (len(ids) - at).bit_length() - 1)
            want.append((r.doc_id, at, n, len(ids), zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert got == sorted(want, key=repr)


def test_lexicon_knows_exactly_its_words(tmp_path):
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    ids = [[rng.randrange(9) for _ in range(rng.randint(1, 4))] for _ in words]
    (tmp_path / "x").write_bytes(lx.build(words, ids))
    lex = lx.Lexicon(str(tmp_path / "x"))
    assert lex.ranks(words).tolist() == list(range(len(words)))
    others = [w + b"a" for w in words if w + b"a" not in set(words)] + [b"", b"zz"]
    assert set(lex.ranks(others).tolist()) == {-1}
    flat, n = lex.outputs(np.arange(len(words)))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == ids
    assert len(lex.final) < sum(map(len, words)) / 2  # suffixes are shared
    (tmp_path / "y").write_bytes(lx.build([], []))
    assert lx.Lexicon(str(tmp_path / "y")).ranks([b"a"]).tolist() == [-1]


def test_very_long_text_in_segments(library):
    text = " ".join(t for t in TEXTS if t) * 5
    found = list(wb.id_lists(wb.Encoder(wb.Vocabulary(wb.default_vocabulary())), [b"a", text.encode(), b"b"], run_bytes=100))
    assert [n.tolist() for _, _, n in found] == [[1], [len(want_ids(library, text))], [1]]
    assert found[1][1].tolist() == want_ids(library, text)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert wb.encode(none, lexicon=wb.compile_lexicon(none)).count() == 0
    assert packing.pack(none).count() == 0
