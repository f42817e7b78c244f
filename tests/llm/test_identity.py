"""Identity is by content: hashes only find candidates, and words made to collide are told apart."""

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from txnweave.llm import bpe, common, decontaminate, lattice_lm, minhash, token_files
from txnweave.llm.common import new_path, string_parts
from txnweave.llm.pretokens import Dictionary, encode_rows

from .test_bpe import LIBRARY, MERGES, TEXTS
from .test_operators import plain_components, plain_hits, same

MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
OTHER = MORSE.translate({97: 98, 98: 97})
#: Pairs that a polynomial hash modulo 2^64 can't tell apart, whatever its base.
PAIRS = [(MORSE[:n], OTHER[:n]) for n in (1024, 4096)]
LINES = [f"{a} {b} {a} tail" for a, b in PAIRS] + [f"{b} {a} {b} tail" for a, b in PAIRS] + [a for a, _ in PAIRS] + [b for _, b in PAIRS]


@pytest.fixture
def colliding(monkeypatch):
    """All words of one length have one hash."""
    monkeypatch.setattr(common, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))


def spans(words):
    data, offsets = string_parts(pa.array(words, pa.binary()))
    return data, offsets[:-1], offsets[1:]


WORDS = [b"ab", b"cd", b"ab", b"", b"abcdefghij", b"abcdefghik", b"cd", b"ef", b"x" * 300, b"x" * 299 + b"y", b"x" * 300, b""]


def test_distinct_spans(colliding):
    keys, first, inverse = common.distinct_spans(*spans(WORDS))
    assert [WORDS[first[i]] for i in inverse] == WORDS and len(keys) == len(first) == len(set(WORDS))


def test_word_table(colliding):
    known = [*dict.fromkeys(WORDS[:-3]), b"zz"]
    table = common.WordTable(known)
    asked = [*known, b"gh", b"abcdefghil", b"x" * 298 + b"yy"]
    assert table.find(*spans(asked)).tolist() == [*range(len(known)), -1, -1, -1]
    assert common.WordTable([]).find(*spans(asked)).tolist() == [-1] * len(asked)


def test_dictionary(colliding):
    words = Dictionary(MERGES.encode)
    for _ in range(2):
        data, offsets = string_parts(pa.array([*TEXTS, *LINES], pa.string()))
        got = [ids[ends[r] : ends[r + 1]].tolist() for i, j, ids, ends in encode_rows(data, offsets, words) for r in range(j - i)]
        assert got == [LIBRARY.encode_ordinary(x or "") for x in [*TEXTS, *LINES]]


def test_hashes_differ():
    h = common.span_hashes(*spans([x.encode() for pair in PAIRS for x in pair] + [b"a", b"a\0", b"\0a", b"", b"\0", *[bytes([i]) * 9 for i in range(256)]]))
    assert len(set(h.tolist())) == len(h)


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "doc_id long, text string")


def test_encoders(spark, lines):
    got = {r.doc_id: r.ids for r in bpe.encode(spark, lines, carry=["doc_id"]).collect()}
    assert got == {i: LIBRARY.encode_ordinary(x) for i, x in enumerate(LINES)}
    out = new_path(spark, "tokens")
    token_files.write_token_files(spark, lines, out)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found = {r.doc_id: r.ids for r in token_files.find_documents(spark, out, [*range(len(LINES))]).collect()}
    assert found == {i: [*library.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(LINES)}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, lines, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    items = [(1, f"{PAIRS[0][0]} {PAIRS[0][1]}"), (2, PAIRS[1][0])]
    got = decontaminate.contamination(spark, lines, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    same(got, plain_hits([*enumerate(LINES)], items))


def test_near_duplicates(spark, lines):
    same(minhash.near_duplicates(spark, lines, shingle=4).collect(), plain_components([*enumerate(LINES)]))


def test_word_counts(spark, lines):
    counts = {r.word.decode(): r.c for r in lattice_lm.count_words(spark, lines, "text").collect()}
    assert counts == {x: " ".join(LINES).split().count(x) for x in " ".join(LINES).split()}
