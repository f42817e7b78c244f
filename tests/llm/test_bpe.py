import base64

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from txnweave.llm.bpe import Merges
from txnweave.llm.common import string_parts
from txnweave.llm.pretokens import Dictionary, encode_rows

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
MERGES = Merges(RAW)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(texts):
    data, offsets = string_parts(pa.array(texts, pa.string()))
    out = []
    for i, j, ids, ends in encode_rows(data, offsets, Dictionary(MERGES.encode)):
        out += [ids[ends[r] : ends[r + 1]].tolist() for r in range(j - i)]
    return out


TEXTS = ["", None, "a", "  x", "x  ", " \n\n y\t z", "it's they'll we'Re I'd've 'tis ''s !'s", "'", "a'", "'ll", "don't\n'm", "12 34a१२ é́", " x 　y", "aaaaaaa" * 50, "😀😀 text<|endoftext|>", "\r\n \r\n", "x" * 5000]


def test_same_ids_as_the_library():
    assert encoded(TEXTS) == [LIBRARY.encode_ordinary(x or "") for x in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t'sStrevmld.!aé1 ", max_size=40)), max_size=6))
def test_any_text(texts):
    assert encoded(texts) == [LIBRARY.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("text", ["aabaabaab", "thethethe", "ing ing", "   "])
def test_replay_keeps_ties_in_order(text):
    piece = text.encode()
    assert MERGES.replay([piece, piece])[0] == MERGES.replay([piece])[0]
    assert b"".join(MERGES.tokens[i] for i in MERGES.replay([piece])[0]) == piece


def test_pieces_follow_the_pattern():
    assert regex.findall(P.PATTERN, "it's  a")[1] == "'s"
