import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm.bpe import Codec, encode_documents, read_ranks

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = read_ranks(open(RANK_FILE, "rb").read())
WHOLE = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = Codec(RANKS, public_tokenizers.PATTERN, leaf=3, window=2)
USUAL = Codec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'lsverd \n\t　é漢0 9.-$\U0001f600́")), max_size=90))
def test_tree_equals_the_library(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", "ab'll", "é漢", "thaner", " ", "\n ", "x'", "=-", "0123", "漢字", "ǆ"])
def test_long_runs(unit):
    random.seed(1)
    text = "so " + unit * (40000 // len(unit)) + "end '" + "".join(random.choice("thaneriou") for _ in range(20000))
    ids = USUAL.encode(text)
    assert ids == WHOLE.encode_ordinary(text) and USUAL.decode(ids) == text.encode()
    for at in (7, 20000, 40003):
        left, right = text[:at], text[at:]
        assert USUAL.join(left, WHOLE.encode_ordinary(left), right, WHOLE.encode_ordinary(right)) == ids


def test_documents(spark):
    rows = [(1, "It's <|endoftext|> \n\n  done" * 200, "x"), (2, None, "y"), (3, "", "z"), (1, "a", None), (None, "b", None)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), RANK_FILE, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == 5
    for r, (i, text, _) in zip(got, rows, strict=True):
        ids = WHOLE.encode_ordinary(text or "")
        packed = b"".join(t.to_bytes(4, "little") for t in ids)
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANK_FILE, public_tokenizers.PATTERN).count() == 0
