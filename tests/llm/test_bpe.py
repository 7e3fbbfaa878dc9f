import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.llm.bpe import ByteBpe, bpe_encode, load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = load_ranks(open(PATH, "rb").read())
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WHOLE = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=RANKS, special_tokens={})
BPE = ByteBpe(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab", max_size=60), st.text("theraonis éß", max_size=60), st.text(max_size=40)))
def test_pieces_equal_the_library(text):
    piece = text.encode()
    if piece:
        assert BPE.encode_piece(piece) == WHOLE.encode_ordinary(text)


def test_long_piece_is_not_quadratic():
    piece = b"abcde" * 40_000
    began = time.time()
    ids = BPE.encode_piece(piece)
    assert time.time() - began < 20
    assert BPE.decode(ids) == piece


@pytest.mark.parametrize("extra", [False, True])
def test_rows(spark, extra):
    texts = [None, "", "Hello  world\n\n it's 42!!", "éàü ß 中文 \U0001f600", "x" * 5000, "Hello  world\n\n it's 42!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    if extra:
        df = df.selectExpr("*", "1 as n_tokens", "'q' as ids_sha256")
    rows = {r.doc_id: r for r in bpe_encode(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = ENCODING.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
