"""Encoding against the tokenizers library, whole texts, with leaves so short that every way of cutting is used."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rnd = random.Random(3)
    soup = "".join(rnd.choice(["a", "b ", "é", " ", "\n", "'s", "12", "!?", "<|endoftext|>", "漢字", "\t", "don't", "\x1c", "😀", "ſ"]) for _ in range(3000))
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000))
    return [
        None, "", "hello", soup, word, " " * 3000 + "x", "\n" * 700, "!" * 2000 + "'s" + "?" * 2000, "a" * 5000, "漢" * 900, "<|endoftext|>" * 30,
        "word " * 2000, word + " " + word[::-1] + "9" * 1500, "é" * 1000 + "'ll" * 500, "x1" * 1200, soup[:200],
    ]


@pytest.mark.parametrize("leaf", [40, 1000, bpe.LEAF])
def test_ids_equal_the_library_and_decode_back(spark, leaf):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    rows += [(3, rows[3][1], "x"), (None, rows[4][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, RANKS, leaf=leaf, decoded=leaf > 500)
    out = (bpe.decode(encoded, RANKS) if leaf <= 500 else encoded).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], dtype="<u4").tolist(), r["decoded"]) for r in out)
    want = []
    for i, t, _ in rows:
        ids = TOKENIZER.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, ids, TOKENIZER.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_leaves_hold_the_text_and_windows_join_any_halves():
    with open(RANKS, "rb") as f:
        enc = bpe.encoding(f.read(), bpe.SPECIAL)
    for t in filter(None, texts()):
        found = list(bpe.leaves(t, 50, bpe.SPECIAL))
        assert "".join(x for _, x in found) == t
        for window in (60, 400):
            assert "".join(x for _, x in bpe.unsplit(t, 50, window)) == t
    rnd = random.Random(1)
    for _ in range(300):
        piece = "".join(rnd.choice("abehinorst") for _ in range(rnd.randint(2, 60)))
        at = rnd.randint(1, len(piece) - 1)
        a, b = enc._encode_single_piece(piece[:at]), enc._encode_single_piece(piece[at:])
        assert bpe.join_encodings(enc, a, b, 1) == enc._encode_single_piece(piece)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, RANKS), RANKS).count() == 0
