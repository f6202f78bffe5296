import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.tokens import Encoder, split_long, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    pick = random.Random(4)
    pieces = ["word", " ", "  ", "\n", "\t", "é", "ñ's", "'ll", "don't", "42", "!!", "<|endoftext|>", "<|", "中文", "　", "\xa0", "\x1c", "\x85", "😀", "Ünïcode", ".", "\r\n", "ǅ", "½", "²"]
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 40))) for _ in range(400)] + [None, "", " ", "  a", "x" * 5000, "word " * 60000, "a" + " " * 300 + "b"]


def test_counts_as_the_library_gives_them(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "a b", 1), (1, texts[1], 2)], "doc_id long, text string, n_tokens int")
    got = token_counts(docs, PATH).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts)]
    want += [(None, 3, 2, False), want[1]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_ranks_are_the_library():
    encoder = Encoder.get("byte_bpe_50k.json", open(PATH, "rb").read())
    assert encoder.splits and encoder.ranked is not None
    settled = ["".join(c + x + c for x in ["", "a", " ", "1", "!"]) + " " + c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2027), 0x20AC])]
    texts = [t or "" for t in odd_texts()] + settled
    library = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.ids(texts) == library


@pytest.mark.parametrize("limit", [1, 5, 17])
def test_borders_are_safe(limit):
    library = Tokenizer.from_file(PATH)
    for text in odd_texts()[:200]:
        parts = split_long(text, limit)
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode(p).ids] == library.encode(text).ids


def test_other_libraries(spark):
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    n = len(sentencepiece.SentencePieceProcessor(model_file=model).encode("Hello there, world"))
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, model).collect()} == {1: n, 2: 0}
    words = public_tokenizers.path("word_bpe_49k.json")
    n = len(Tokenizer.from_file(words).encode("Hello there, world", add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, words).collect()} == {1: n, 2: 0}
