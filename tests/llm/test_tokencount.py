import random

import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import tokencount
from tests.llm.cases import ODD, frame, rows


def count(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_chunks_count_as_the_library_does():
    rng = random.Random(4)
    parts = ["the", "The", "'s", "n't", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "　", "\x85", "\x1c", "é", "中", "½", "²", "12", ".", "!?", "<|endoftext|>", "<|endof", "_", "\U0001f600"]
    lengths = tokencount.Lengths("byte_bpe_50k.json", {}, 200)
    assert lengths.splits
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert lengths.count(text) == count(lengths.tokenizer, text), repr(text)


def test_other_tokenizers_take_whole_texts():
    lengths = tokencount.Lengths("word_bpe_49k.json", {}, 200)
    for text in ODD:
        assert lengths.count(text or "") == count(lengths.tokenizer, text)


def test_every_row(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = rows(3, 50)
    want = sorted(((m[0], len((m[1] or "").encode()), n := count(tokenizer, m[1]), n > 100) for m in made), key=str)
    for options in ({}, {"top": 3, "tracked": 10, "cached": 20}):
        got = tokencount.token_counts(frame(spark, made).repartition(3), limit=100, **options).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty(spark):
    assert tokencount.token_counts(frame(spark, [])).collect() == []
    got = tokencount.token_counts(frame(spark, [(1, None) + (None,) * 9])).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, False)]
