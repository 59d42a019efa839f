"""Rows that every operator on documents must handle, and small helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, start long, fp long, score double, key string"

ODD = [
    None, "", " ", "\n\n\t", "a", "one two", "x" * 5000, "<|endoftext|> and a <|endoftext|>  b<|startoftext|>c", "\x1cweird\x1d white\x85space\xa0here and 　there",
    "don't you'll we've I'M naïve Ünïcode ΣΑΣ ﬁ ½ ² Ⅷ 中文字 \U0001f600 12345 3.14!!", "tabs\tand\r\nlines\x0b\x0cfeeds", "ab  cd   ef    gh", "é ́x q̣̇",
]


def texts(seed: int, n: int, copies: int = 4) -> list[str]:
    """Invented prose with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    syllables = "th he in er an re on at en nd ti es or te of ed is it al ar".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.3:
            words.insert(rng.randint(0, len(words)), rng.choice(shared))
        out.append(" ".join(words))
    for _ in range(copies):
        text = rng.choice(out)
        out += [text] * 3
        words = text.split()
        words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    rng.shuffle(out)
    return out


def rows(seed: int = 1, n: int = 40, odd: bool = True) -> list[tuple]:
    found = texts(seed, n) + (ODD + ODD if odd else [])
    made = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], len(t or ""), i, "r", 1, 2, 0.5, "k") for i, t in enumerate(found)]
    if odd:  # repeated rows, no id, no anything
        made += [made[0], made[0], (None, found[1], "en", "a", 1, 1, "r", 1, 2, 0.5, "k"), (None,) * 11]
    return made


def frame(spark, made: list[tuple]):
    return spark.createDataFrame(made, SCHEMA)
