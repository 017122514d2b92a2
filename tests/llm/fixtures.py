"""Small tables with the cases that every operator must handle."""

from __future__ import annotations

import random


def words(r: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{r.randrange(size)}" for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, repeated rows, nulls, blanks, long and odd texts."""
    r = random.Random(seed)
    texts: list[str | None] = []
    for _ in range(30):
        texts.append(" ".join(words(r, r.randint(1, 150))))
    base = words(r, 120, 10_000)
    texts += [" ".join(base)] * 4
    for k in range(8):
        near = list(base)
        for _ in range(k):
            near[r.randrange(len(near))] = f"n{r.randrange(1000)}"
        texts.append(" ".join(near))
    passage = " ".join(words(r, 45, 10_000))
    for _ in range(5):
        texts.append(f"{' '.join(words(r, 20))}\n{passage}  {' '.join(words(r, 20))}")
    own = " ".join(words(r, 40, 10_000))
    texts += [f"{own} x {own}", "a " * 200, "Été çà là, tout  va\tbien!\n\nEt alors?\n", "   \n\t ", "", None, "one", "one two three", "one two three", "漢字 🎉 ß İ K", "line\nline\nLine\nline ", "x" * 5000]
    texts.append(" ".join(words(r, 8000)))
    out = list(enumerate(texts))
    out.append(out[3])  # a repeated row
    return out


def documents(spark, data=None):
    """With more columns than asked for, some with names that operators use inside."""
    data = rows() if data is None else data
    full = [(i, t, "en" if i is not None and i % 3 else None, "src0", len(t) if t is not None else None, 1, "k", 2.0) for i, t in data]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, shard int, kind string, seed double")


def empty(spark):
    return documents(spark, [])
