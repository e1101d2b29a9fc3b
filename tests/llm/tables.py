"""Awkward tables and plain helpers for the tests of this folder."""

import random

# Names that operators use inside, as extra columns.
CLASHES = (
    "lang string, source string, n_chars long, fp long, row long, key string, block int, root long, keys binary, "
    "packed binary, body binary, score double, held_out string, n_tokens long, posterior string, rate string, copies string, "
    "length long, piece int, `start` long, sequence_id long, spans string, _base string, term string, kind int, features string"
)
WIDTH = CLASHES.count(",") + 1

EDGES = [
    (None, "alpha beta gamma delta"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "alpha beta gamma delta"),
    (4, "alpha beta gamma delta"),
    (5, "alpha beta gamma delta"),
    (6, "ALPHA  beta x\ngamma ퟿ \x1c delta \U0001f600"),
    (7, "word " * 30_000),
    (8, "x" * 60_000),
    (9, "1 " * 20_000 + "a@" * 5_000),
]


def docs(spark, rows):
    filled = [(*r, *[None] * WIDTH) for r in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, {CLASHES}")


def words(count, vocabulary, seed):
    pick = random.Random(seed)
    return [f"w{pick.randrange(vocabulary)}" for _ in range(count)]


def components(ids, linked):
    """Smallest member of the component of each of ``ids``."""
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(ids)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}
