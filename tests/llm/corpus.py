"""Small corpora for the tests: planted cases and awkward rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(seed=0, n=60):
    """Random texts with exact copies, near copies, shared passages and periodic texts."""
    rng = random.Random(seed)
    passage, rows = words(rng, 45), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            text = f"{words(rng, rng.randrange(5))} {passage} {words(rng, rng.randrange(30))}"
        elif kind == 3 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 4:
            text = " ".join([words(rng, rng.randrange(1, 7))] * rng.randrange(1, 12))
        else:
            text = words(rng, rng.randrange(0, 80))
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    return rows


AWKWARD = [
    (None, "a null id with some words in it", None, None, None),
    (1000, None, "en", "s", None),
    (1001, "", "en", "s", 0),
    (1002, "   \n\t ", "en", "s", 6),
    (1003, "one", None, "s", 3),
    (1003, "one", None, "s", 3),
    (1004, "é ▁ 漢字 😀\x00   end", "fr", "s", 10),
    (1005, "long " * 30000, "en", "s", 150000),
    (1006, "x" * 100000, "en", "s", 100000),
    (1007, "!!! ... 123 %% \\u00 +", "en", "s", 9),
]
