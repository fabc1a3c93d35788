"""Small document tables with every awkward case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def corpus(seed: int = 7, n: int = 120) -> list[tuple]:
    """Copies, edited copies, shared passages, nulls, empty, blank, one-word and very long texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 45))
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append(" ".join(words(rng, rng.randint(5, 150))))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            ws = rng.choice(texts).split(" ")
            ws[rng.randrange(len(ws))] = "edit"
            texts.append(" ".join(ws))
        elif kind == 3:
            texts.append(" ".join(words(rng, 30)) + "\n" + passage + " " + " ".join(words(rng, 20)))
        elif kind == 4:
            texts.append(" ".join(words(rng, rng.randint(1, 4))))
        else:
            texts.append("  " + "\t".join(words(rng, 60)).upper() + "\r\n")
    texts[3:3] = ["", None, " \n", None, "", "x", "la la " * 300, " ", " ".join(words(rng, 9000))]
    return [(i * 3 + 1, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"src{0 if i % 3 == 0 else i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows=None, n: int = 120):
    return spark.createDataFrame(corpus(n=n) if rows is None else rows, DOCS)
