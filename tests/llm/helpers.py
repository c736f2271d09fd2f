"""Small inputs with what operators must stand: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

WORDS = "amber birch cedar dune ember fjord grove heath islet jetty knoll larch marsh north ocean plain quarry ridge stone tarn".split()


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def awkward(spark, texts=None):
    """documents with extra columns whose names operators use themselves."""
    rows = [(1, text(1, 40)), (2, None), (3, ""), (4, "   \n\t"), (5, text(1, 40)), (None, text(2, 30)), (None, None), (1, text(1, 40)), (6, text(3, 60_000)), (7, "é😀 ﬁ\u2028x")]
    rows += list(texts or [])
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0, 0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, part long, n long, key string")


def empty(spark):
    return awkward(spark).limit(0)
