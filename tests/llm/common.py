"""Documents with every odd case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string, row string, h int, size double"


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(vocabulary)] + ["the", "of", "and", "to", "in"] * 20
    return " ".join(rng.choice(words) for _ in range(n))


def odd_documents(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns named as the operators' own."""
    base = prose(300, 1)
    near = base.replace(base.split()[50], "changed")
    texts = [None, "", " \t\n ", "one", "one two", "One TWO", base, base, near, prose(9000, 2, 4000), "a\nb\n\na\n a ", "é ü ñ " * 30, "x" * 20000, " ".join([prose(40, 3)] * 12), prose(60, 4) + "\n" + base, "word " * 100]
    rows = [(i, t, ["en", None, "de", "xx"][i % 4], [None, "b", "a", "é"][i % 4], "clash", None, "r", 1, 2.0) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
