"""Small tables with the odd rows that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that bear the names of the operators' own intermediate columns.
CLASHES = "doc_id long, text string, key string, rep string, bucket string, range string, kept string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") * rng.randint(1, 2) + str(
        rng.randint(0, 30)).translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(n))


def odd_documents(spark):
    base = words(300, 1)
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, "en"), (4, "", None),
        (5, "   \n\t ", "de"), (6, "one", None), (7, base.replace(" ", "\n") + " more", "de"),
        (8, words(60, 2), None), (9, words(60, 2) + " x " + words(55, 3), "fr"), (None, words(80, 4), "en"),
        (10, words(40_000, 5), "en"), (11, "12 34 !?", "de"), (12, words(20, 6) + " " + words(60, 2), "fr"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def clashing(spark):
    return spark.createDataFrame(
        [(i, words(70, i % 3), *"abcde") for i in range(6)], CLASHES)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
