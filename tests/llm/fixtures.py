"""Small inputs for the text operators: nulls, empty and long texts, ties, repeats, odd columns."""

import random

WORDS = "river stone cloud maple window candle garden silver mountain paper orange winter bridge lantern meadow".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    out = []
    for i in range(n):
        w = draw.choice(WORDS) + draw.choice(["", "s", "ing", "ed", "er", str(draw.randint(0, 99))])
        out.append(w.capitalize() + "." if i % 11 == 10 else w)
    return " ".join(out)


def odd_rows():
    """(doc_id, text, lang, source, n_chars) with every corner at once."""
    long = prose(1, 4000)
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, prose(2, 60)), (6, prose(2, 60)), (7, long),
        (8, long + " tail"), (None, prose(3, 80)), (None, prose(3, 80)), (9, prose(4, 90)), (9, prose(4, 90)),
        (10, "!!! ??? ###"), (11, "中文字符测试 " * 30), (12, "z" * 3000), (13, "\U0001f600 é́   x"),
        (14, prose(5, 200) + "\n" + prose(5, 200)), (15, "Is Is Is " * 300),
    ]
    return [(i, t, None if k % 5 == 0 else ["en", "de"][k % 2], None if k % 7 == 0 else "s", k) for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_labels(spark):
    rows = [(5, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None), (9, 0, 1), (14, 1, 0), (999, 1, 1), (11, 0, 1), (12, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


def clashing(df):
    """More columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("score", "held_out", "kept", "n_words", "d1", "node", "matches", "label", "ids", "spans", "class_id", "tox_score")
    return df.select("*", *[F.lit(7).alias(n) for n in names])


def rows(df):
    """Rows as a sorted list of plain tuples, columns by name."""
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
