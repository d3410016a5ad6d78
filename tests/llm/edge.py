"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, length long, rank long, `_h` string, start string"


def documents(spark):
    long = "lorem ipsum dolor sit amet, consectetur. " * 4000
    texts = [
        (1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "One  two three four five six"),
        (7, long), (8, long + " end"), (None, "null id text"), (9, "a b"), (10, "ünï çödé   <|endoftext|> x"), (11, "onetwothreefourfivesix "),
    ]
    return spark.createDataFrame([(i, t, None if i == 9 else "en", [None, "b", "a"][k % 3], 0, 1, 2, 3, "h", "s") for k, (i, t) in enumerate(texts)], DOCS)
