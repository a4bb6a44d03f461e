"""Documents with every difficulty at once: nulls, empty and very long texts, ties, repeated rows, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, fp string, file string, key string, h string, _metadata string, __place_file string, `a.b` string"


def rows():
    long = " ".join(f"word{i % 977} thing," for i in range(60_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en"),
        (2, "The quick brown fox jumps over the lazy dog and runs away.", "en"),
        (2, "The quick brown fox jumps over the lazy dog and runs away.", "en"),
        (3, None, "en"), (4, "", None), (5, "   \n\t ", "de"), (6, long, "en"), (7, "1234 !!! ... ###", "fr"),
        (8, "Größe und Straße, über alle Maßen schön: der Fuchs.", "de"), (8, "another text under the same id", "en"),
        (None, "no id here", "en"), (None, None, None), (9, "a<|endoftext|>b <|startoftext|> it's DON'T", None),
        (10, "中文字符 ﬁ Σίσυφος İstanbul \U0001f600 ▁ \x00   é", None), (11, "x" * 30_000, "es"),
    ]
    return [(i, t, lang, "s", 1, 0.5, "i", "f", "p", "k", "h", "m", "q", "d") for i, t, lang in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
