"""Rows that operators must stand: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, "   \n\t ", "fr", ""),
    (6, "one", "fr", None),
    (7, "ONE  two\n three FOUR é ñ 日本語 　x", "de", "b"),
    (7, "ONE  two\n three FOUR é ñ 日本語 　x", "de", "b"),
    (None, "alpha beta gamma delta epsilon zeta eta theta", "en", "c"),
    (8, "word " * 30_000 + "end", "en", "a"),
    (9, "1234567890 !!! ??? \x00 \x1f", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark):
    """The rows, with further columns whose names operators use inside."""
    d = spark.createDataFrame(DOCS, SCHEMA)
    names = "fp n _key size row host spans _d _c _text _row _file _source _bad block uid tie place ids part seq start length findings runs low high text_hash _id _hash digest kind".split()
    return d.selectExpr("*", *[f"{i if i % 2 else repr('x')} AS {n}" for i, n in enumerate(names)])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
