import pytest


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


#: Rows that every operator has to take: nulls, empty and long texts, ties, repeated rows.
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten", "en", "a", 1),
    (1, "another text under the same number, with ten words in it", "en", None, 1),
    (None, "a text without a number but with enough words to count", None, "b", None),
    (None, None, None, None, None),
    (2, None, "en", "a", 0),
    (3, "", "en", "a", 0),
    (4, " \n\t \n", "en", "b", 5),
    (5, "long " * 60_000, "en", "b", None),
    (6, "x" * 200_000, "en", "c", None),
    (7, "é 日本 🎉 \u0000 <|endoftext|> \\ <|im_end|> a@b.example +1 (555) 010-9999", "xx", "c", None),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


#: Names that an operator might use inside.
CLASH = ["id", "key", "k", "d", "fp", "th", "root", "size", "h", "src", "slot", "sim", "line", "nth", "position", "c0", "c1", "score", "n", "TEXT2"]


@pytest.fixture
def clash(odd):
    from pyspark.sql import functions as F

    return odd.select(*[F.lit(i).alias(c) for i, c in enumerate(CLASH)], "*")
