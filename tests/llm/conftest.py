import pytest

#: Text cases of every kind; ids repeat, are null, and sources tie.
TEXTS = [
    (1, "the cat sat on the mat and the dog lay by the door", "en", "b"),
    (2, "the cat sat on the mat and the dog  lay by the door", "en", "b"),
    (3, "The cat sat\ton the mat and the dog lay by the door ", "en", None),
    (4, None, None, "a"),
    (5, "", "en", "a"),
    (6, " \t\n\x0b\x0c\r ", "de", None),
    (7, "ein kurzer Satz", "de", "c"),
    (8, "7 8 9 !!", None, "c"),
    (9, "x" * 3000, "en", "c"),
    (10, "wort " * 40000, "de", "d"),
    (11, "日本語 😀 ▁   \x1c tab\tend<|endoftext|>", None, "é"),
    (12, "der Hund liegt an der Tür und die Katze sitzt auf der Matte im Haus", "de", "c"),
    (13, "der Hund liegt an der Tür und die Katze sitzt auf der Matte im Flur", "de", "c"),
    (None, "a row without an id", "en", "b"),
    (14, "repeated row", "en", "b"),
    (14, "repeated row", "en", "b"),
]
#: Columns named like the operators' working columns.
CLASH = ["id", "sha", "size", "kept", "score", "words", "part", "ids", "n", "batch", "train", "label", "v", "rep"]


@pytest.fixture(scope="session")
def shipped(spark):
    from sigspark.llm.common import ship
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs(shipped):
    from pyspark.sql import functions as F
    df = shipped.createDataFrame([(*r, len(r[1] or "")) for r in TEXTS],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
