import pytest
from pyspark.sql import types as T


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """A folder for written tables, if the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns whose names operators use themselves.
    *[T.StructField(c, T.StringType()) for c in ("key", "text_sha256", "size", "at", "kept", "offset", "band", "score", "block")],
])


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies and clashing names."""
    base, shared = words(1, 120), words(2, 60)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (2, base, "en", "b"), (3, " ".join(edited), "en", "a"),
        (4, None, None, None), (5, "", "en", "a"), (5, "", "en", "a"), (6, " \t\n ", "fr", None), (None, words(3, 50), "fr", "b"), (None, None, None, "b"),
        (None, words(3, 50), "fr", "c"), (7, "één zwei", "fr", "c"), (8, "one\x0btwo three", None, "c"), (9, shared + " " + words(4, 90), "en", "a"),
        (10, words(5, 40) + "\n" + shared + "\r\n" + words(6, 10), "fr", "a"), (11, words(7, 20_000), "en", "a"), (12, words(8, 30) + " " + words(8, 30), "en", "b"),
        (13, "12 34 !!", "en", "a"), (14, ("same line of words\n" * 200), "en", "b"), (15, words(9, 5), "en", "c"), (16, words(9, 5), "en", "c"),
        (2**62, words(10, 70), "fr", "a"), (-5, words(11, 70), "fr", "é"), (17, "😀 " * 300, "en", "ø"), (18, " <|endoftext|> a  <|endoftext|>", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
