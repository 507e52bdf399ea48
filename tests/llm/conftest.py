import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = "word " * 40_000 + "\n" + "abc " * 10
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (4, "Ünï çödé <|endoftext|> x", None, None, None), (5, "one two three", "en", "b", 13), (5, "one two three", "en", "b", 13),
        (None, "mail me at a.b@c.de today", "en", "b", 5), (7, "\n\n \t\n", "fr", "b", 5), (8, "a b c d e f g h i j k l m", "en", "b", 1), (9, "A b C d e f g h i j k l m", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for extra in ("kept", "n_words", "shard", "row_id", "key", "cid", "registers", "size", "spans", "_h", "_c", "_s", "_gone", "_cut", "_new", "_kept", "text_hash", "text_crc", "cut", "new", "host", "gone", "low", "hits", "line", "label_id", "component_id", "TEXT_ID", "a.b"):
        df = df.withColumn(extra, df["doc_id"])
    return df


@pytest.fixture(scope="session")
def huge_documents(spark):
    """One huge number, one huge word, in letters of several scripts, and one huge line of parts."""
    texts = ["0" * 300_000 + "1.1.1.1", "a" * 300_000, "é" * 200_000, "1." * 150_000, "漢" * 100_000, "-" * 200_000, "+1 (269) 555-3296 4524132264652876, a.b@c.de token=abcdefabcdefabcdef " * 3_000, "½ ² Ⅷ ٣", "x" * 30 + " " + "Ab1" * 100_000]
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}
