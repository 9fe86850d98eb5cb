import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


ODD = [
    (900001, None), (900002, ""), (900003, " \t\n "), (900004, "one two three"), (900005, "One TWO three"),
    (900006, "a b c d e f g h i j k l m n o p"), (900007, "a b c d e f g h i j k l m n o p"), (900007, "a b c d e f g h i j k l m n o p"),
    (None, "a b c d e f g h i j k l m n o p"), (None, None), (900008, "É é ü 漢字 \U0001f600 é " * 40), (900009, "x" * 70000 + " y"),
    (900010, "word " * 30000), (900011, "\x00\x1c\x85   odd\r\nlines\x0b\x0c"),
]


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The smallest table and odd rows, with extra columns whose names clash."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr(
        "doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars"
    )
    return docs.unionByName(odd).selectExpr("*", "1 as class", "2 as size", "'x' as shingle", "3 as row")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
