import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
EDGES = [
    (900001, None), (900002, ""), (900003, " \t\n "), (900004, "the and"), (900005, "THE  and"), (900006, "a b c a b c a b c"),
    (900007, "word " * 3000), (900008, "same text twice " * 4), (900008, "same text twice " * 4), (900009, "x\n\n\x0b\n y\n y\nx"), (900010, "é ß 😀 ñandú it's we'll <|endoftext|>"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Real rows and every odd case, with columns whose names clash with results."""
    real = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(120)
    odd = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")})
    both = real.unionByName(odd.select(real.columns))
    return both.withColumns({"score": F.lit(1), "kept": F.lit("x"), "shard": F.lit(0), "_x": F.lit(0)}).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
