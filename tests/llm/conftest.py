import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
#: Names that operators use for columns of their own.
CLASH = ("sig", "node", "label", "row", "key", "chunk", "part", "base", "spans", "x", "_row", "src", "score")


def frame(spark, rows, clash=False):
    """Documents from ``(doc_id, text, lang, source)``; with extra columns of clashing names if asked."""
    df = spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOC)
    if clash:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(7) for c in CLASH})
    return df


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [(None, None, None, None), (None, "no id here at all", "en", None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", "b"),
            (4, "one", "en", "b"), (5, long, "en", "b"), (6, long, "en", None), (7, "same words in here twice over", "de", "a"),
            (7, "same words in here twice over", "de", "a"), (8, "same words in here twice over", "de", "c"), (9, "é'S don't 　 ñ 12 ½ 🙂!!", "es", "a")]


@pytest.fixture()
def odd(spark, odd_rows):
    return frame(spark, odd_rows, clash=True)


@pytest.fixture()
def none(spark):
    return frame(spark, [])


@pytest.fixture()
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
