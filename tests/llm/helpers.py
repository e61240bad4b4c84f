"""Rows that operators have to stand: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, size string, node int, kept int, rank int, component_id string"
EXTRA = (1, "a", 2, 3, 4, "c")
ROWS = [
    (None, None, None, None, None),
    (1, "", "en", None, 0),
    (2, "a b c", "en", "s1", 5),
    (2, "a b c", "en", "s1", 5),
    (3, "word " * 30000, "en", "s2", 0),
    (4, " \n\t ", "en", "s2", 0),
    (None, "x y z w v", "en", "s1", 1),
    (5, "x y z w v", "en", "s1", 1),
    (2, "other text of the same id", "en", "s1", 1),
    (6, "Ünïcödé täxt   with İ and \U0001f600 signs", None, "é", None),
]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def documents(spark: SparkSession, sf: str = "sf0.01") -> DataFrame:
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def texts(df: DataFrame) -> dict[int, str]:
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
