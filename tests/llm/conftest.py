import duckdb
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture()
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang) rows."""
    def build(rows):
        full = [(*r, "en")[:3] + ("src", None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return build


@pytest.fixture()
def clashing():
    """Adds columns with names that operators use themselves."""
    def add(df):
        for name in ("doc", "row", "line", "item", "item_id", "key", "fp", "word", "stratum", "score", "row key", "node", "root"):
            df = df.withColumn(name, F.lit("x"))
        return df
    return add


ODD = [(None, None), (None, ""), (1, None), (2, ""), (3, "  \t\n \n"), (4, "one"), (4, "one"), (5, "One"), (6, "tie of words here and there")]
