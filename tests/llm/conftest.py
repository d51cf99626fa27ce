import pytest
from llm.cases import ODD, SCHEMA, row

# Names the operators use inside; a table may well have columns called the same.
CLASHING = ["row", "words", "kept", "fp", "label", "bucket", "rank", "block", "__id", "n", "verdict", "rate", "shard"]


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, clashing=False):
        df = spark.createDataFrame([r if len(r) == 5 else row(*r) for r in rows], SCHEMA)
        if clashing:
            df = df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHING))
        return df

    return docs


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def odd_clashing(make):
    return make(ODD, clashing=True)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
