import pytest


@pytest.fixture
def docs(spark):
    def make(*rows, schema="doc_id long, text string, lang string, source string"):
        width = len(schema.split(","))
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return make
