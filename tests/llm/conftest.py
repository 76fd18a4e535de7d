import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], schema)

    return make
