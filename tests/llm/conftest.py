import pytest
from llm_samples import TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with further columns whose names clash with those that operators use inside."""
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 == 4 else f"src{k % 3}", 7, "x", 0.5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, score double")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
