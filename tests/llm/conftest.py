import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from quillspark.llm.tables import ship

    ship(spark)
