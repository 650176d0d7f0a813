import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tardy.llm.queries import prepare

    prepare(spark)
