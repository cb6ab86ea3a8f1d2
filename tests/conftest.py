import pytest

from ledgerline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.warehouse.dir": "/tmp/ledgerline-warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_groups(spark):
    """Treat groups of more than a few rows as oversized, to run the split paths."""
    spark.conf.set("spark.ledgerline.hotGroupRows", "5")
    yield
    spark.conf.unset("spark.ledgerline.hotGroupRows")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
