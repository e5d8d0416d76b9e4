import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpusmith-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """Build ``(row_key, ID, text, target)`` from texts."""

    def build(texts, targets=None):
        rows = [
            (f"r{i}", f"r{i}", t, (targets[i] if targets else i % 3))
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, "row_key string, ID string, text string, target int")

    return build
