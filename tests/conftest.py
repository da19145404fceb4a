import pytest
from pyspark.sql import SparkSession

from caretide.session import configure


def new_session():
    spark = (
        configure(SparkSession.builder)
        .master("local[8]")
        .appName("caretide-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return new_session()
