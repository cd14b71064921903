import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from qforge.session import get_session
    s = get_session("local[4]", shuffle_partitions=4,
                    extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="qforge-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def gazetteer(spark):
    # Fixed coordinates used by the reference's tests.
    rows = [("New York", 40.7128, -74.0060), ("San Francisco", 37.7749, -122.4194),
            ("Seattle", 47.6062, -122.3321), ("Austin", 30.2672, -97.7431),
            ("New York, NY", 40.7128, -74.0060), ("San Francisco, CA", 37.7749, -122.4194),
            ("Newark", 40.7357, -74.1724), ("London", 51.5074, -0.1278)]
    return spark.createDataFrame(rows, "name string, lat double, lon double")


@pytest.fixture(scope="session")
def comp_df(spark):
    """4,000 rows of pay by level, city, day and service, from formulas over a range."""
    from pyspark.sql import functions as F
    n = F.col("id")
    level, day = F.floor(n / 4) % 5, F.floor(n / 20)
    city = F.element_at(F.array(*map(F.lit, ("New York", "Austin", "Seattle", "San Francisco"))), (n % 4 + 1).cast("int"))
    spread = (F.pmod(F.hash(n), F.lit(97)) - 48) * 110.0
    base = (96_000.0 + 47_500.0 * level) * F.when(city == "New York", 1.22).otherwise(1.0) + spread
    return spark.range(4000).select(
        F.concat(F.lit("E"), level + 3).alias("Level"), city.alias("Location"),
        F.timestamp_seconds(F.lit(1_640_995_200) + day * 86_400).alias("Date"),
        (level * 2.5 + 1.5).cast("double").alias("YearsOfExperience"), F.lit(2.0).alias("YearsAtCompany"),
        base.alias("BaseSalary"), (base * 0.45).alias("Stock"), (base * 0.12).alias("Bonus"), (base * 1.57).alias("TotalComp")).coalesce(8)
