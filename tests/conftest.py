import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def traffic(spark):
    """A few actors with irregular gaps; one of them has a third of the rows."""
    import random

    from reqguard.sources.requests import AGENTS, PAYLOADS
    rng = random.Random(7)
    paths = ["/login", "/admin", "/config", "/", "/search", "/api/data", "/.env"] + [f"/api/users/{i}" for i in range(9)]
    rows, clock = [], 1_700_000_000_000_000
    for i in range(600):
        dense = (i // 100) % 2  # quiet and busy spells
        clock += rng.choice([50_000, 100_000, 400_000, 1_000_000] if dense else [1_000_000, 4_000_000, 30_000_000, 150_000_000])
        ip = "10.0.0.1" if rng.random() < 0.34 else f"10.0.0.{rng.randint(2, 6)}"
        payload = rng.choice(PAYLOADS) if rng.random() < 0.3 else ""
        rows.append((i, clock, ip, rng.choice(["GET", "POST", "DELETE"]), rng.choice(paths),
                     rng.choice([200, 200, 401, 403, 422, 500]), rng.choice(AGENTS), rng.choice(["a", "b", "c", "d", ""]),
                     payload))
    names = "event_id long, t_us long, ip string, method string, endpoint string, status_code long, user_agent string, " \
            "session_id string, payload string"
    df = spark.createDataFrame(rows, names).cache()
    keys = [x.split()[0] for x in names.split(", ")]
    return df, [dict(zip(keys, r)) for r in rows]
