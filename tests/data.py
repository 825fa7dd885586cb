"""Small interaction tables with one dominant user and one dominant item."""

import random


def interactions(seed=1, users=8, items=9, rows=70, hot=0.35):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        user = 1 if rng.random() < hot else rng.randint(1, users)
        item = 1 if rng.random() < hot else rng.randint(1, items)
        out.append((user, item, float(rng.randint(1, 5)), 1_000_000_000 + rng.randint(0, 900) * 86400, f"r{i:04d}"))
    return out


SCHEMA = "user_id bigint, item_id bigint, rating double, ts bigint, row_key string"


def frame(spark, rows=None):
    return spark.createDataFrame(interactions() if rows is None else rows, SCHEMA)
