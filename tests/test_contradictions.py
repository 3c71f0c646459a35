"""Contradictions of an entity against all pairs of its events."""

import os
import random
from collections import Counter

from tidewater.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def all_pairs(rows):
    found = Counter()
    for _, user, kind, value in rows:
        for _, other, kind_b, value_b in rows:
            if user == other and kind < kind_b and None not in (value, value_b) and value != value_b:
                found[user, kind, kind_b] += 1
    return dict(found)


def got(spark, sf_dir):
    return {(r.user_id, r.type_a, r.type_b): r.n for r in catalog.QUERIES["source_contradictions"](spark, sf_dir).collect()}


def test_equal_to_all_pairs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.randrange(12), rng.choice("abcd"), rng.choice([1.0, 2.0, 2.5, None])) for i in range(0, 600, 3)]  # no ids next to each other
    rows += [(1000, 50, "a", 1.0), (1002, 50, "b", 1.0), (1004, 51, "b", 1.0), (1006, 51, "a", 2.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = got(spark, str(tmp_path))
    assert found == all_pairs(rows) and found[51, "a", "b"] == 1 and not any(k[0] == 50 for k in found)


def test_days_of_conflict_are_contradictions_too(spark):
    days = catalog.QUERIES["cross_source_conflict"](spark, SF_DIR).collect()
    found = got(spark, SF_DIR)
    assert days and {r.user_id for r in days} <= {user for user, _, _ in found}
