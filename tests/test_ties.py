"""Tables whose rows share time stamps, as copies of one table with shifted keys do."""

import os
from collections import defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from actispark.operators import epochs
from actispark.plans import registry
from actispark.plans.base import samples
from actispark.plans.motion import FS


@pytest.fixture(scope="module")
def tied(spark, sf_dir, tmp_path_factory):
    """A folder with the events of sf_dir six times under shifted keys, in no order."""
    d = str(tmp_path_factory.mktemp("tied"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.agg(F.max("event_id") + 1).first()[0]
    copies = events.crossJoin(spark.range(6).withColumnRenamed("id", "c")).withColumn("event_id", F.col("event_id") + n * F.col("c")).withColumn("user_id", F.col("user_id") + 10 * F.col("c")).drop("c")
    copies.orderBy(F.xxhash64("event_id")).write.parquet(f"file://{os.path.join(d, 'events.parquet')}")
    return d


def rescored(days, passes, last):
    """The rules in plain loops; days: day_no -> wear by order."""
    for step in range(passes + last):
        for day, wear in days.items():
            runs = [(v, len(list(g))) for v, g in groupby(wear)]
            out = []
            for i, (v, n) in enumerate(runs):
                p, q = runs[i - 1][1] if i else None, runs[i + 1][1] if i + 1 < len(runs) else None
                if step < passes:
                    gone = p and q and (n * 0.25 < 3 and n / (p + q) < 0.8 or n * 0.25 < 6 and n / (p + q) < 0.3)
                else:
                    gone = day == max(days) and n * 0.25 < 3 and p and p * 0.25 >= 1
                out += [0 if v == 1 and gone else v] * n
            days[day] = out
    return days


@pytest.mark.parametrize("name, passes, last", [("w7_rescore_wear", 1, False), ("w7_rescore_wear_last_day", 3, True)])
def test_rescoring_of_tied_rows(spark, tied, name, passes, last):
    """Rows of one ts go by line number in all passes, and runs keep their neighbours."""
    days = defaultdict(lambda: defaultdict(list))
    rows = epochs.noon_days(samples(spark, tied), FS).select("recording_id", "day_no", "ts", "line_no").collect()
    for r in sorted(rows):
        days[r.recording_id][r.day_no].append((r.ts, int(r.line_no * 7919 % 101 < 70)))
    expected = []
    for rec, of in days.items():
        done = rescored({d: [w for _, w in v] for d, v in of.items()}, passes, last)
        expected += [(rec, d, ts, w) for d, v in of.items() for (ts, _), w in zip(v, done[d])]
    assert sorted(map(tuple, registry.QUERIES[name](spark, tied).collect())) == sorted(expected)
