"""The estimate and validation jobs on a market of the published size: 1,250 symbols x 714 sessions (0.9 M bars).

The driver's bars are repeated: fifty price-shifted copies of each symbol, each followed by a second pass in time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.operators import analogue as A  # noqa: E402
from tickloom.operators import outcomes as O  # noqa: E402
from tickloom.operators import validation as V  # noqa: E402
from tickloom.operators.calendar import session_table  # noqa: E402
from tickloom.session import local_session, written  # noqa: E402
from tickloom.sources import standins  # noqa: E402


def main(copies: int = 50) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores * 4, "bench-scale")
    spark.sparkContext.setLogLevel("ERROR")
    base = standins.bars(spark, sf_dir)
    last = base.agg(F.max("ord")).first()[0]
    shift = 1 + F.pmod(F.xxhash64("symbol", "date", "copy"), F.lit(1000)) / 20000.0
    grown = (
        base.drop("valid")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            F.concat("symbol", F.lit("-"), "copy").alias("symbol"),
            F.expr(f"date_add(date, lap * {last} * 7)").alias("date"),
            (F.col("ord") + F.col("lap") * last).alias("ord"),
            *[(F.col(c) * shift).alias(c) for c in ("open", "high", "low", "close")],
            "volume", "turnover", "mark", "change", F.lit(True).alias("valid"),
        )
    )
    seconds = {}

    def timed(name, build):
        start = time.perf_counter()
        out = written(build(), name)
        seconds[name] = round(time.perf_counter() - start, 2)
        return out

    bars = timed("bars", lambda: grown)
    sessions = session_table(bars)
    securities = standins.securities(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("symbol", F.concat("symbol", F.lit("-"), "copy"))
    research = timed("research", lambda: O.research_table(bars, sessions, securities))
    settings = A.EstimateSettings(min_turnover=100_000)
    timed("latest_estimates", lambda: A.latest_estimates(research, settings))
    anchors = timed("anchors", lambda: V.validation_anchors(research, V.row_index(bars)))
    predictions = timed("predictions", lambda: V.predictions(anchors, research, settings))
    timed("report", lambda: V.validation_report(predictions))
    print(json.dumps({"bars": bars.count(), "anchors": anchors.count(), "seconds": seconds, "total": round(sum(seconds.values()), 1)}))


if __name__ == "__main__":
    main(*[int(a) for a in sys.argv[1:]])
