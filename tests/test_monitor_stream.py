"""The tail against exact sums, and the streamed monitor against the replay of all days."""

import datetime as dt
import math
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from voxmill.functions.stats import ln_binomial_tail
from voxmill.operators import anomalies
from voxmill.streaming.monitor import monitor_stream

getcontext().prec = 50


def _ln_factorial(n):
    """By Stirling's series on numbers of fifty digits."""
    if n < 200:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    pi = Decimal("3.14159265358979323846264338327950288419716939937510")
    return x * x.ln() - x + (2 * pi * x).ln() / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9)


def _exact(k, n, p):
    p = Decimal(p)
    q = 1 - p
    ln_first = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * p.ln() + (n - k) * q.ln()
    term, total, i, odds = 1.0, 1.0, k, float(p / q)
    while i < n and not (term < total * 1e-18 and i > n * p):
        term *= (n - i) / (i + 1) * odds
        total, i = total + term, i + 1
    return float(ln_first + Decimal(total).ln())


def test_the_tail_is_exact_for_any_number_of_draws(spark):
    cases = [(1, 1, 0.3), (1, 2, 5e-6), (5, 5, 0.2), (3, 9, 0.9), (50, 100, 0.5), (12, 40, 0.01), (700, 10_000, 0.05), (1, 10_000, 1e-7), (9_990, 10_000, 0.999)]
    cases += [(10**6 + d * 1000, 10**9, 1e-3) for d in (-2, -1, 0, 1, 3, 20)] + [(3, 10**9, 1e-10), (5 * 10**8 + 60_000, 10**9, 0.5)]
    found = spark.createDataFrame(cases, "k long, n long, p double").select("*", ln_binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("tail")).collect()
    for r in found:
        assert r.tail == pytest.approx(_exact(r.k, r.n, r.p), rel=1e-9, abs=1e-9), (r.k, r.n, r.p)


DAY = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)


def _write_days(spark, path, days, sources=("s", "t")):
    """A file for each day: every topic four times, and a surge of one on some days."""
    for d in days:
        rows = [(s, f"t{k}", DAY + dt.timedelta(days=d, minutes=i)) for s in sources for k in range(5) for i in range(4)]
        rows += [("s", "t0", DAY + dt.timedelta(days=d, minutes=i)) for i in range(30) if d in (8, 9, 11, 15)]
        spark.createDataFrame(rows, "source string, topic string, reviewed_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_the_stream_judges_as_the_replay_and_goes_on_after_a_restart(spark, tmp_path):
    where, state, check = f"{tmp_path}/in", f"{tmp_path}/monitor", f"{tmp_path}/check"
    run = lambda: monitor_stream(spark.readStream.schema("source string, topic string, reviewed_at timestamp").option("maxFilesPerTrigger", 4).parquet(where), state, check, late="1 hour").awaitTermination()
    _write_days(spark, where, range(10))
    run()
    _write_days(spark, where, range(10, 20))
    run()
    columns = ["source", "topic", "day", "n", "baseline_days", "tests", "alert"]
    got = {tuple(r) for r in spark.read.parquet(f"{state}/judged").select(*columns).collect()}
    obs = spark.read.parquet(where).withColumn("day", F.to_date("reviewed_at"))
    wanted = {tuple(r) for r in anomalies.monitor_backtest(obs).select(*columns).collect()}
    # The last day that is over is the one before the last day seen, and it waits for a day after it.
    due = max(r[2] for r in got)
    assert got == {r for r in wanted if r[2] <= due} and due >= dt.date(2024, 1, 16) and {r[2].day for r in got if r[6]} == {9, 10, 12, 16}
