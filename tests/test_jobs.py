"""Runs that tell their stages and are cancelled before, within and after their work."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators.jobs import Cancelled, Run


def test_stages_are_told(spark):
    told = []
    run = Run(spark, told.append)

    def work(r):
        r.stage("count")
        return spark.range(10).count()

    assert run.run(work) == 10 and told == ["start", "count", "done"]
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_other_errors_pass(spark):
    gone = []
    with pytest.raises(ZeroDivisionError):
        Run(spark).run(lambda r: 1 / 0, lambda: gone.append(1))
    assert gone == []


def test_cancelled_before_and_after(spark):
    told, gone = [], []
    early = Run(spark, told.append)
    early.cancel()
    with pytest.raises(Cancelled):
        early.run(lambda r: gone.append("worked"), lambda: gone.append("undone"))
    late = Run(spark, told.append)
    with pytest.raises(Cancelled):
        late.run(lambda r: late.cancel(), lambda: gone.append("removed"))
    assert gone == ["undone", "removed"] and told == ["cancelled", "start", "cancelled"]


def test_running_jobs_end(spark):
    run = Run(spark)
    slow = F.udf(lambda x: time.sleep(60) or x, "long")
    start = time.time()
    threading.Timer(3, run.cancel).start()
    with pytest.raises(Cancelled):
        run.run(lambda r: spark.range(4).select(slow("id")).collect())
    assert time.time() - start < 40
    assert spark.range(3).count() == 3
