from __future__ import annotations

import os
import random
import time

from cases import changed, prose
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.graph import components
from cueline.llm.set_join import jaccard_groups
from cueline.llm.tables import RELEASE, passing, settled


def shuffled(spark: SparkSession) -> set[str]:
    """The shuffle files that the session holds."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {name for folder in folders for _, _, names in os.walk(folder.getPath()) for name in names if name.startswith("shuffle_")}


def left(spark: SparkSession, before: set[str]) -> set[str]:
    """New shuffle files that do not go within some seconds: Spark removes them beside the next work."""
    for _ in range(50):
        if not (new := shuffled(spark) - before):
            break
        time.sleep(0.1)
    return new


def sums(spark: SparkSession) -> DataFrame:
    return spark.range(1000, numPartitions=3).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))


def test_a_settled_table_leaves_no_shuffle_files(spark: SparkSession) -> None:
    before = shuffled(spark)
    found = settled(sums(spark).join(sums(spark).withColumnRenamed("n", "m"), "k").repartition(3, "m"))
    assert not left(spark, before)
    for _ in range(2):
        assert sorted(found.collect()) == [(k, 100, 100) for k in range(10)]


def test_the_table_itself_can_be_read_again(spark: SparkSession) -> None:
    rows = sums(spark)
    first, second = settled(rows), settled(rows)
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(rows.collect()) == [(k, 100) for k in range(10)]


def test_the_session_keeps_its_own_setting(spark: SparkSession) -> None:
    default = spark.conf.get(RELEASE, None)
    try:
        for own in ("true", "false"):
            spark.conf.set(RELEASE, own)
            passing(sums(spark))
            assert spark.conf.get(RELEASE) == own
    finally:
        spark.conf.unset(RELEASE)
    passing(sums(spark))
    assert spark.conf.get(RELEASE, None) == default


def test_no_step_of_a_join_keeps_its_shuffle_files(spark: SparkSession) -> None:
    """What a long operator has on disk is its checkpoints and one step's shuffles, not the shuffles of all steps."""
    rng = random.Random(4)
    texts = [prose(rng, "en", 60) for _ in range(20)]
    texts += [changed(rng, rng.choice(texts), 2) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    before = shuffled(spark)
    found = jaccard_groups(rows)
    assert not left(spark, before)
    assert found.count() == 60


def test_components_keep_no_shuffle_files(spark: SparkSession) -> None:
    before = shuffled(spark)
    found = components(spark.createDataFrame([(n + 1, n) for n in range(50)], "a long, b long").repartition(3))
    assert not left(spark, before)
    assert {r["root"] for r in found.collect()} == {0}
