"""One corpus object read by byte ranges gives the rows of the whole-file reader."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from trajframe.sources.files import read_gold, read_gold_ranges


def corpus(tasks=7, seed=1):
    r = random.Random(seed)
    odd = ['say "taskDescription"', "a ] b } c { d [", 'back\\slash \\"', "\n\ttab é 日本", "", '"goldActionSequences"']

    def step(i):
        return {"action": r.choice(["go to kitchen", *odd]), "observation": r.choice(odd), "score": str(i / 10), "isCompleted": "false",
                "freelook": "look " * r.randrange(40), "inventory": r.choice(odd)}
    return {f"t{t}" if t != 3 else 'odd "key"': {"taskName": f"task-{t} (x)", "taskIdx": str(t), "goldActionSequences": [
        {"taskDescription": f"Your task {t} {e} " + r.choice(odd), "variationIdx": e * 3, "fold": r.choice(["train", "test"]), "path": [step(i) for i in range(r.randrange(0, 9))]}
        for e in range(0 if t == 2 else r.randrange(1, 30))]} for t in range(tasks)}


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_give_the_rows_of_whole_files(spark, tmp_path, small_ranges, indent):
    for i, c in enumerate((corpus(), corpus(3, 5), {})):
        (tmp_path / f"part{i}.json").write_text(json.dumps(c, indent=indent, ensure_ascii=bool(i)))
    got, want = read_gold_ranges(spark, str(tmp_path)), read_gold(spark, str(tmp_path))
    assert got.columns == want.columns and want.count() > 300
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.option("lineSep", '"taskDescription"').text(str(tmp_path)).rdd.getNumPartitions() > 10


@pytest.mark.parametrize("spoil", [lambda x: x[:-1], lambda x: x[:len(x) // 2], lambda x: x.replace('"fold"', "fold", 1), lambda x: x.replace("}, {", "}, 5, {", 1)])
def test_malformed_objects_fail(spark, tmp_path, small_ranges, spoil):
    (tmp_path / "a.json").write_text(spoil(json.dumps(corpus())))
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_gold_ranges(spark, str(tmp_path)).count()
