"""CSV in splits against the whole-file reader, and mergeable sketches against exact figures."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from quayside.operators import sketches
from quayside.sources import multiline

SCHEMA = StructType().add("id", IntegerType()).add("t", StringType()).add("n", DoubleType())


def csv_text(seed, feed="\n"):
    rng = random.Random(seed)
    cells = ["plain", "two\nlines", 'a "quoted" word', "comma, and\n\nempty lines\n", "", '"\n"', "é 漢字\n\U0001f600", "x" * 50, '""']
    rows = [f"{i},\"{rng.choice(cells).replace(chr(34), chr(34) * 2)}\",{rng.choice(['1.5', '', 'bad', '-2'])}" for i in range(60)]
    rows[7:7] = [""]
    return feed.join(["id,t,n", *rows]) + rng.choice(["", feed])


@pytest.mark.parametrize("split", [40, 200, 1 << 20])
@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_splits_read_as_the_whole_file(spark, tmp_path, split, feed):
    for seed in range(3):
        (tmp_path / f"{seed}.csv").write_bytes(csv_text(seed, feed).encode())
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path)).collect()
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        read = multiline.read_csv(spark, str(tmp_path), SCHEMA)
        assert split > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = read.collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 180


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,t,n")
    (tmp_path / "c.csv").write_text('id,t,n\n1,"never closed,2\n3,x,4\n')
    got = multiline.records(spark, str(tmp_path)).collect()
    assert sorted(r.record for r in got) == ['1,"never closed,2\n3,x,4', "id,t,n", "id,t,n"]
    assert multiline.read_csv(spark, str(tmp_path / "b.csv"), SCHEMA).count() == 0


def test_quantile_states_merge(spark):
    rng = random.Random(1)
    values = [(i % 7, i % 3, rng.gauss(0, 1)) for i in range(20_000)] + [(8, 0, None), (9, 1, 5.0)]
    df = spark.createDataFrame(values, "week int, part int, v double").repartition(5)
    state = sketches.quantile_state(df, ["week", "part"], "v", 400)
    whole = sketches.merged_quantiles(state, []).first()
    ranked = sorted(v for *_, v in values if v is not None)
    assert whole.n == len(ranked) == 20_001
    answers = sketches.merged_quantiles(state, []).select(*[sketches.quantile("sketch", p).alias(str(p)) for p in (0.01, 0.5, 0.9)]).first()
    for p in (0.01, 0.5, 0.9):
        rank = sum(v <= answers[str(p)] for v in ranked) / len(ranked)
        assert abs(rank - p) <= 2 * sketches.rank_error(400)
    by = {r.week: r for r in sketches.merged_quantiles(state, ["week"]).select("week", "n", sketches.quantile("sketch", 0.5).alias("m")).collect()}
    assert set(by) == {*range(7), 9} and by[9].m == 5.0 and by[9].n == 1
    assert sketches.quantile_state(df.limit(0), ["week"], "v").count() == 0


def test_overlaps_of_stored_states(spark):
    df = spark.range(5000).select(F.lit("k").alias("g"), F.explode(F.array(*map(F.lit, "abc"))).alias("name"), "id")
    keep = (F.col("name") == "a") & (F.col("id") < 3000) | (F.col("name") == "b") & (F.col("id") >= 2000) | (F.col("name") == "c") & (F.col("id") < 0)
    state = sketches.distinct_state(df.filter(keep), ["g", "name"], "id")
    (r,) = sketches.overlaps(state, "g", "name").collect()
    assert (r.a, r.b) == ("a", "b") and abs(r.overlap - 1000) <= r.error < 400 and abs(r.distinct_a - 3000) <= 3000 * sketches.distinct_error()
    total = sketches.merged_distinct(state, ["g"]).select(F.hll_sketch_estimate("sketch")).first()[0]
    assert abs(total - 5000) <= 5000 * sketches.distinct_error()
