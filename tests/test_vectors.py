import random

from lorekiln.operators import vectors
from lorekiln.plans import retrieval
from pyspark.sql import functions as F


def test_previous_row_of_the_whole_group(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, None if i % 7 == 0 else [float(i)]) for i in range(400)] + [("alone", 400, [1.0])]
    last, want = {}, {}
    for g, i, v in rows:
        want[i] = last.get(g)
        last[g] = v
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, i long, v array<float>")
    # many partitions, so that groups go over several of them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = vectors.with_previous(frame, "g", ["i"], "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {x["i"]: x["before"] for x in got} == want and len(got) == len(rows)


def test_every_chunk_with_a_predecessor_is_compared(spark, sf):
    chunks = spark.read.parquet(f"{sf}/chunks.parquet")
    files = chunks.select("file_id").distinct().count()
    empty = chunks.filter(F.col("embedding").isNull()).count()
    assert retrieval.vector_cosine_before(spark, sf).count() >= chunks.count() - files - empty > 0
