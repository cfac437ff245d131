"""C10 in blocks of entities."""

from pyspark.sql import functions as F

from conftest import usage_df, usage_row
from costlens.plans import serving as V
from costlens.sources import schemas


def test_entities_in_blocks_are_the_whole_join(spark):
    rows = [usage_row(n, "2024-01-10 10:00:00", endpoint=("big", "small", None, "none")[n % 4], account="a2" if n == 8 else "a1")
            for n in range(24)] + [usage_row(0, "2024-01-10 10:00:00", endpoint="big")]
    usage = usage_df(spark, rows)
    ents = [("a1", "big", "id", "o", f"e{n}", "CUSTOM_MODEL", None, None) for n in range(40)]
    ents += [("a1", "small", "id", "o", "only", None, None, None)] * 2 + [(None, "big", "id", "o", "lost", None, None, None)]
    entities = spark.createDataFrame(ents + ents[:1], schemas.SERVED_ENTITIES)
    plain, blocks = V.join_served_entities(usage, entities), V.join_served_entities(usage, entities, 8)
    assert blocks.columns == plain.columns and plain.count() > 200
    assert sorted(map(str, blocks.collect())) == sorted(map(str, plain.collect()))
    # as written, a record meets one block at a time: its entities do not stand together
    placed = blocks.where("endpoint_name = 'big'").select("record_id", F.spark_partition_id().alias("p")).collect()
    at = [(r["p"], r["record_id"]) for r in placed]
    turns = sum(a != b for a, b in zip(at, at[1:])) + 1
    assert turns > 2 * len({r["record_id"] for r in placed})


def test_rows_of_an_endpoint_are_dealt_evenly_to_the_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = usage_df(spark, [usage_row(0, "2024-01-10 10:00:00", endpoint="e")])

    def per_task(records, entities, block, repeat):
        """``repeat``: the records are copies of one record, without an id."""
        usage = row.crossJoin(spark.range(records)).withColumn("record_id", F.lit(None).cast("long") if repeat else F.col("id")).drop("id")
        ents = spark.range(entities).select(F.lit("a1").alias("account_id"), F.lit("e").alias("endpoint_name"), F.lit("id").alias("endpoint_id"),
                                            F.lit("o").alias("created_by"), F.concat(F.lit("n"), "id").alias("served_entity_name"),
                                            *[F.lit(None).cast("string").alias(c) for c in V.ENTITY_COLS[4:]])
        got = V.join_served_entities(usage, ents, block)
        names = got.agg(F.countDistinct("served_entity_name"), F.countDistinct("record_id")).first()
        assert tuple(names) == (entities, 0 if repeat else records)
        return [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]

    for records, entities, block, repeat in ((4000, 100, 512, False), (4000, 100, 512, True), (3, 4000, 100, False)):
        rows = per_task(records, entities, block, repeat)
        assert sum(rows) == records * entities and len(rows) == tasks
        assert max(rows) < 1.2 * sum(rows) / tasks
