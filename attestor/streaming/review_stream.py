"""Review events as a stream: the same fold as the batch operators, kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from attestor.operators.ordered import keep_latest
from attestor.schemas import split_valid
from attestor.operators.review import review_rules

#: Batches between two snapshots of the state.
COMPACT_EVERY = 20

EVENT_SCHEMA = T.StructType(
    [T.StructField("pair_id", T.StringType()), T.StructField("human_decision", T.StringType()),
     T.StructField("human_final_class", T.StringType()), T.StructField("human_poolable", T.BooleanType()),
     T.StructField("reviewer_initials", T.StringType()), T.StructField("override_reason", T.StringType()),
     T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType())]
)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, glob: str = "*.parquet") -> DataFrame:
    """New files of an append-only folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def latest_per_pair(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The latest valid event per pair; works on streams and on tables.

    There is no watermark: a late review must still count, so one row per pair stays in state.
    """
    good, _ = split_valid(events, review_rules())
    rest = [c for c in good.columns if c != "pair_id"]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return good.groupBy("pair_id").agg(latest).select("pair_id", "_row.*")


def run_fold(
    events: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ("ts", "event_id"), compact_every: int = COMPACT_EVERY
) -> None:
    """Fold all available events into ``table``: each micro-batch appends its changed pairs.

    A batch writes to a folder named after its number, so a batch that is run again after a
    failure replaces its own rows. Every ``compact_every`` batches the state so far becomes a snapshot.
    :func:`current_state` reads the newest snapshot and the batches after it, however long the stream has run.
    """

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batches/batch={batch}")
        if (batch + 1) % compact_every == 0:
            state = current_state(changed.sparkSession, table, order, before=batch)
            state.write.mode("overwrite").parquet(f"{table}/snapshots/upto={batch}")

    query = (
        latest_per_pair(events, order)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()


def current_state(spark: SparkSession, table: str, order: Sequence[str] = ("ts", "event_id"), before: int | None = None) -> DataFrame:
    """The newest row per pair; ``before`` leaves out snapshots of that batch and later ones."""
    rows = spark.read.parquet(f"{table}/batches")
    try:
        snapshots = spark.read.parquet(f"{table}/snapshots")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        if before is not None:
            snapshots = snapshots.filter(F.col("upto") < before)
        last = snapshots.agg(F.max("upto")).first()[0]
        if last is not None:
            # Both filters are on folder names: older batches are not read.
            rows = rows.filter(F.col("batch") > last).drop("batch").unionByName(snapshots.filter(F.col("upto") == last).drop("upto"))
    return keep_latest(rows.drop("batch"), ["pair_id"], list(order))
