"""Roll-ups that are kept up to date: states of batches that add up to the state of all rows, and the boards read from them.

A state is a set of small tables of sums and counts by (family, keys), for each family and over all; two states of one kind are
merged by adding what has the same keys. What an average, a share or a median needs is kept as what it is made of: sums with
their counts, and doses with how often they occur, so that the upper median comes from its place among all doses, exactly.
Batches hold whole groups (a group's rows come in one batch, once), as an appending stream with dedupe gives them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..streaming.incremental import current, publish
from .rollups import at_place, by_family_and_all, top_by
from .steps import cut

#: Columns that name a row of a state; all others are added up.
Keys = Mapping[str, Sequence[str]]
State = Mapping[str, DataFrame]
KEYS: Keys = {"items": ["family", "item"], "doses": ["family", "item", "dose"], "kinds": ["family", "kind"], "groups": ["family"], "outcomes": ["family"]}
BATCHES = "batches"


def state_of(lines: DataFrame, groups: DataFrame, stages: Sequence[str], values: Sequence[str], all_name: str = "all") -> State:
    """The state of some rows.

    ``lines`` has family, group, item (or null), kind, stage, amount, share and batch (the size an amount is dosed over);
    ``groups`` has family and ``values``, a row a group.
    """
    both = lambda df, keys, *sums: by_family_and_all(df, "family", keys, *sums, all_name=all_name)
    one = F.count(F.lit(1))
    in_stage = [F.sum(F.when(F.col("stage") == s, F.col("amount"))).alias(f"in_{s}") for s in stages]
    each = lines.where("item is not null").groupBy("family", "group", "item").agg(F.sum("amount").alias("amount"), F.min("batch").alias("batch"), *in_stage)
    each = cut(each.withColumn("dose", F.when(F.col("batch") != 0, F.col("amount") / F.col("batch"))))
    shares = lines.groupBy("family", "group", "kind").agg(F.sum("share").alias("share"))
    return {
        "items": both(each, ["item"], one.alias("n_groups"), F.sum("amount").alias("total"), *[F.sum(f"in_{s}").alias(f"in_{s}") for s in stages]),
        "doses": both(each.where("dose is not null"), ["item", "dose"], one.alias("times")),
        "kinds": both(shares, ["kind"], F.sum("share").alias("share"), one.alias("n_with")),
        "groups": both(lines.select("family", "group").distinct(), [], one.alias("n_groups")),
        "outcomes": both(groups, [], one.alias("n"), *[x for v in values for x in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))]),
    }


def merged(first: State, second: State, keys: Keys = KEYS) -> State:
    """One state of the rows of both."""
    out = {}
    for name, by in keys.items():
        both = first[name].unionByName(second[name])
        out[name] = both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in both.columns if c not in by])
    return out


def leaderboard(state: State, n: int = 40) -> DataFrame:
    """By family and over all the n items that most groups use (ties by item), with totals and the upper median dose."""
    board = top_by(state["items"], ["family"], [F.desc("n_groups"), F.col("item")], n)
    medians = at_place(state["doses"], ["family", "item"], "dose", lambda k: F.floor(k / 2), "times")
    return board.join(medians.withColumnRenamed("dose", "median_dose"), ["family", "item"], "left")


def mean_shares(state: State) -> DataFrame:
    """family, kind, n_with and mean_share over all groups of the family: a group without the kind counts as 0."""
    rows = state["kinds"].join(state["groups"], "family")
    return rows.select("family", "kind", "n_with", (F.col("share") / F.col("n_groups")).alias("mean_share"))


def outcomes(state: State, values: Sequence[str]) -> DataFrame:
    """family, n and the mean of each value over the groups that have it."""
    mean = lambda v: F.when(F.col(f"n_{v}") > 0, F.col(f"sum_{v}") / F.col(f"n_{v}"))
    return state["outcomes"].select("family", "n", *[mean(v).alias(f"avg_{v}") for v in values])


def stored(spark: SparkSession, folder: str, keys: Keys = KEYS) -> State:
    """The state that is current in a folder."""
    at = current(spark, folder)
    return {name: spark.read.parquet(f"{at}/{name}") for name in keys}


def fold(spark: SparkSession, folder: str, batch: int, state: State, keys: Keys = KEYS) -> bool:
    """Add a batch to what the folder holds, as its next version; readers see the old state or the new one.

    A batch that is in already isn't added again, so a stream may send its last batch twice. The first batch makes the state.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        batches = spark.read.parquet(f"{current(spark, folder)}/{BATCHES}")
        if not batches.where(F.col("batch") == batch).isEmpty():
            return False
        state, batches = merged(stored(spark, folder, keys), state, keys), batches.union(spark.range(batch, batch + 1).toDF("batch"))
    else:
        batches = spark.range(batch, batch + 1).toDF("batch")

    def build(path: str) -> None:
        for name in keys:
            state[name].write.parquet(f"{path}/{name}")
        batches.coalesce(1).write.parquet(f"{path}/{BATCHES}")

    publish(spark, build, folder)
    return True


def keep_up(rows: DataFrame, made: Callable[[DataFrame], State], folder: str, checkpoint: str, keys: Keys = KEYS) -> StreamingQuery:
    """Fold each batch of a stream into the folder, over all that is there; ``made`` gives the state of a batch."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            fold(batch.sparkSession, folder, number, made(batch), keys)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
