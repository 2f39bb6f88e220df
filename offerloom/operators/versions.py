"""Tables of an iteration: written rows, and rows of which a round replaces those of some keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.session import drop_folder, new_folder


class Stored:
    """A written table that any session of the application can read, and that can be dropped."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema, self.folder = df.sparkSession, df.schema, new_folder(df.sparkSession)
        df.write.parquet(self.folder)

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Stored:
        """A table that was written before."""
        table = cls.__new__(cls)
        table.spark, table.folder, table.schema = spark, folder, spark.read.parquet(folder).schema
        return table

    def rows(self, session: SparkSession | None = None) -> DataFrame:
        return (session or self.spark).read.schema(self.schema).parquet(self.folder)

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


class Versions:
    """Rows by key, kept as one written table a round; a round replaces all rows of the keys it names.

    ``tidy`` writes the rows that stand as one table again and drops the older ones, every few rounds.
    """

    #: Rounds after which the rows that stand are written anew.
    ROUNDS_KEPT = 8

    def __init__(self, key: str):
        self.key, self.rounds = key, []
        #: Whether the first table belongs to somebody else and stays.
        self.borrowed = False

    def replace(self, rows: Stored, keys: Stored, turn: int, lent: bool = False) -> None:
        """``rows`` stand for all ``keys`` from this round on; both belong to the versions now, but for ``lent`` keys."""
        self.rounds.append((turn, rows, keys, lent))

    def current(self, session: SparkSession) -> DataFrame:
        """The rows that stand."""
        if not self.rounds:
            raise ValueError("no round has been taken")
        first, *later = self.rounds
        if not later:
            return first[1].rows(session)
        # The first round holds every key that no later one names.
        rows = first[1].rows(session).withColumn("_turn", F.lit(first[0]))
        named = None
        for turn, new, keys, _ in later:
            rows = rows.unionByName(new.rows(session).withColumn("_turn", F.lit(turn)))
            one = keys.rows(session).select(self.key, F.lit(turn).alias("_last"))
            named = one if named is None else named.unionByName(one)
        last = named.groupBy(self.key).agg(F.max("_last").alias("_last"))
        return rows.join(last, self.key, "left").filter(F.col("_last").isNull() | (F.col("_turn") == F.col("_last"))).drop("_turn", "_last")

    def tidy(self, session: SparkSession) -> None:
        if len(self.rounds) <= self.ROUNDS_KEPT:
            return
        whole = Stored(self.current(session))
        whole.spark = session
        old, self.rounds = self.rounds, [(self.rounds[-1][0], whole, whole, True)]
        for _, rows, keys, lent in old[1 if self.borrowed else 0 :]:
            rows.drop()
            if not lent:
                keys.drop()
        self.borrowed = False
