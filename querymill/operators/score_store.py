"""Scores kept between runs, found by the content of the text.

The store is a table bucketed by a digest of text and options. A run scores only texts whose digest
it does not hold, and looks up the others; the store's side of both joins is read by bucket, without a
shuffle. Each run adds one file per bucket; many of them are rewritten as one version now and then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill import stored
from querymill.functions.rubric import RubricOptions
from querymill.functions.text import or_empty
from querymill.operators.reward import add_scores

#: Columns of ``operators.reward.add_scores``, by name and type.
SCORES = "extracted_sql string, syntax_valid boolean, syntax double, keywords double, format double, total double"
NAMES = [c.split()[0] for c in SCORES.split(", ")]
#: Runs that are added before the store is rewritten.
REWRITE_AFTER = 16


class ScoreStore:
    """One writer at a time; any number of readers. ``buckets`` stays what the store began with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self._spark, self._path, self._buckets = spark, path, buckets
        if not stored.committed(spark, path):
            stored.commit(spark, path, 0)

    def _table(self, version: int) -> str:
        path = f"{self._path}/version-{version}-of-{self._buckets}"
        return stored.open_bucketed(self._spark, path, f"digest string, {SCORES}", "digest", self._buckets)

    @property
    def version(self) -> int:
        return stored.committed(self._spark, self._path)[-1]

    @property
    def scores(self) -> DataFrame:
        """All kept scores by digest."""
        return self._spark.table(self._table(self.version))

    def digest(self, text: Column, opts: RubricOptions) -> Column:
        """128 bits of the options and the text: other options are other scores."""
        return F.md5(F.concat(F.lit(f"{opts!r}|"), or_empty(text)))

    def add(self, texts: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()) -> int:
        """Score the distinct texts that the store lacks and keep them; returns how many these were."""
        version = self.version
        name = self._table(version)
        before = self._spark.table(name).count()  # from file footers
        text = or_empty(F.col(response))
        keyed = texts.select(self.digest(F.col(response), opts).alias("digest"), text.alias(response))
        distinct = keyed.dropDuplicates(["digest"])
        known = self._spark.table(name).select("digest")
        lacking = distinct.join(known.hint("merge"), "digest", "left_anti")
        stored.append_bucketed(add_scores(lacking, response, opts).select("digest", *NAMES), name, "digest", self._buckets)
        files = [n for n in stored.names(self._spark, f"{self._path}/version-{version}-of-{self._buckets}") if n.endswith(".parquet")]
        added = self._spark.table(name).count() - before
        if len(files) > REWRITE_AFTER * self._buckets:
            self.rewrite()
        return added

    def score(self, df: DataFrame, response: str = "response", opts: RubricOptions = RubricOptions()) -> DataFrame:
        """``add_scores`` through the store; a text that it lacks is scored once and kept.

        ``df`` is read twice, so pass a table at rest. Columns of the scores' names are replaced.
        """
        self.add(df, response, opts)
        kept = df.select(*[c for c in df.columns if c not in NAMES], self.digest(F.col(response), opts).alias("__digest"))
        found = kept.join(self.scores.withColumnRenamed("digest", "__digest").hint("merge"), "__digest", "left")
        return found.drop("__digest")

    def rewrite(self) -> None:
        """Write all scores as a new version, one file per bucket and one row per digest.

        Readers see it from its commit on; the version before the present one is deleted.
        """
        old = stored.committed(self._spark, self._path)
        rows = self._spark.table(self._table(old[-1])).dropDuplicates(["digest"])
        stored.append_bucketed(rows, self._table(old[-1] + 1), "digest", self._buckets)
        stored.commit(self._spark, self._path, old[-1] + 1)
        for version in old[:-1]:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
            stored.remove(self._spark, f"{self._path}/version-{version}-of-{self._buckets}")
            stored.remove(self._spark, f"{self._path}/commits/version={version}")
