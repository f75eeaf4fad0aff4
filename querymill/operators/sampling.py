"""Splitting and sampling that do not depend on how the data is partitioned.

Every draw orders samples by an md5 of seed and id, so a rerun, a retry of a lost task or another
cluster size picks the same rows. Exact cuts never sort the table: a histogram over the first hex
digits of the key tells in which bucket a cut falls, and only that bucket is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.cleaning import LEVELS
from querymill.storage import store

PREFIX_DIGITS = 4
SALTS = 64
# Stored keys per task that mark the ranks of an ordered cut.
MARKS = 1024


def sample_key(seed: int | str | Column = 42, sample_id: str = "sample_id") -> Column:
    """32 hex digits; as text they sort like the number."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(head.cast("string"), F.lit("|"), F.col(sample_id).cast("string")))


def _check_sizes(*sizes: float) -> None:
    total = sum(sizes)
    if not math.isclose(total, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"The shares of the splits add up to {total}, not to 1")


def _hex_bound(share: float) -> str:
    """Least 8-digit prefix that lies outside the first ``share`` of the key space."""
    bound = math.ceil(round(share * 2**32, 3))
    return "g" if bound >= 2**32 else f"{bound:08x}"


def assign_splits(
    df: DataFrame,
    train_size: float = 0.8,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` by comparing the key with fixed bounds: no shuffle, shares in expectation."""
    _check_sizes(train_size, val_size, test_size)
    prefix = F.substring(sample_key(seed), 1, 8)
    last = "test" if test_size > 0 else "validation"
    split = (
        F.when(prefix < _hex_bound(train_size), "train")
        .when(prefix < _hex_bound(train_size + val_size), "validation")
        .otherwise(last)
    )
    return df.withColumn("split", split)


def _met(
    rows: DataFrame, stratum: str, digits: int, ranks: DataFrame | Callable[[DataFrame], DataFrame], within: tuple[str, ...] = ()
) -> DataFrame:
    """Key prefixes in which a wanted rank falls: their rows, least key, the cut and the rank left inside.

    The histogram has a row per stratum and prefix, and no input row is repeated. ``ranks`` has the
    wanted ranks of a stratum (inside the prefix ``within`` that an earlier step found) as one array, or
    adds them to the histogram.
    """
    bucket = F.substring("__key", 1, digits).alias("__bucket")
    histogram = rows.groupBy(stratum, *within, bucket).agg(F.count("*").alias("__n"), F.min("__key").alias("__least"))
    running = Window.partitionBy(stratum, *within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = histogram.withColumn("__upto", F.sum("__n").over(running))
    wanted = upto.join(ranks, [stratum, *within]) if isinstance(ranks, DataFrame) else ranks(upto)
    before = F.col("__upto") - F.col("__n")
    inside = F.filter("__ranks", lambda r: (before < r["__rank"]) & (r["__rank"] <= F.col("__upto")))
    left = F.transform(inside, lambda r: F.struct(r["__cut"].alias("__cut"), (r["__rank"] - before).alias("__rank")))
    return wanted.select(stratum, "__bucket", "__n", "__least", F.inline(left))


def _open(met: DataFrame, stratum: str, name: str) -> DataFrame:
    """Prefixes of more than one row, with all the ranks that fall into each."""
    ranks = F.collect_list(F.struct("__cut", "__rank")).alias("__ranks")
    return met.where("__n > 1").groupBy(stratum, F.col("__bucket").alias(name)).agg(ranks)


def _cut_keys(keyed: DataFrame, stratum: str, wanted: dict[str, Column]) -> DataFrame:
    """Largest key inside each wanted rank, one row per stratum and cut.

    ``keyed`` has the stratum and ``__key``; ``wanted`` maps a cut name to a rank computed from
    ``__total``. A prefix of one row gives the key at once, as most do in small strata, of which there
    may be millions. A second histogram inside the other prefixes leaves one row in four billion to
    be ranked.
    """

    def from_total(upto: DataFrame) -> DataFrame:
        names = F.array(*[F.struct(F.lit(n).alias("__cut"), r.cast("long").alias("__rank")) for n, r in wanted.items()])
        total = F.sum("__n").over(Window.partitionBy(stratum))
        return upto.withColumn("__total", total).withColumn("__ranks", names)

    def found(met: DataFrame) -> DataFrame:
        return met.where("__n = 1").select(stratum, "__cut", F.col("__least").alias("__cut_key"))

    first = store(_met(keyed, stratum, PREFIX_DIGITS, from_total), "cuts")
    open_first = _open(first, stratum, "__first")
    near = keyed.withColumn("__first", F.substring("__key", 1, PREFIX_DIGITS)).join(open_first.drop("__ranks"), [stratum, "__first"])
    second = store(_met(near, stratum, 2 * PREFIX_DIGITS, open_first, ("__first",)), "cuts")
    open_second = _open(second, stratum, "__second")
    last = keyed.withColumn("__second", F.substring("__key", 1, 2 * PREFIX_DIGITS)).join(open_second, [stratum, "__second"])
    place = F.row_number().over(Window.partitionBy(stratum, "__second").orderBy("__key"))
    hit = F.filter("__ranks", lambda r: r["__rank"] == F.col("__row"))
    ranked = last.withColumn("__row", place).select(stratum, F.inline(hit), F.col("__key").alias("__cut_key"))
    return found(first).unionByName(found(second)).unionByName(ranked.drop("__rank"))


def _with_cuts(
    df: DataFrame, stratum: str, wanted: dict[str, Column]
) -> tuple[DataFrame, dict[str, Column]]:
    """Give every row of ``df`` its stratum's cut keys ('' when no row lies inside a cut)."""
    cuts = _cut_keys(df.select(stratum, "__key"), stratum, wanted)
    keys = [
        F.max(F.when(F.col("__cut") == name, F.col("__cut_key"))).alias(f"__{name}")
        for name in wanted
    ]
    joined = df.join(cuts.groupBy(stratum).agg(*keys), stratum, "left")
    return joined, {name: F.coalesce(F.col(f"__{name}"), F.lit("")) for name in wanted}


def _collected_cuts(keyed: DataFrame, stratum: str, wanted: dict[str, Column]) -> dict[tuple[str, str], Column]:
    """Cut keys by (stratum, cut) as literals, for one stratum or the three levels; '' without one."""
    found = _cut_keys(keyed.select(stratum, "__key"), stratum, wanted).collect()
    keys = {(r[stratum], r["__cut"]): r["__cut_key"] for r in found}
    return {pair: F.lit(key) for pair, key in keys.items()}


def exact_splits(
    df: DataFrame,
    train_size: float = 0.8,
    val_size: float = 0.1,
    test_size: float = 0.1,
    seed: int = 42,
    stratify_by: str | None = None,
) -> DataFrame:
    """Add ``split`` with exact sizes, over the table or in every stratum.

    The held-out part is ``ceil(n * (val + test))``, the test part ``ceil(held_out * ratio)``.
    Ids must be unique; rows that share an id share a split.
    """
    _check_sizes(train_size, val_size, test_size)
    held_out = val_size + test_size
    ratio = test_size / held_out if held_out > 0 else 0.0
    total = F.col("__total")
    rest = F.ceil(F.round(total * F.lit(held_out), 6))
    test = F.ceil(F.round(rest * F.lit(ratio), 6))
    wanted = {"train": total - rest, "validation": total - test}
    stratum = F.coalesce(F.col(stratify_by).cast("string"), F.lit("")) if stratify_by else F.lit("")
    keyed = df.withColumns({"__stratum": stratum, "__key": sample_key(seed)})
    if stratify_by:
        joined, cut = _with_cuts(keyed, "__stratum", wanted)
    else:
        joined, keys = keyed, _collected_cuts(keyed, "__stratum", wanted)
        cut = {name: keys.get(("", name), F.lit("")) for name in wanted}
    key = F.col("__key")
    split = (
        F.when(key <= cut["train"], "train")
        .when(key <= cut["validation"], "validation")
        .otherwise("test")
    )
    return joined.withColumn("split", split).select(*[c for c in df.columns if c != "split"], "split")


def ensure_splits(
    df: DataFrame, create: bool = True, stratify_by: str | None = None, **sizes: float
) -> DataFrame:
    """Keep an existing ``split`` column, else create one, else call everything ``train``."""
    if "split" in df.columns:
        return df
    if not create:
        return df.withColumn("split", F.lit("train"))
    if stratify_by:
        return exact_splits(df, stratify_by=stratify_by, **sizes)
    return assign_splits(df, **sizes)


def _draw_key(df: DataFrame, seed: int | str) -> Column:
    """The sample's key, and a hash of the whole row for rows that share an id."""
    return F.concat(sample_key(seed), F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0"))


def first_n(df: DataFrame, n: int, order: Sequence[str] = ("sample_id",)) -> DataFrame:
    """First n rows in order, for any n and any sortable columns, reading ``df`` once.

    Every task sorts its own rows and stores its first n with their places: no shuffle. Every
    ``step``-th stored key is a mark that stands for ``step`` rows, so n rows at least are up to the
    mark of rank ``ceil(n / step)``, and at most ``step`` rows per task more. For up to ``MARKS`` rows
    every key is a mark and the cut is exact; beyond, the few rows up to the mark are sorted and
    counted per range. Equal keys are told apart by task and place, nulls come first.
    """
    step = max(1, -(-n // MARKS))
    rank = -(-n // step)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    local = df.sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place})
    runs = store(local.where(F.col("__place") < n), "first-runs")

    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate([*order, "__part", "__place"])])
    marks = runs.where((F.col("__place") + 1) % step == 0).select(key.alias("__key"))
    last = marks.orderBy("__key").limit(rank).agg(F.when(F.count("*") == rank, F.max("__key")))
    near = runs.withColumn("__last", last.scalar()).where(F.col("__last").isNull() | (key <= F.col("__last"))).drop("__last")
    if step == 1:
        return near.orderBy(*order, "__part", "__place").select(*df.columns)

    ordered = near.orderBy(*order, "__part", "__place").drop("__part", "__place")
    placed = store(ordered.withColumns({"__part": F.spark_partition_id(), "__place": place}), "sorted")
    before, parts = 0, []
    for part, count in placed.groupBy("__part").count().orderBy("__part").collect():
        parts.append((part, before))  # a row for each sorted partition
        before += count
    offsets = df.sparkSession.createDataFrame(parts, "__part int, __before long")
    kept = placed.join(F.broadcast(offsets), "__part").where(F.col("__before") + F.col("__place") < n)
    return kept.select(*df.columns).orderBy(*order)


def uniform_sample(df: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """n rows without replacement, fewer only when the table is smaller.

    Rows that agree in every column are drawn together.
    """
    keyed = df.withColumns({"__key": _draw_key(df, seed), "__stratum": F.lit("")})
    cuts = _collected_cuts(
        keyed, "__stratum", {"drawn": F.least(F.lit(n).cast("long"), F.col("__total"))}
    )
    return keyed.where(F.col("__key") <= cuts.get(("", "drawn"), F.lit(""))).select(*df.columns)


def step_sample(df: DataFrame, n: int, step: int, seed: int = 42) -> DataFrame:
    """A fresh draw for every evaluation step."""
    return uniform_sample(df, n, f"{seed}|{step}")


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """First n rows of every group, in two ranked stages.

    Meant for small n: up to 1,000 Spark drops rows before the shuffle. The first stage ranks inside
    salted slices, so the last one sees at most n rows per slice of a group, however large the group.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*columns), F.lit(SALTS)))
    slices = Window.partitionBy(*group, "__salt").orderBy(*columns)
    whole = Window.partitionBy(*group).orderBy(*columns)
    return (
        salted.withColumn("__rank", F.row_number().over(slices))
        .where(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(whole))
        .where(F.col("__rank") <= n)
        .drop("__salt", "__rank")
    )


def examples_per_level(df: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """n random samples of each complexity level."""
    levels = df.where(F.col("complexity").isin(*LEVELS)).withColumn("__key", sample_key(seed))
    return top_n_per_group(levels, ["complexity"], ["__key", "sample_id"], n).drop("__key")


def allocation(counts: dict[str, int], n: int) -> dict[str, int]:
    """Rows to draw per level: a proportional share, at least one; what is left goes to the
    largest level. The minimum of one may lift the sum above n."""
    present = {level: counts[level] for level in LEVELS if counts.get(level)}
    total = sum(present.values())
    if not total:
        return {}
    shares = {level: max(1, int(n * (c / total))) for level, c in present.items()}
    missing = n - sum(shares.values())
    if missing > 0:
        shares[max(present, key=present.get)] += missing
    return shares


def evaluation_set(df: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """A sample of about n rows, stratified by complexity when there is such a column.

    Reads the level counts (three rows) first; they become literals of the second job.
    """
    if "complexity" not in df.columns:
        return uniform_sample(df, n, seed)
    levels = df.where(F.col("complexity").isin(*LEVELS))
    counts = {r["complexity"]: r["n"] for r in levels.groupBy("complexity").agg(F.count("*").alias("n")).collect()}
    shares = allocation(counts, n)
    if not shares:
        return df.limit(0)
    keyed = levels.withColumn("__key", _draw_key(df, seed))
    wanted = {level: F.least(F.lit(s).cast("long"), F.col("__total")) for level, s in shares.items()}
    cuts = _collected_cuts(keyed, "complexity", wanted)
    keep = F.lit(False)
    for level in shares:
        own = cuts.get((level, level), F.lit(""))
        keep = keep | ((F.col("complexity") == level) & (F.col("__key") <= own))
    return keyed.where(keep).select(*df.columns)
