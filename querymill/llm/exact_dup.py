"""Exact duplicates by progressive refinement: equal length, then equal prefix, then equal full hash.

One scan keeps a length and a prefix hash per row. Lengths that occur once need nothing more; rows of
the others are grouped by prefix hash, and only rows of prefixes that occur again have their whole
content hashed and shuffled (as a digest). What survives a step is passed on as a bitmap over hashed
keys of fixed size, so the next scan filters rows without a shuffle; a false hit costs one more digest
and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.storage import store

#: Characters of the prefix.
PREFIX = 64
#: Bits of a survivor bitmap: 2,048 rows of 4 KB, whatever the table.
BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty. Texts of ASCII alone take the cheaper function."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps of the hashed keys that occur in two rows or more: at most ``BITS`` bits in all."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    place = again.select(F.pmod(F.xxhash64(*keys), F.lit(BITS)).alias("place"))
    return place.groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bitmap")
    )


def _survives(rows: DataFrame, bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Add ``_again``: whether the bitmap has the row's key."""
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    probed = rows.withColumns({"_place": F.bitmap_bit_position(place), "_bucket": F.bitmap_bucket_number(place)})
    byte = F.conv(F.hex(F.expr("substring(_bitmap, int(_place div 8) + 1, 1)")), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("int(shiftleft(1, int(_place % 8)))")) > 0
    joined = probed.join(F.broadcast(bitmaps), "_bucket", "left")
    return joined.withColumn("_again", F.coalesce(bit, F.lit(False))).drop("_bucket", "_bitmap", "_place")


def mark(docs: DataFrame, *, keep: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``keep_id``, ``group_size`` and ``kept``.

    Rows whose texts are equal after lower-casing A-Z are a group, null counts as empty. Its row with
    the largest id stays; ids that are null come last, and of rows that share id and text exactly one
    stays. Columns: those of ``docs`` (input columns of the three names are replaced), or the id and
    the expressions in ``keep`` over ``docs``, so that texts need not be carried. An empty table gives
    no rows.
    """
    text = normalised(F.col(text_col))
    length, prefix = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(F.substring(text, 1, PREFIX))
    keys = store(docs.select(length.alias("_length"), prefix.alias("_prefix")), "lengths")
    rivals = _survives(keys, _repeated(keys, "_length"), "_length").where("_again").drop("_again")
    bitmaps = store(_repeated(rivals, "_length", "_prefix"), "prefixes")

    added = ["keep_id", "group_size", "kept"]
    carried = [F.col(f"`{c}`") for c in docs.columns if c not in added] if keep is None else [F.col(id_col), *[e.alias(n) for n, e in keep.items()]]
    names = [c for c in docs.columns if c not in added] if keep is None else [id_col, *keep]
    row = F.struct(*carried).alias("_row")
    probed = _survives(docs.select(row, text.alias("_text"), length.alias("_length"), prefix.alias("_prefix")), bitmaps, "_length", "_prefix")
    full = F.when(F.col("_again"), F.sha2(F.col("_text"), 256))
    hashed = store(probed.select("_row", full.alias("_full"), F.monotonically_increasing_id().alias("_token")), "hashed")

    own = F.col(f"_row.`{id_col}`")
    best = F.max(F.struct(own.isNotNull().alias("named"), own.alias("id"), F.col("_token").alias("token")))
    groups = hashed.where("_full IS NOT NULL").groupBy("_full").agg(F.count("*").alias("group_size"), best.alias("_best"))
    groups = store(groups.where("group_size > 1"), "groups")
    found = hashed.where("_full IS NOT NULL").join(groups.hint("merge"), "_full", "left")
    alone = hashed.where("_full IS NULL").withColumns({"group_size": F.lit(None).cast("long"), "_best": F.lit(None).cast(groups.schema["_best"].dataType)})
    rows = found.unionByName(alone.select(*found.columns))
    single = F.col("group_size").isNull()
    return rows.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names],
        F.when(single, own).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("_best.token") == F.col("_token"))).alias("kept"),
    )


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all columns, one of each group."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    carried = docs.select(F.struct(*names).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_own"))
    kept = mark(carried, keep={"_doc": F.col("_doc")}, id_col="_id", text_col="_own").where("kept")
    return kept.select("_doc.*")
