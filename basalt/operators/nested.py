"""Nested genome rows: exploding aligned arrays, gathering back, and the filters around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.tables import ensure_checkpoint_dir

PROTEIN_COLUMNS = ("protein_sequence", "protein_sequences", "sequence")
DNA_COLUMNS = ("sequence", "dna_seq", "dna_sequence")


def resolve_column(df: DataFrame, names: Sequence[str]) -> str:
    """The first of ``names`` that ``df`` has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)} is present")


def row_slice(df: DataFrame, key: str, start: int, end: int | None = None) -> DataFrame:
    """Rows [start, end) in the order of ``key``: rows are dealt out by ranges of the key, ranges are counted, and each task
    numbers its own range from where the ranges before it end."""
    if end is not None and end <= start:
        raise ValueError("the slice is empty")
    ensure_checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for row in ranged.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a range
        offsets.append((row["p"], before))
        before += row["count"]
    if not offsets:
        return df
    first = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p long, _first long"))
    numbered = ranged.join(first, part == F.col("_p")).withColumn("_n", F.col("_first") + place)
    kept = numbered.filter((F.col("_n") >= start) & (F.lit(True) if end is None else F.col("_n") < end))
    return kept.select(*df.columns)


def explode_aligned(df: DataFrame, columns: Sequence[str], index: str = "gene_idx") -> DataFrame:
    """One row per element of equally long arrays; arrays of unequal length raise."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(columns[0]) == F.size(c))
    rest = [c for c in df.columns if c not in columns]
    checked = df.filter(F.assert_true(same, "arrays of unequal length").isNull())
    zipped = checked.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias(index, "_row"))
    return zipped.select(*rest, index, *(F.col("_row")[c].alias(c) for c in columns))


def explode_contigs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Genome rows of doubly nested arrays to one row per contig, with ``contig_idx``."""
    return explode_aligned(df, columns, "contig_idx")


def gather(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str | None = None) -> DataFrame:
    """Values back in lists, ordered by ``index``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(name or value))


def as_one_contig(column: Column) -> Column:
    return F.array(column)


def only_contig(column: Column) -> Column:
    return F.element_at(column, 1)


def pick(values: Column, places: Column) -> Column:
    """values[p] for each 0-based place; null where there is none."""
    return F.transform(places, lambda p: F.get(values, p))


def windows_of(values: Column, size: int) -> Column:
    """All runs of ``size`` consecutive elements."""
    return F.when(F.size(values) >= size, F.transform(F.sequence(F.lit(1), F.size(values) - size + 1), lambda i: F.slice(values, i, size))).otherwise(F.array())


def join_contigs(column: Column) -> Column:
    return F.array_join(column, " ")


def contig_names(count: Column) -> Column:
    names = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("contig_"), (i - 1).cast("string")))
    return F.when(count > 0, names).otherwise(F.array().cast("array<string>"))


def feature_ids(df: DataFrame, contig: str, start: str) -> DataFrame:
    """``feature_id``: contig and the feature's number in the order of its start."""
    place = F.row_number().over(Window.partitionBy(contig).orderBy(start))
    return df.withColumn("feature_id", F.concat(F.col(contig).cast("string"), F.lit("_"), place.cast("string")))


def yes_no(column: Column) -> Column:
    return F.when(column == "Yes", 1).when(column == "No", 0)


def one_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of a split; ``val`` and ``validation`` are the same split."""
    names = ("val", "validation") if split in ("val", "validation") else (split,)
    return df.filter(F.col("split").isin(*names))


def padded(values: Column, size: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, F.greatest(size - F.size(values), F.lit(0)).cast("int")))


def inner_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that must neither lose nor multiply rows of ``left``."""
    lost = left.join(right, key, "left_anti").limit(1).count()
    repeated = right.groupBy(key).count().filter("count > 1").limit(1).count()
    if lost or repeated:
        raise ValueError(f"the join on {key} would change the number of rows")
    return left.join(right, key)
