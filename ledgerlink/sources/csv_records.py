"""Records of CSV files with quoted line breaks, in file order, from splits that are read in parallel (SRC-1).

A line break inside quotes does not end a record, and whether a line begins inside quotes depends on all lines before it.  Each line
is therefore described by what it does to the state (inside or outside quotes): set it, keep it or turn it.  Such steps combine,
so a split is described by one step too, and the state at its start follows from the splits before it in the file.
Files without an open quote at a line's end need none of this: there each line is a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A quoted field, with what may follow it up to the comma; and the rest of one that began on an earlier line.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"[^,"]*+(?=,|$)'
REST = r'^[^"]*+(?:""[^"]*+)*+"[^,]*+'
ROWS = 1 << 33
SPLIT = ["file", "start"]


def _open_after(line: Column) -> Column:
    """1 if a quote is open after a line that begins outside quotes."""
    return F.regexp_replace(line, QUOTED, "$1").rlike('(^|,)"').cast("int")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of the split), at (order inside the split), line, a and b: whether a quote is open after the line if none
    was before it, and if one was."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.monotonically_increasing_id() % ROWS).alias("at"), F.regexp_replace("value", "^\\ufeff", "").alias("line"),
    )
    closes = F.col("line").rlike(REST)
    after = _open_after(F.regexp_replace("line", REST, ""))
    return raw.withColumn("a", F.when(F.col("line").contains('"'), _open_after(F.col("line"))).otherwise(0)).withColumn("b", F.when(closes, after).otherwise(1))


def _states(df: DataFrame, key: list[str], order: str, begin: Column) -> DataFrame:
    """Adds before and after, the states around each row, given the state at the key's begin."""
    to_here = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("a") == F.col("b")
    out = df.withColumn("_turns", F.sum(F.when(~sets & (F.col("a") == 1), 1).otherwise(0)).over(to_here))
    out = out.withColumn("_set", F.last(F.when(sets, F.struct("a", F.col("_turns").alias("t"))), ignorenulls=True).over(to_here))
    after = F.when(F.col("_set").isNotNull(), (F.col("_set.a") + F.col("_turns") - F.col("_set.t")) % 2).otherwise((begin + F.col("_turns")) % 2)
    out = out.withColumn("after", after.cast("int"))
    return out.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(*key).orderBy(order)), begin)).drop("_turns")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """row_idx, record: the records of all files but their header records, in the order of the files' names; blank lines are left out."""
    every = lines(spark, path)
    splits = every.groupBy(*SPLIT).agg(F.min("at").alias("first"))
    # One row a split: ranked as a whole.
    splits = splits.withColumn("rank", F.row_number().over(Window.orderBy("file", "start")).cast("long"))
    every = every.join(splits, SPLIT).withColumn("row_idx", F.col("rank") * ROWS + F.col("at"))
    header = (F.col("start") == 0) & (F.col("at") == F.col("first"))
    quoted = every.where("a = 1").select("file").distinct()
    if quoted.isEmpty():
        return every.where(~header & (F.trim("line") != "")).select("row_idx", F.col("line").alias("record"))
    plain = every.join(quoted, "file", "left_anti").where(~header & (F.trim("line") != "")).select("row_idx", F.col("line").alias("record"))

    open_ = every.join(quoted, "file", "left_semi")
    # What a split does to either state at its begin.
    told = _states(open_, SPLIT, "at", F.lit(0))
    ends = told.groupBy(*SPLIT).agg(F.max_by("after", "at").alias("a"), F.max_by(F.col("_set").isNotNull(), "at").alias("fixed"))
    ends = ends.withColumn("b", F.when(F.col("fixed"), F.col("a")).otherwise(1 - F.col("a")))
    begins = _states(ends, ["file"], "start", F.lit(0)).select(*SPLIT, F.col("before").alias("begin"))
    placed = _states(open_.join(begins, SPLIT), SPLIT, "at", F.col("begin")).withColumn("starts", F.when(F.col("before") == 0, F.col("row_idx")))
    alone = placed.where("before = 0 and after = 0 and trim(line) <> ''").where(~header).select("row_idx", F.col("line").alias("record"))

    # Lines of records of several lines carry the place of the record's first line, which may be in an earlier split.
    parts = placed.withColumn("own", F.last("starts", ignorenulls=True).over(Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    last = placed.groupBy(*SPLIT).agg(F.max("starts").alias("last"))
    earlier = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.where("before = 1 or after = 1").join(last.select(*SPLIT, earlier.alias("earlier")), SPLIT).withColumn("own", F.coalesce("own", "earlier"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n")
    joined = parts.groupBy("own").agg(body.alias("record"), F.bool_or(header).alias("is_header")).where("not is_header")
    return plain.unionByName(alone).unionByName(joined.select(F.col("own").alias("row_idx"), "record"))
