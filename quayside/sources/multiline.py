"""CSV files with line feeds inside quotes, read in splits.

A reader that parses such a file from its start cannot be split.  Here the file is
read by lines from byte ranges, as plain text is.  Each line has a parity of quotes;
running sums of parity, within a range by its own lines and between ranges by one
number a range, tell which line feeds stand inside quotes.  A record begins at a line
with none open; its lines come together by the place of the first one and are parsed
as one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, block, pos, record): the records of CSV files with the place where each begins, the byte range and the line in it.

    Quotes inside a field are doubled, and fields without quotes have none, as RFC 4180
    has it.  An open quote that nothing closes makes the rest of its file one record.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value",
        ((F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2).alias("odd"),
    )
    within = Window.partitionBy("file", "block").orderBy("id")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("pos", F.row_number().over(within)).withColumn("open", F.sum("odd").over(upto) - F.col("odd"))
    ranges = Window.partitionBy("file").orderBy("block")  # a row for each byte range
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    starts = lambda parity: F.max(F.when(F.col("open") % 2 == parity, F.col("pos")))
    blocks = placed.groupBy("file", "block").agg(F.sum("odd").alias("odd"), starts(0).alias("last0"), starts(1).alias("last1"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    last = F.when(F.col("before") == 0, F.col("last0")).otherwise(F.col("last1"))  # the last line of the range that begins a record
    blocks = blocks.withColumn("last", F.when(last.isNotNull(), F.struct("block", last.alias("pos")))).withColumn("from", F.last("last", ignorenulls=True).over(earlier))
    met = placed.join(blocks.select("file", "block", "before", "from"), ["file", "block"])
    own = F.last(F.when((F.col("open") + F.col("before")) % 2 == 0, F.struct("block", "pos")), ignorenulls=True).over(upto)
    begun = met.withColumn("at", F.coalesce(own, "from"))
    line = F.struct("block", "pos", "value")
    whole = begun.groupBy("file", "at").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return whole.select("file", "at.block", "at.pos", F.regexp_replace(text, "\r$", "").alias("record"))


def read_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True, quote: str = '"', **options: str) -> DataFrame:
    """The rows of CSV files with declared columns; cells that do not fit are null, empty lines no rows, and with `header` each file's first record is none."""
    found = records(spark, path, quote).filter(F.col("record") != "")
    if header:
        found = found.filter(~((F.col("block") == 0) & (F.col("pos") == 1)))
    parsed = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"quote": quote, "escape": quote, "mode": "PERMISSIVE"} | options)
    return found.select(parsed.alias("row")).select("row.*")
