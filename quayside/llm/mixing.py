"""Mixing sources to target weights by weighted fair queueing (operator 4).

Each source queues its documents in a shuffled order, up to `max_repeats` times
over.  A document's virtual finish time is the source's words up to and with it,
divided by the source's target.  All queues merge by range-sorting the finish
times, and the merged stream ends where the total budget does.

Every row has a place of its own in its queue: rows with the same id and size are
numbered, and the place is a hash of all three.  So nothing of a source's or an
id's size meets in one task: the shuffle order is cut into buckets whose number
grows with the source, each bucket's start comes from sums by bucket, and the
merged stream is cut into ranges of finish time, which fill evenly as every source
moves at its own target's pace and whose number grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, read_table
from quayside.operators.ranks import running_total

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, over and over.
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: So many sources are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Rows that a range of finish time between 0 and 1 holds, about, and the fewest ranges.
RANGE_ROWS, RANGES = 20_000, 2048
#: Rows that a bucket of the shuffle order holds, about.
BUCKET_ROWS = 2_000
#: Equal rows that one task numbers.
RUN = 1_000


def _sized(df: DataFrame, text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """`sources` with the weight of each by its place among them, by code point and null last."""
    named = sources.filter("source IS NOT NULL")
    n = named.count()
    if n <= BROADCAST_SOURCES:  # a row for each source
        at = named.withColumn("at", F.row_number().over(Window.orderBy("source")))
    else:
        dealt = named.repartitionByRange("source").sortWithinPartitions("source").withColumn("part", F.spark_partition_id())
        dealt = cut(dealt.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("source"))))
        ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(ahead, F.lit(0)).alias("before"))
        at = dealt.join(F.broadcast(starts), "part").withColumn("at", F.col("within") + F.col("before")).drop("part", "within", "before")
    last = sources.filter("source IS NULL").withColumn("at", F.lit(n + 1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (1 + (F.col("at") - 1) % len(WEIGHTS)).cast("int"))
    return at.unionByName(last).withColumn("weight", weight)


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rows, target) from (source, source_size, rows).

    A source's target is a share of all sizes by weight, at most `max_repeats` times
    its size.  Capped sources are those with the least cap per weight, so the level
    at which the others fill is found in that order: a source is capped as long as
    its cap is at most its share of what those before it leave.
    """
    rows = cut(_numbered(sources).withColumn("need", max_repeats * F.col("source_size") / F.col("weight")))
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    if total["weight"] is None:
        return rows.select("source", "source_size", "rows", F.lit(0.0).alias("target"))
    needs = rows.groupBy("need").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    if total["n"] <= BROADCAST_SOURCES:  # a row for each need; sources of equal need are all capped or none is
        ahead = Window.orderBy("need")
        upto = needs.withColumns({"sizes": F.sum("size").over(ahead), "weights": F.sum("weight").over(ahead)})
    else:
        upto = running_total(running_total(cut(needs), "need", "size", "sizes"), "need", "weight", "weights")
    rest = (F.lit(total["size"]) - max_repeats * (F.col("sizes") - F.col("size"))).alias("rest")
    weight = (F.lit(total["weight"]) - (F.col("weights") - F.col("weight"))).alias("left")
    steps = upto.select("need", rest, weight)
    level = steps.filter(F.col("need") * F.col("left") > F.col("rest")).orderBy("need").limit(1).first()
    cap = (max_repeats * F.col("source_size")).cast("double")
    if level is None:
        return rows.select("source", "source_size", "rows", cap.alias("target"))
    share = F.lit(float(level["rest"])) * F.col("weight") / F.lit(float(level["left"]))
    return rows.select("source", "source_size", "rows", F.when(F.col("need") < level["need"], cap).otherwise(share).alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`rows` with their source's columns of `plan`; Spark splits a large source where the plan is not broadcast."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = plan.withColumnRenamed("source", "name")
    return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def _spread(groups: DataFrame) -> DataFrame:
    """`n` rows of each of `groups`, numbered by `copy`, in runs that no task has to hold whole."""
    runs = groups.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN).cast("int"))))
    dealt = runs.filter(F.col("n") > RUN).repartition("source", "key", "run").unionByName(runs.filter(F.col("n") <= RUN))
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN)
    return dealt.withColumn("copy", F.explode(F.sequence(F.col("run").cast("long") * RUN + 1, last.cast("long")))).drop("run")


def place_of(key: Column, copy: Column) -> Column:
    """Where the copy-th row of a key stands in its queue."""
    return F.md5(F.concat_ws(":", key, copy.cast("string")))


def _finish(turn: int) -> Column:
    """Virtual finish time of a row in its source's turn-th round."""
    reach = F.col("reach") + turn * F.col("source_size")
    return F.when(F.col("target") > 0, reach.cast("double") / F.col("target")).otherwise(0.0)


def _end(own: DataFrame, budget: float, rows: int, max_repeats: int) -> float:
    """The last finish time up to which the merged stream stays within the budget."""
    ranges = max(RANGES, rows * max_repeats // RANGE_ROWS)
    stream = own.select("size", F.explode(F.array(*[_finish(e) for e in range(max_repeats)])).alias("finish"))
    late = 2 * ranges + F.floor(64 * F.log2(F.greatest("finish", F.lit(2.0))))  # wider ranges where the budget is long spent
    ranged = stream.withColumn("range", F.when(F.col("finish") < 2, F.floor(F.col("finish") * ranges)).otherwise(late))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("sum"), F.max("finish").alias("last"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = cut(sums.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0))))
    edge = starts.filter(F.col("before") <= budget).orderBy(F.desc("range")).limit(1).first()  # the budget ends in it, all before are whole
    if edge is None:
        return -1.0
    peers = ranged.filter(F.col("range") == edge["range"]).groupBy("range", "finish").agg(F.sum("size").alias("size"))
    within = peers.withColumn("reach", F.sum("size").over(Window.partitionBy("range").orderBy("finish")))
    last = within.filter(F.col("reach") + edge["before"] <= budget).agg(F.max("finish")).first()[0]
    if last is None:
        last = starts.filter(F.col("range") < edge["range"]).agg(F.max("last")).first()[0]
    return -1.0 if last is None else float(last)


def queued(groups: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): `groups` of n equal rows (source, key, size, n), spread, with place, source_size, target, reach and copies.

    `copies` says how often the merged stream takes a row.  A row without words is
    taken once, as it fills nothing.
    """
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    plan = cut(targets(cut(sources), max_repeats))
    total = plan.agg(F.sum("target"), F.sum("rows")).first()
    buckets = F.floor((F.col("rows") + BUCKET_ROWS - 1) / BUCKET_ROWS)
    part = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    spread = (
        _with_plan(_spread(groups), plan)
        .withColumn("place", place_of(F.col("key"), F.col("copy")))
        .withColumn("bucket", F.floor(part * buckets / F.lit(4294967296)))
        .withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    )
    sums = spread.groupBy("queue", "bucket").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0))).drop("sum")
    within = F.sum("size").over(Window.partitionBy("queue", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    own = spread.withColumn("within", within).join(starts, ["queue", "bucket"])
    own = cut(own.withColumn("reach", F.col("within") + F.col("before")).drop("queue", "bucket", "before", "within", "n", "rows"))
    end = _end(own, float(total[0] or 0), total[1] or 0, max_repeats)
    turns = sum((F.when(_finish(e) <= F.lit(end), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    copies = F.when((F.col("target") > 0) & (F.col("size") > 0), turns).otherwise(1).cast("int")
    return own.withColumn("copies", copies), plan


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies), a row for each row of `df`.

    A null or empty text has size 0 and is taken with 0 words.  A null source is a
    source of its own, the last.  Rows that agree in source, id and size are as many
    queue places, so null and repeated ids are taken like any other rows; which of
    such rows a place belongs to makes no difference.  Reruns agree.  An empty table
    gives no rows.  Other columns are not read.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), _sized(df, text_col).alias("size")
    )
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    groups = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", key))
    made, _ = queued(groups, max_repeats)
    return made.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_by_mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The rows of `df` as often as the mix takes them, with the columns that `df` has.

    A row's key is a hash of all its columns, so rows of one id have places of their
    own, and texts do not move: each source's queue is cut at one place for each
    round, and these places are broadcast.  Only of rows that come several times, all
    columns alike, a copy each is shuffled to be counted.  A text without words comes
    once, a null source is a source of its own, an empty table stays empty, and
    columns of any other names pass through.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index
    size = F.regexp_count(F.coalesce(F.col(f"c{at(text_col)}"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.hex(F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) if _mapped(f) else F.col(c) for c, f in zip(flat.columns, df.schema.fields, strict=True)], *[F.col(c).isNull() for c in flat.columns]))
    keyed = flat.withColumn("source", F.col(f"c{at(source_col)}").cast("string")).withColumn("size", size).withColumn("key", key)
    groups = cut(keyed.groupBy("source", "key", "size").agg(F.count("*").alias("n")))
    made, plan = queued(groups, max_repeats)
    full = made.filter((F.col("size") > 0) & (F.col("target") > 0))
    ends = full.groupBy("source").agg(*[F.max(F.when(F.col("copies") > e, F.col("place"))).alias(f"end{e}") for e in range(max_repeats)])
    edges = cut(plan.select("source", "target").join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    turns = lambda copy: sum((F.when(place_of(F.col("key"), copy) <= F.col(f"end{e}"), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    copies = lambda copy: F.when((F.col("size") > 0) & (F.col("target") > 0), turns(copy)).otherwise(1)
    repeated = cut(groups.filter("n > 1").select("source", "key", "n"))
    alone = keyed
    parts = []
    some = repeated.limit(BROADCAST_SOURCES + 1).count()
    if some:
        known = repeated.select("key").distinct()
        known = F.broadcast(known) if some <= BROADCAST_SOURCES else known
        alone = keyed.join(known, "key", "left_anti")
        once = keyed.join(known, "key", "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("n"))  # equal rows meet as counts
        taken = _with_plan(_spread(once), edges).withColumn("times", copies(F.col("copy")))
        parts.append(taken)
    parts.append(_with_plan(alone, edges).withColumn("times", copies(F.lit(1))))
    out = None
    for part in parts:
        rows = part.filter(F.col("times") > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*flat.columns)
        out = rows if out is None else out.unionByName(rows)
    return out.toDF(*df.columns).select(*names)


def _mapped(field) -> bool:
    """Whether a column holds maps, which Spark neither hashes nor compares."""
    return "map<" in field.dataType.simpleString()


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = f"""
WITH docs AS (
  SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || row_number() OVER (PARTITION BY source, doc_id, size)) AS place
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents)
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY source
), weighted AS (
  SELECT source, s, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w
  FROM src
), filled AS (
  SELECT *, row_number() OVER o AS k,
         (SELECT sum(s) FROM src) - coalesce(sum({MAX_REPEATS} * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         (SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
  FROM weighted WINDOW o AS (ORDER BY {MAX_REPEATS} * s / w, source NULLS LAST)
), level AS (
  SELECT k, rest, weight FROM filled WHERE {MAX_REPEATS} * s * weight > rest * w ORDER BY k LIMIT 1
), plan AS (
  SELECT f.source, f.s AS source_size,
         CASE WHEN l.k IS NULL OR f.k < l.k THEN CAST({MAX_REPEATS} * f.s AS DOUBLE)
              ELSE CAST(l.rest AS DOUBLE) * f.w / CAST(l.weight AS DOUBLE) END AS target
  FROM filled f LEFT JOIN level l ON true
), own AS (
  SELECT d.doc_id, d.size, p.source_size, p.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS reach
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), turns AS (
  SELECT size, CASE WHEN target > 0 THEN CAST(reach + e * source_size AS DOUBLE) / target ELSE 0.0 END AS finish
  FROM own, range({MAX_REPEATS}) AS r(e)
), merged AS (
  SELECT finish, sum(size) OVER (ORDER BY finish) AS reach FROM turns
), ended AS (
  SELECT coalesce(max(finish), -1.0) AS cutoff FROM merged WHERE reach <= (SELECT sum(target) FROM plan)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * ({' + '.join(f'(CASE WHEN CAST(reach + {e} * source_size AS DOUBLE) / target <= cutoff THEN 1 ELSE 0 END)' for e in range(MAX_REPEATS))}) AS BIGINT) AS taken
FROM own, ended
"""
