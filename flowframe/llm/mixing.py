"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With weights a_i / Q (sum of a_i = Q), block j of source i is
released in slot floor(j * Q / a_i) and due before slot ceil((j + 1) * Q / a_i); each slot takes
the released block with the earliest deadline. Then in any prefix of the schedule every source is
within one block of its weight. The weights are taken as they are, as ratios of integers, so
deviations do not add up however long the schedule is.

The schedule needs the sources' weights and row counts only: the driver makes it, a block at a
time with two heaps, and keeps 12 bytes a block. Rows are numbered and placed in DataFrame
operations. ``quantised`` and ``period`` are for weights of a fixed resolution, whose schedule repeats.
"""

from __future__ import annotations

import heapq
from array import array
from functools import reduce
from math import gcd, inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowframe.llm.common import column_name, materialize

#: Slots in a period where weights are made multiples of 1 / RESOLUTION.
RESOLUTION = 1000
#: Blocks of the schedule that the driver hands over at once; a longer one goes to the shared folder in parts.
PLAN_BLOCKS = 1 << 20
#: Blocks up to which the schedule is sent to every task, 8 bytes a block; beyond it rows meet it in a shuffled join.
BROADCAST_BLOCKS = 4 << 20
BLOCK_ROWS = 8
#: Rows that one bucket of a source has on average when documents are numbered.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256
#: Rows of a run of slots that one task orders.
RUN_ROWS = 10_000


def quantised(weights: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, units long) with units of 1 / resolution by largest remainder, ties to the smaller name.

    weights: (source string, weight double), at most ``resolution`` rows, else an error. Null,
    non-finite and non-positive weights get none. Each source of positive weight gets one unit at
    least. Works in one task, over at most ``resolution`` rows.
    """
    w = weights.where("weight > 0 AND weight < double('Infinity')")
    total = w.agg(F.collect_list(F.struct("source", "weight")).alias("all")).where(F.size("all") > 0)
    few = F.when(F.size("all") > resolution, F.raise_error(F.lit(f"more than {resolution} sources; raise resolution"))).otherwise(F.col("all"))
    # sums of doubles depend on their order: add up by name
    ordered = total.select(F.array_sort(few).alias("all"))
    shares = ordered.withColumn("sum", F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["weight"]))
    spare = F.lit(resolution) - F.size("all")
    exact = shares.select(F.transform("all", lambda x: F.struct(x["source"].alias("source"), (x["weight"] * spare / F.col("sum")).alias("share"))).alias("all"))
    floors = exact.select(F.posexplode("all").alias("k", "x"), F.aggregate("all", F.lit(0).cast("bigint"), lambda acc, x: acc + F.floor(x["share"])).alias("given"), (F.lit(resolution) - F.size("all")).alias("spare"))
    by_rest = Window.partitionBy("spare").orderBy(F.desc(F.col("x.share") - F.floor("x.share")), "k")
    return floors.withColumn("rank", F.row_number().over(by_rest)).select(
        F.col("x.source").alias("source"),
        (F.floor("x.share") + 1 + F.when(F.col("rank") <= F.col("spare") - F.col("given"), 1).otherwise(0)).cast("bigint").alias("units"))


def period(units: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """(source, units, k, slot): the slot of each source's k-th block in one period.

    Earliest deadline first over Q slots, ties to the smaller name, as one fold over the slots; its
    state is a count for each source. At most ``resolution`` rows, in one task.
    """
    listed = units.agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("s")).where(F.size("s") > 0)
    q = F.lit(resolution)

    def step(acc, t):
        # of the released blocks the one due first, as (deadline, place of the source)
        due = F.transform("s", lambda x, i: F.struct(
            F.when(F.floor(acc["n"][i] * q / x["units"]) <= t, F.ceil((acc["n"][i] + 1) * q / x["units"])).otherwise(F.lit(1 << 40)).alias("d"), i.alias("i")))
        best = F.array_min(due)["i"]
        return F.struct(F.transform(acc["n"], lambda n, i: n + F.when(i == best, 1).otherwise(0)).alias("n"),
                        F.concat(acc["out"], F.array(F.struct(F.col("s")[best]["source"].alias("source"), F.col("s")[best]["units"].alias("units"), acc["n"][best].alias("k"), t.alias("slot")))).alias("out"))

    kind = units.schema["source"].dataType
    row = T.StructType([T.StructField("source", kind), T.StructField("units", T.LongType()), T.StructField("k", T.LongType()), T.StructField("slot", T.LongType())])
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("bigint")).alias("n"), F.array().cast(T.ArrayType(row)).alias("out"))
    slots = F.sequence(F.lit(0).cast("bigint"), F.lit(resolution - 1).cast("bigint"))
    return listed.select(F.explode(F.aggregate(slots, start, step)["out"]).alias("x")).select("x.*")


def integers(weights: list[float]) -> list[int]:
    """Integers in exactly the ratios of the weights, which are positive and finite."""
    ratios = [w.as_integer_ratio() for w in weights]
    common = max((d for _, d in ratios), default=1)  # powers of two
    out = [n * (common // d) for n, d in ratios]
    least = gcd(*out) or 1
    return [x // least for x in out]


def schedule(shares: list[int], rows: list[int], block_rows: int) -> tuple[array, array, int]:
    """(source, block) of each slot, and the first slot for which a source has no full block left.

    Earliest deadline first, ties to the smaller place in the list. From that slot on the blocks
    that are left follow by deadline, without gaps.
    """
    owner, block, done, q = array("i"), array("q"), [0] * len(shares), sum(shares)
    due = lambda i: (-(-(done[i] + 1) * q // shares[i]), i)
    waiting, ready, end = [(0, i) for i in range(len(shares))], [], 0

    def take(i):
        owner.append(i)
        block.append(done[i])
        done[i] += 1

    while shares:
        while waiting and waiting[0][0] <= end:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, due(i))
        i = ready[0][1]  # there is one: by slot t all sources together have more than t blocks released
        if done[i] == rows[i] // block_rows:
            break
        heapq.heappop(ready)
        take(i)
        heapq.heappush(waiting, (done[i] * q // shares[i], i))
        end += 1
    left = lambda i: done[i] * block_rows < rows[i]
    rest = [due(i) for i in range(len(shares)) if left(i)]
    heapq.heapify(rest)
    while rest:
        i = rest[0][1]
        take(i)
        if left(i):
            heapq.heapreplace(rest, due(i))
        else:
            heapq.heappop(rest)
    return owner, block, end


def plan_table(spark: SparkSession, names: list[str | None], owner: array, block: array, columns: tuple[str, str, str]) -> DataFrame:
    """(source, block, slot) as a table."""
    source, number, slot = columns
    kind = T.StructType([T.StructField(source, T.StringType()), T.StructField(number, T.LongType()), T.StructField(slot, T.LongType())])
    spelt, parts = pa.array(names, pa.string()), []
    for at in range(0, len(owner), PLAN_BLOCKS):
        some = pa.array(owner[at:at + PLAN_BLOCKS], pa.int32())
        parts.append(spark.createDataFrame(pa.table({source: spelt.take(some), number: pa.array(block[at:at + PLAN_BLOCKS], pa.int64()), slot: pa.array(range(at, at + len(some)), pa.int64())}), kind))
        if len(owner) > PLAN_BLOCKS:
            parts[-1] = materialize(parts[-1], "mixing-plan")
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], kind)


def slot_lists(spark: SparkSession, names: list[str | None], owner: array, columns: tuple[str, str]) -> DataFrame:
    """(source, slots of its blocks in order) as a table."""
    slots = [array("q") for _ in names]
    for t, i in enumerate(owner):
        slots[i].append(t)
    kind = T.StructType([T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.ArrayType(T.LongType()))])
    return spark.createDataFrame(pa.table({columns[0]: pa.array(names, pa.string()), columns[1]: pa.array(slots, pa.list_(pa.int64()))}), kind)


def numbered(docs: DataFrame, source: str, id_col: str, place: str) -> DataFrame:
    """Adds ``place``: the row's number in its source, from 0, in the order of the ids' MD5 digests.

    Rows are dealt over buckets of a source by ranges of the digest, ranked inside them, and shifted
    by the counts of the buckets before: no source meets in one task, however large.
    """
    bucket, mixed, n, shift, label = (column_name(docs, c) for c in ("bucket", "mixed", "n_in_bucket", "shift", "source_label"))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    # a key without nulls, so that the join below finds its rows where the window left them
    named = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    rows = docs.withColumn(mixed, key).withColumn(bucket, F.floor(F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))).withColumn(label, named)
    counts = rows.groupBy(label, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(label).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(label, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    inside = Window.partitionBy(label, bucket).orderBy(mixed, id_col)
    ranked = rows.withColumn(place, F.row_number().over(inside) - 1)
    return ranked.join(shifts, [label, bucket]).withColumn(place, F.col(place) + F.col(shift)).drop(label, shift, bucket, mixed)


def tempered(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """Target weights by the square root of a source's rows: large sources count less than in proportion."""
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id",
        block_rows: int = BLOCK_ROWS, resolution: int | None = None) -> DataFrame:
    """All rows of docs with their place in the mixture: adds block_no, slot, within (long) and in_balance (boolean).

    Ordering by (slot, within) interleaves the sources. Blocks are ``block_rows`` documents of one
    source in a hashed order; the last may be smaller. in_balance holds for slots before the first
    source runs out, one without rows at its first slot: up to there every prefix of slots is within
    one block of the targets. Later blocks follow by their deadlines, so no row is lost.
    weights: (source, weight); None: square roots of the row counts. With a ``resolution`` weights
    are first made multiples of 1 / resolution. Rows of sources without a
    positive weight get null slots and in_balance false. A null source is a source of its own; it
    takes part when weights has a null source. Repeated and null ids are rows like others. Columns
    of docs named as the results are replaced. A row for each source comes to the driver.
    """
    docs = docs.drop("block_no", "slot", "within", "in_balance")
    place, name = column_name(docs, "place"), column_name(docs, "source_name")
    label = docs.withColumn(name, F.col(source_col).cast("string"))
    weights = tempered(docs, source_col) if weights is None else weights.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("double").alias("weight"))
    weights = weights.groupBy("source").agg(F.max("weight").alias("weight"))
    if resolution is not None:
        weights = quantised(weights, resolution).select("source", F.col("units").cast("double").alias("weight"))
    held = {r[0]: r[1] for r in label.groupBy(name).count().collect()}
    given = {r.source: r.weight for r in weights.collect() if r.weight is not None and 0 < r.weight < inf}
    names = sorted(given, key=lambda s: (s is not None, (s or "").encode()))
    owner, block, end = schedule(integers([given[s] for s in names]), [held.get(s, 0) for s in names], block_rows)
    columns = p_source, p_block, p_slot = tuple(column_name(docs, c) for c in ("p_source", "p_block", "p_slot"))
    rows = numbered(label, name, id_col, place)
    rows = rows.withColumn("block_no", F.floor(F.col(place) / block_rows)).withColumn("within", F.col(place) % block_rows)
    same, slot = F.col(name).eqNullSafe(F.col(p_source)), F.col(p_slot)
    if len(owner) <= BROADCAST_BLOCKS:
        rows = rows.join(F.broadcast(slot_lists(docs.sparkSession, names, owner, (p_source, p_slot))), same, "left")
        slot = F.get(slot, F.col("block_no").cast("int"))
    else:
        plan = plan_table(docs.sparkSession, names, owner, block, columns)
        rows = rows.join(plan, same & (F.col("block_no") == F.col(p_block)), "left")
    return rows.select(*docs.columns, "block_no", slot.alias("slot"), F.col("within"), F.coalesce(slot < end, F.lit(False)).alias("in_balance"))


def in_order(mixed: DataFrame, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", rows: int | None = None) -> DataFrame:
    """The rows of mix() in the order of their places: those of one partition before those of the next.

    ``rows`` is their number where it is known, as that of what was mixed; else they are counted. Slots are dealt to partitions in runs of equal length, so there is no pass to find their bounds.
    Rows without a slot come last, dealt over as many partitions again.
    """
    part = column_name(mixed, "run")
    rows = mixed.count() if rows is None else rows
    runs = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RUN_ROWS))
    # an estimate is enough: later slots share the last run
    slots = max(1, -(-rows // block_rows))
    own = F.least(F.lit(runs - 1), F.floor(F.col("slot") * runs / slots))
    rest = runs + F.pmod(F.xxhash64(id_col), F.lit(runs))
    dealt = mixed.withColumn(part, F.coalesce(own, rest).cast("int")).repartitionById(2 * runs, F.col(part))
    return dealt.sortWithinPartitions(part, F.col("slot").asc_nulls_last(), "within", id_col).drop(part)
