"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to a few bits, in the order of its values: numbers by quantiles of all rows, other values by
runs that begin at the most frequent ones. The cell's index on the curve orders the rows; runs of that order are the shards,
so a shard covers a compact region of all dimensions at once and its files' least and greatest values prune by any of them.
Rows of one group (equal texts) take the metadata of the group's first row and lie next to each other; a shard boundary may
cut a group, as the laws `rows` and `bytes` ask for it.

DataFrame functions only. Null metadata has the lowest bucket; null text has size 1 (0 bytes plus 1) and is a group of its
own; very long texts leave the scan as their size and hashes; ties in everything are ordered by key and are
interchangeable, repeated rows among them. An empty table gives an empty result. Other columns play no part, whatever their
names; in write(), the placement takes the place of a column `shard`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, materialise, packed


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve of len(point) dimensions with 2^bits cells a side.

    From the largest subcubes down: in the frame of the current subcube (where the curve enters it, and along which
    axis it leaves), the next bit of each coordinate picks a subcube, whose rank is the inverse Gray code.
    """
    n, enter, axis, index = len(point), 0, 0, 0
    mask = (1 << n) - 1
    for level in reversed(range(bits)):
        corner = sum((x >> level & 1) << k for k, x in enumerate(point))
        turn = (axis + 1) % n
        corner ^= enter
        gray = (corner >> turn | corner << (n - turn)) & mask
        rank = 0
        while gray:
            rank ^= gray
            gray >>= 1
        index = index << n | rank
        # where the curve enters that subcube, and which way it leaves
        first = (rank - 1) // 2 * 2 if rank else 0
        first ^= first >> 1
        enter ^= (first << turn | first >> (n - turn)) & mask
        odd = rank if rank & 1 else rank - 1
        ones = 0
        while rank and odd >> ones & 1:
            ones += 1
        axis = (axis + ones + 1) % n
    return index


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Expressions of the buckets 0 .. 2^bits - 1 of each dimension, in the order of its values; null is in the lowest.

    The driver gets 2^bits - 1 bounds a dimension: quantiles of all rows for numbers; for other types the most frequent
    values, each of which begins a bucket that ends before the next.
    """
    sides = 1 << bits
    numbers = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    bounds = {}
    if numbers:
        shares = F.array(*[F.lit(k / sides) for k in range(1, sides)])
        row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, F.lit(10_000)).alias(d) for d in numbers]).first()
        bounds = {d: row[d] or [] for d in numbers}
    out = []
    for d in dims:
        x = F.col(d).cast("double") if d in bounds else F.col(d).cast("string")
        if d not in bounds:
            often = df.filter(x.isNotNull()).groupBy(x.alias("_value")).count().orderBy(F.desc("count"), "_value").limit(sides - 1)
            bounds[d] = [r["_value"] for r in often.collect()]
        passed = [(x >= F.lit(b) if isinstance(b, str) else x > F.lit(b)).cast("int") for b in sorted(bounds[d])]
        out.append(sum((F.coalesce(p, F.lit(0)) for p in passed), F.lit(0)))
    return out


def hilbert_order(docs: DataFrame, dims: list[str], bits: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row a document, materialised, with its place: _part and _at give the order, _part first.

    The text is read once and leaves the scan as its size and hashes. The cells' table has 2^(bits * dims) rows, at
    most 65,536, and is broadcast.
    """
    if bits * len(dims) > 16:
        raise ValueError("more than 65,536 cells")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(docs.select(
        F.col(key).alias("_key"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit(-1)).otherwise(F.xxhash64(text)).alias("_group"),
    ))
    group = ["_group", "text_crc32", "size"]
    names = [f"_d{i}" for i in range(len(dims))]
    cell = F.lit(0)
    for bucket in quantised(rows, names, bits):
        cell = cell * (1 << bits) + bucket
    rows = rows.withColumn("_cell", cell).drop(*names)
    # groups of several rows whose cells differ take that of their first row
    mixed = materialise(
        rows.groupBy(*group).agg(F.min("_cell").alias("_a"), F.max("_cell").alias("_b"), F.min(F.struct("_key", "_cell")).alias("_first"))
        .filter("_a <> _b").select(*group, F.col("_first._cell").alias("_shared"))
    )
    rows = joined(rows, mixed, group, "left").withColumn("_cell", F.coalesce("_shared", "_cell")).drop("_shared")
    sides, cells = 1 << bits, []
    for c in range(sides ** len(dims)):
        point, rest = [], c
        for _ in dims:
            point.append(rest % sides)
            rest //= sides
        cells.append((c, curve_index(tuple(point), bits)))
    table = spark.createDataFrame(cells, "_cell int, _curve int")
    order = ["_curve", "_group", "_key", "text_crc32"]
    spread = rows.join(F.broadcast(table), "_cell").repartitionByRange(n, *order).sortWithinPartitions(*order)
    # sampled range bounds differ from run to run: fixed in files before anything is counted on them
    numbered = materialise(spread.withColumn("_id", F.monotonically_increasing_id()))
    return numbered.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).withColumnRenamed("_key", key).drop("_id")


def cut(ordered: DataFrame, shards: int, law: str = "rows") -> DataFrame:
    """ordered with shard and slot. law: `rows` (counts at most one apart) or `bytes` (sizes near equal).

    Each part's count and size go to the driver, one row a part, and come back as offsets.
    """
    spark = ordered.sparkSession
    parts = sorted((r["_part"], r["n"], r["b"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    offsets, rows, size = [], 0, 0
    for part, n, b in parts:
        offsets.append((part, rows, size))
        rows, size = rows + n, size + b
    table = F.broadcast(spark.createDataFrame(offsets, "_part bigint, _rows bigint, _bytes bigint"))
    at = ordered.join(table, "_part").withColumn("_rank", F.col("_rows") + F.col("_at"))
    if law == "rows":
        shard = F.expr(f"cast(_rank * {shards} div {max(rows, 1)} as int)")
        first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
        return at.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_rows", "_bytes", "_rank")
    from pyspark.sql import Window

    before = F.col("_bytes") + F.sum("size").over(Window.partitionBy("_part").orderBy("_at")) - F.col("size")
    sized = materialise(at.withColumn("shard", F.least(F.lit(shards - 1), (before * shards / F.lit(float(max(size, 1)))).cast("int"))))
    firsts = sized.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return sized.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rows", "_bytes", "_rank", "_first")


def shard(docs: DataFrame, dims: list[str], shards: int, law: str = "rows", bits: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot for each row of docs."""
    out = cut(hilbert_order(docs, dims, bits, key, text), shards, law)
    return out.select(key, "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.col("_curve").alias("curve"))


def write(docs: DataFrame, placed: DataFrame, path: str, rows_per_file: int = 100_000, key: str = "doc_id") -> None:
    """docs, one row a key, into path/shard=K in curve order, several files a shard, each a run of the order."""
    slots = placed.select(F.col(key).alias("_k"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.expr(f"slot div {rows_per_file}").alias("_file"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(docs, _key=F.col(key)).join(slots, F.col("_key").eqNullSafe(F.col("_k")))
    rows = rows.repartitionByRange(n, "_shard", "_file", "_slot").sortWithinPartitions("_shard", "_slot")
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "shard"]
    rows.select(*columns, F.col("_shard").alias("shard")).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
