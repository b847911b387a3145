"""What the corpus operators share: reading, null handling, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators state it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of the session, or the
    one set for checkpoints. Only a local master may do without: its executors
    are the driver."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage, so that a
    lost executor does not cost the work before it. With
    spark.cleaner.referenceTracking.cleanCheckpoints the files go when the
    frame does."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's own file systems reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_order(df: DataFrame) -> Column:
    """A hash of the whole row: an order among rows that agree in what matters,
    the same when a task runs again."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*cols)


def process_store() -> dict:
    """What a worker process keeps between its tasks. Functions travel to
    executors by value, so that their own modules' globals, and caches wrapped
    around them, do not."""
    return sys.modules.setdefault("_biotally_process", types.ModuleType("_biotally_process")).__dict__


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A column used inside a higher-order function is evaluated again for each
    element when the optimizer inlines it; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a set of hashed keys: 4 MB at least, 64 MB at most.
SET_BITS, MOST_SET_BITS = 1 << 25, 1 << 29


def set_size(keys: int) -> int:
    """Bits of a set of so many keys: 16 a key and more, so that one key in 16
    that is not in it passes, up to ``MOST_SET_BITS``. Beyond 2 ** 25 keys the set
    fills up and spares less; what passes is always verified."""
    return min(MOST_SET_BITS, max(SET_BITS, 1 << (16 * keys).bit_length()))


def running(values: Column, merge) -> Column:
    """Running merges of an array of longs; element k merges the first k + 1.

    Arrays grow by copying, so one pass over n would copy n * n / 2: it goes over
    blocks of sqrt(n), then over the blocks' ends, then adds these to the blocks."""
    none = F.array().cast("array<bigint>")

    def within(xs: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            total = F.when(F.size(a) == 0, x).otherwise(merge(F.element_at(a, -1), x))
            return F.array_append(a, total)

        return F.aggregate(xs, none, step)

    def over(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        starts = F.sequence(F.lit(1), F.size(xs), width)
        return let(F.transform(starts, lambda a: within(F.slice(xs, a, width))), joined)

    def joined(blocks: Column) -> Column:
        ends = within(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(let(ends, lambda e: F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: merge(F.get(e, k - 1), x))))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, none).otherwise(over(xs)))


def key_set(keys: DataFrame, *cols: str, bits: int = SET_BITS) -> DataFrame:
    """(set_bucket, set_bits): a bitmap of the keys' hashes in at most
    bits / 32768 rows of 4 KB, small enough to broadcast by construction."""
    at = F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("set_bucket"), F.bitmap_bit_position(at).alias("at"))
    return rows.groupBy("set_bucket").agg(F.bitmap_construct_agg("at").alias("set_bits"))


def maybe_in(df: DataFrame, members: DataFrame, name: str, *cols: str, bits: int = SET_BITS) -> DataFrame:
    """``df`` with a column ``name``: false if the key is surely not in the set,
    which spares its row a shuffle. The fuller the set, the less it spares."""
    bucket, held = fresh(df, "bucket"), fresh(df, "held")
    at = F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1
    place = F.bitmap_bit_position(at)
    joined = df.withColumn(bucket, F.bitmap_bucket_number(at)).join(F.broadcast(members.toDF(bucket, held)), bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    bit = F.floor(byte / F.pow(F.lit(2.0), place % 8)) % 2
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(bucket, held)
