"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.session import ensure_checkpoint_dir

#: Rows of an Arrow batch to and from the Python workers. Texts run to megabytes, so batches are kept short.
ARROW_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on (bounded Arrow batches)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    and a lost executor costs only what it had not yet written."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing reads it any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of
    ``df`` has it (Spark's names know no case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.struct(F.xxhash64(text_of(name)).alias("a"), F.xxhash64(F.lit(7), text_of(name)).alias("b"))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


#: Bits of a bitmap that is broadcast: 8 MB, whatever the data.
SLOTS = 1 << 26


def marked(rows: DataFrame, ids: DataFrame, col: str, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: true for each row whose 64-bit ``col`` is
    among those of ``ids``, and for few others; null counts as not among them. By a bitmap of SLOTS bits, so ``rows`` aren't shuffled."""
    s, bucket, bits = fresh(rows, "slot", "slot_bucket", "slot_bits")
    slot = F.pmod(col, F.lit(SLOTS)).cast("long")
    made = ids.select(slot.alias(s)).where(F.col(s).isNotNull()).groupBy(F.bitmap_bucket_number(s).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(s)).alias(bits))
    got = rows.withColumn(s, slot).withColumn(bucket, F.bitmap_bucket_number(s)).join(F.broadcast(made), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, cast(bitmap_bit_position(`{s}`) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.pmod(F.bitmap_bit_position(s), F.lit(8))).cast("int")
    return got.withColumn(out, F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))).select(*rows.columns, out)
