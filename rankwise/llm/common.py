"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwise.session import ensure_checkpoint_dir
from rankwise.sources.tables import table

#: ASCII white space as the contracts define it; also what ``bytes.split()`` splits on.
SPACE_CLASS = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also fold other alphabets)."""
    return F.translate(text, _UPPER, _UPPER.lower())


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage of iterative work at the cost of one columnar copy;
    any executor can read it again after another was lost.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Text that a Python worker takes in hand at once, in bytes (a single longer text is taken alone).
SLICE_BYTES = 1 << 21


def text_slices(batches, column: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece holds little text: Arrow batches are bounded by rows only."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], salt_from: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``rows`` with ``small`` (unique ``keys``, not null), whose hot keys are dealt over ``salts`` tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
