"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task's vectorised step works on at once; one longer text is taken alone.
CHUNK_BYTES = 1_000_000
#: Bytes of rows that reach a Python worker at once; one larger row comes alone.
BATCH_BYTES = 4_000_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the session's own (``spark.checkpoint.dir``); only a local session
    without any, such as a bare test session, gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that Python has freed back to the system, plans that no data frame refers to any more among it."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def raw_texts(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null is an empty text."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        column = column.fill_null("")
        return raw_texts(column)
    return memoryview(data or b""), at


def each_text(column: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes; null gives ``b""``."""
    data, at = raw_texts(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(data[a:b])


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch, as by rows alone 10,000 long texts would be one; a session's own bound stays."""
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(df.sparkSession)
    spark_schema = _parse_datatype_string(schema)
    names = spark_schema.names
    kinds = [f.type for f in to_arrow_schema(spark_schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[n].cast(k) if isinstance(out[n], pa.Array) else pa.array(out[n], type=k) for n, k in zip(names, kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def append_struct(df: DataFrame, rows: Callable[[pa.RecordBatch], list[dict]], inputs: list[str], schema: str, name: str) -> DataFrame:
    """``df`` and one struct column made by ``rows`` from a batch of ``inputs``; no shuffle.

    The column is the last one.  It is called ``name``, or, if ``df`` has a
    column of that name, ``name`` with underscores before it (``free_name``).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    bounded_batches(df.sparkSession)
    name = free_name(df, name)
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_type(kind)
    whole = StructType([*df.schema.fields, StructField(name, kind)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pa.array(rows(batch.select(inputs)), type=arrow)
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, whole)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def numbered(df: DataFrame, order: list[str], within: list[str], name: str = "number") -> DataFrame:
    """``df``, durable, with each row's place from 0 by ``order``, then ``within``; the driver sees one number for each partition."""
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order, *within))
    part, at = free_name(df, "_part"), free_name(df, "_at")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its upper bits are the partition
    rows = placed.select("*", F.spark_partition_id().alias(part), inside.alias(name))
    begins, total = [], 0
    for r in rows.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():
        begins.append((r[part], total))
        total += r.n
    starts = df.sparkSession.createDataFrame(begins, f"{part} int, {at} long")
    return rows.join(F.broadcast(starts), part).withColumn(name, F.col(name) + F.col(at)).select(*df.columns, name)


#: Keys with more than one in so many rows are hot: there are fewer of them than this.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has each key once and in ``n`` its number of rows.

    Hot keys number fewer than ``HOT_SHARE``, whatever the input, so they are sent to
    where their rows are; only rows of other keys are shuffled, and sorted, so that no other table passes the driver.  Both inputs
    should be durable, as they are read twice.
    """
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = counted.filter(F.col(n) * HOT_SHARE > total)
    cold = counted.filter(F.col(n) * HOT_SHARE <= total)
    near = rows.join(F.broadcast(hot), on)
    return near.unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold.hint("merge"), on))


#: Words of 64 bits that tell which rows may be suspects; their number bounds what is sent to tasks.
FILTER_WORDS = 1 << 20


def suspects(rows: DataFrame, hashed: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose 64-bit ``hashed`` may be among ``hashes`` (column ``h``), and those whose isn't.

    The hashes set one bit each of a filter of ``FILTER_WORDS`` words, which is sent to
    the rows.  Many hashes only fill it, so that more rows are in the first part.
    """
    word, bit = F.pmod(F.col("h"), F.lit(FILTER_WORDS)), F.shiftrightunsigned(F.col("h"), 50).cast("int")
    one = lambda b: F.expr(f"shiftleft(1L, {b} & 63)")
    own, word_name, bits, shift = (free_name(rows, c) for c in ("_h", "_word", "_bits", "_shift"))
    filled = durable(hashes.select(word.alias(word_name), bit.alias("_bit")).groupBy(word_name).agg(F.bit_or(one("_bit")).alias(bits)))
    marked = rows.withColumn(own, hashed).withColumn(shift, F.shiftrightunsigned(F.col(own), 50).cast("int"))
    marked = marked.join(F.broadcast(filled), F.pmod(F.col(own), F.lit(FILTER_WORDS)) == F.col(word_name), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(one(f"`{shift}`")) != 0, F.lit(False))
    return marked.filter(may).select(*rows.columns), marked.filter(~may).select(*rows.columns)


def keep_first(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``judged`` (id, key, stays; a row for each, ``key`` being the text's hash) lets go, and one of each set of rows with equal ids and texts.

    That one is the first by a hash of all its columns.  Rows without an id all stay.  Only rows that may go are shuffled.
    """
    own_id, own_key, verdict, place = (free_name(docs, c) for c in ("_id", "_key", "_stays", "_place"))
    found = judged.groupBy("id", "key").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).filter("n > 1 OR NOT stays")
    found = durable(found.select(F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("stays").alias(verdict)))
    row_id, row_key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    asked, sure = suspects(docs.filter(F.col(id_col).isNotNull()), F.xxhash64(row_id, row_key), found.select(F.xxhash64(own_id, own_key).alias("h")))
    order = Window.partitionBy(row_id, row_key).orderBy(F.xxhash64(*[F.col(c).cast("string") if k.startswith("map") else F.col(c) for c, k in docs.dtypes]))
    met = asked.join(found, (row_id == F.col(own_id)) & (row_key == F.col(own_key)), "left")
    alone = met.filter(F.col(verdict).isNull()).select(*docs.columns)
    one = met.filter(F.col(verdict)).withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*docs.columns)
    return sure.unionByName(alone).unionByName(one).unionByName(docs.filter(F.col(id_col).isNull()))
