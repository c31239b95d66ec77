"""Small helpers that the text operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.scratch import new_folder, remove

#: Bytes of a lower-cased word of the contracts: digits, a-z and all of non-ASCII.
#: Everything else becomes a space, A-Z become a-z, so bytes.split() gives the words.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there.

    Lost executors cost the reader nothing but a second read. The folder
    goes when the driver ends, or by forget().
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the folder of a table from written() that nothing will read any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file[: file.index("/rows/")])


#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves it to the default.
BATCH_BYTES = 4 * 1024 * 1024


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to Arrow batches of BATCH_BYTES unless it has a size of its own.

    The limit by rows alone lets ten thousand long texts into one batch.
    """
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    conf = df.sparkSession.conf
    if conf.get(name, default) == default:
        conf.set(name, str(BATCH_BYTES))
    return df


def share(df: DataFrame, value):
    """value, broadcast to the tasks of df."""
    return small_batches(df).sparkSession.sparkContext.broadcast(value)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as tell it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """True for rows of the fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == 0, F.lit(False))


#: Rows to drop up to which their keys are broadcast; a key is two numbers or a number and a short id.
BROADCAST_ROWS = 500_000


def _by_marks(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    its_id, its_hash = free_name(docs, "quarry_doc_id"), free_name(docs, "quarry_text_hash")
    keys = marked.toDF(its_id, its_hash)
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    same = docs["doc_id"].eqNullSafe(F.col(its_id)) & (F.xxhash64(docs["text"]) == F.col(its_hash))
    return docs.join(keys, same, how)


def drop_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and xxhash64 of text stand in marked (doc_id, text_hash, written()); same columns.

    Mostly few rows are marked: their keys are broadcast where a count shows that they fit, so that no text is shuffled.
    """
    return _by_marks(docs, marked, "left_anti")


def only_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows that drop_marked() takes away."""
    return _by_marks(docs, marked, "left_semi")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for nulls."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that Python objects of few rows exist at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(WORD_TABLE).split() if data else []
