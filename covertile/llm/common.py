"""What the training-data operators share: batches, scratch tables, hashing of text to held-out folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch; a task holds a few batches, whatever the texts' lengths.
BATCH_BYTES = 4 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, unless the session already does so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        unset = int(spark.conf.get(key)) > (1 << 30)
    except Exception:
        unset = True
    if unset:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; executors need a shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it again: lineage ends here, lost executors don't recompute it."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until none of the columns ``taken`` is called so."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key) but ``weight``, the number of rows that have the key; NULL where it has none.

    Keys with over a thousandth of all rows are at most 1,000; these are broadcast, so no task gets all rows of one. The
    others are joined by shuffle. ``table`` is read several times, so it should be a saved one.
    """
    total, top = table.agg(F.sum(weight), F.max(weight)).first()
    limit = max(1000, (total or 0) // 1000)
    if (top or 0) <= limit:
        return rows.join(table.drop(weight), key, "left")
    often = free([*rows.columns, *table.columns], "_often")
    hot = F.broadcast(table.filter(F.col(weight) > limit).drop(weight).withColumn(often, F.lit(True)))
    first = rows.join(hot, key, "left")
    rest = first.filter(F.col(often).isNull()).select(*rows.columns).join(table.filter(F.col(weight) <= limit).drop(weight), key, "left")
    return first.filter(F.col(often)).drop(often).unionByName(rest)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as NumPy views; nulls count as empty."""
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first : int(offsets[-1])], offsets - first


def trim() -> None:
    """Give free memory back: workers live on between stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes, one row at least."""
    rows = max(1, batch.num_rows if batch.nbytes <= limit else batch.num_rows * limit // batch.nbytes)
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3 over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def keep_texts(docs: DataFrame, good: Callable[[pa.Array], np.ndarray], done: Callable[[], None] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is ``good`` (a mask over slices of the column), with all columns as they are; no shuffle."""
    tuned(docs.sparkSession)
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array(good(part.column(at))))
        if done is not None:
            done()
        trim()

    return docs.mapInArrow(run, docs.schema)


def map_texts(docs: DataFrame, kernel: Callable[[pa.Array], list[pa.Array]], fields: str, keep_text: bool = False, piece: int = 1 << 22, done: Callable[[], None] | None = None) -> DataFrame:
    """``docs`` with the columns ``fields`` that ``kernel`` makes of slices of the column text; no shuffle.

    The other columns pass through; columns that ``fields`` names are replaced; text goes, unless ``keep_text``. ``done`` is
    called at the end of each task.
    """
    tuned(docs.sparkSession)
    made = [f.strip().split(" ")[0] for f in _split_fields(fields)]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {*(m.lower() for m in made), "text"}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(["text string"] if keep_text else []), fields])
    names = [*(f.name for f in kept), *(["text"] if keep_text else []), *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, piece):
                texts = part.column("text")
                cols = [part.column(f.name) for f in kept] + ([texts] if keep_text else [])
                yield pa.RecordBatch.from_arrays([*cols, *kernel(texts)], names=names)
        if done is not None:
            done()
            trim()

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), "text").mapInArrow(run, schema)


def _split_fields(fields: str) -> list[str]:
    out, depth = [""], 0
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out
