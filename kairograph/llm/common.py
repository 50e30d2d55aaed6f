"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir. Where it names none, a temporary
    folder in local mode, as in tests; on a cluster, whose machines don't share one, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kairograph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of about BATCH_BYTES for this session, whatever their rows hold: whole texts are long, and a batch is held
    several times over. A smaller bound that the session has already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`task`, after which its Python worker, which Spark keeps for later tasks, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def materialize(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage and survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo `folds`."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, max_docs: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of the rows to learn from: of the documents labelled in `column` outside the held-out
    fold the `max_docs` that come first by a hash of doc_id, each once: the larger label and, of several texts, the smallest."""
    given = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held_out))
    usable = given.groupBy("doc_id").agg(F.max((F.col(column) > 0).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")  # max_docs bounds it
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: (distinct words, code of each word in order, offsets per text). Null is empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    lengths = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(lengths)), lengths)[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lengths)))]).astype(np.int64)
    return coded.dictionary, codes[keep], offsets


def row_slices(batch: pa.RecordBatch, column: str, budget: int = 2 << 20):
    """Slices of `batch` whose `column` holds about `budget` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held + n > budget and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000, budget: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of complete groups, of `least` rows or `budget` bytes where groups allow, from a stream that is sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least and sum(b.nbytes for b in held) < budget:
            continue
        table = pa.Table.from_batches(held)
        cut = table.num_rows
        same = np.ones(cut, bool)
        for k in keys:
            same &= pc.equal(table.column(k), table.column(k)[-1]).to_numpy()
        first = int(np.argmax(same))
        if first:
            yield table.slice(0, first)
            held = table.slice(first).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def valid_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat components as doubles, offsets, and which vectors have components and all of them finite numbers."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    return flat, offsets, (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
