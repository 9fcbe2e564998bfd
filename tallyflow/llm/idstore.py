"""Token ids in binary shards with a minimal perfect hash index.

Format (a folder):

* ``shards/shard-<n>-<attempt>.bin``: raw little-endian ids, nothing between documents; documents
  ascend by key within a shard and from shard to shard. Two bytes an id while the vocabulary allows it.
* ``manifest``: Parquet, one row per document (key, occurrence, shard, file, first id, number of ids).
* ``index``: Parquet, one row per bucket of keys: the seeds of a minimal perfect hash and, in the
  order of its slots, key fingerprint, file number, first id and number of ids.

A key is looked up in constant time: its hash gives the bucket, a seed of the bucket and a
slot; the stored fingerprint tells whether the key is there at all.

Only the files named in the manifest count: Spark commits the manifest rows of the attempt that succeeded,
so a lost executor leaves at most files that nothing names. Rows with the same key are told apart by
their occurrence (0, 1, ...); a null key is a key of its own and comes first. A null or empty
text holds its end id only. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyflow.llm.encoding import library_encoder
from tallyflow.llm.packing import END_ID, with_end
from tallyflow.llm.stores import read_ranges, store
from tallyflow.llm.texts import arrow_schema, slices

WIDTH = 2  # bytes an id
TEXT_A_SHARD = 16 << 20  # bytes of text of a shard, about; ids take some three quarters of it
KEYS_PER_BUCKET = 10_000
KEYS_PER_SEED = 3  # mean number of keys that share a seed
NULL_KEY = -(1 << 63)


def write_shards(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the shards and the manifest; return the manifest as read back."""
    st, schema = arrow_schema("key long, occurrence long, shard int, file string, first long, n_ids long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = library_encoder(path), TaskContext.get()
        shard, dtype = context.partitionId(), np.dtype(f"<u{WIDTH}")
        fs, root = store(folder)
        file = f"shard-{shard:07d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
        first, last, seen, out = 0, object(), 0, None
        try:
            for part in slices(batches, text_col):
                if out is None:
                    fs.create_dir(f"{root}/shards", recursive=True)
                    out = fs.open_output_stream(f"{root}/shards/{file}")
                ids, offsets = with_end(*encoder.encode(part.column(text_col)), end_id)
                if len(ids) and int(ids.max()) >> (8 * WIDTH):
                    raise ValueError("ids do not fit the file format")
                out.write(ids.astype(dtype).tobytes())
                keys, occurrences = part.column(id_col).to_pylist(), []
                for key in keys:
                    seen = seen + 1 if key == last else 0
                    last = key
                    occurrences.append(seen)
                n = len(keys)
                columns = [keys, occurrences, [shard] * n, [file] * n, offsets[:-1] + first, np.diff(offsets)]
                first += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // TEXT_A_SHARD)), id_col).sortWithinPartitions(id_col)
    ordered.mapInArrow(run, st).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(st).parquet(f"{folder}/manifest")


def key_hashes(keys: np.ndarray, occurrences: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit hash of each (key, occurrence) under a seed (or a seed each): rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) ^ np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = h + occurrences.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
        return h ^ (h >> np.uint64(33))


def build_hash(keys: np.ndarray, occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each group of keys, slot of each key): a minimal perfect hash of distinct keys.

    Keys fall into small groups; from the largest group on, the first seed is taken that sends all keys of
    the group to free slots. A group of one key names its slot directly, as a negative seed."""
    n = len(keys)
    groups = max(1, -(-n // KEYS_PER_SEED))
    group = (key_hashes(keys, occurrences, 1) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(bounds)
    seeds, slots, free = np.zeros(groups, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        if sizes[g] < 2:
            break
        members = order[bounds[g] : bounds[g + 1]]
        k, o = keys[members][:, None], occurrences[members][:, None]
        tries, first = 16, 2
        while True:
            at = (key_hashes(k, o, np.arange(first, first + tries)[None, :]) % np.uint64(n)).astype(np.int64)
            fits = free[at].all(axis=0) & (np.diff(np.sort(at, axis=0), axis=0) > 0).all(axis=0)
            if fits.any():
                hit = int(fits.argmax())
                seeds[g], slots[members], free[at[:, hit]] = first + hit, at[:, hit], False
                break
            first, tries = first + tries, min(4 * tries, 4096)
    single, left = np.flatnonzero(sizes == 1), np.flatnonzero(free)
    seeds[single] = -1 - left
    slots[order[bounds[single]]] = left
    return seeds, slots


def look_up(keys: np.ndarray, occurrences: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key in a bucket of ``n`` keys."""
    seed = seeds[(key_hashes(keys, occurrences, 1) % np.uint64(len(seeds))).astype(np.int64)]
    hashed = (key_hashes(keys, occurrences, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -1 - seed, hashed)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").fill_null(NULL_KEY).to_numpy()
    return keys, table.column("occurrence").to_numpy()


def bucket_of(buckets: int):
    """Bucket of a key; the columns are ``key`` and ``occurrence``."""
    return F.pmod(F.xxhash64(F.coalesce("key", F.lit(NULL_KEY)), "occurrence"), F.lit(buckets)).cast("int")


def build_index(manifest: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """Write the index, one row for each bucket of about ``KEYS_PER_BUCKET`` keys; (index, number of buckets)."""
    spark = manifest.sparkSession
    buckets = max(1, -(-manifest.count() // KEYS_PER_BUCKET))
    st, schema = arrow_schema(
        "bucket int, n_keys long, seeds array<long>, fingerprints array<long>, files array<string>,"
        " file_of array<int>, first array<long>, n_ids array<long>"
    )

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys, occurrences = _arrays(table)
        seeds, slots = build_hash(keys, occurrences)
        by_slot = np.argsort(slots)
        files = table.column("file").combine_chunks().dictionary_encode()
        row = {
            "bucket": key[0].as_py(),
            "n_keys": len(keys),
            "seeds": seeds,
            "fingerprints": key_hashes(keys, occurrences, 0)[by_slot].view(np.int64),
            "files": files.dictionary.to_pylist(),
            "file_of": files.indices.to_numpy()[by_slot],
            "first": table.column("first").to_numpy()[by_slot],
            "n_ids": table.column("n_ids").to_numpy()[by_slot],
        }
        return pa.Table.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

    keyed = manifest.withColumn("bucket", bucket_of(buckets))
    keyed.groupBy("bucket").applyInArrow(build, st).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(st).parquet(f"{folder}/index"), buckets


LISTS = ("seeds", "fingerprints", "files", "file_of", "first", "n_ids")


def locate(wanted: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Places of the wanted (key, occurrence) rows: each meets the one index row of its bucket. A key that is
    not in the index gives no row."""
    st, schema = arrow_schema("key long, occurrence long, file string, first long, n_ids long")

    def places(key: tuple, keys: pa.Table, entries: pa.Table) -> pa.Table:
        if not keys.num_rows or not entries.num_rows:
            return schema.empty_table()
        entry = {name: entries.column(name)[0].values.to_numpy(zero_copy_only=False) for name in LISTS}
        raw, occurrences = _arrays(keys)
        slots = look_up(raw, occurrences, entry["seeds"], entries.column("n_keys")[0].as_py())
        there = entry["fingerprints"][slots].view(np.uint64) == key_hashes(raw, occurrences, 0)
        slots = slots[there]
        columns = [
            keys.column("key").filter(pa.array(there)).combine_chunks(), occurrences[there],
            entry["files"][entry["file_of"][slots]], entry["first"][slots], entry["n_ids"][slots],
        ]
        return pa.Table.from_arrays([pa.array(c, x.type) for c, x in zip(columns, schema, strict=True)], schema=schema)

    left = wanted.select("key", "occurrence").withColumn("bucket", bucket_of(buckets))
    return left.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(places, st)


def widened(data: bytes) -> bytes:
    """Ids of a file as unsigned 32-bit integers."""
    return np.frombuffer(data, f"<u{WIDTH}").astype("<u4").tobytes()


def fetch(places: DataFrame, folder: str) -> DataFrame:
    """The rows of ``places`` with their ids (binary, little-endian unsigned 32-bit)."""
    ranges = places.withColumns({"offset": F.col("first") * WIDTH, "length": F.col("n_ids") * WIDTH})
    return read_ranges(ranges, f"{folder}/shards", widened).withColumnRenamed("data", "ids").drop("offset", "length")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """(file, ids in all shards before it): a running sum over one row per shard."""
    totals = manifest.groupBy("shard", "file").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("before"))
