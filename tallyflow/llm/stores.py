"""Files that tasks write and read by byte range in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

GAP = 1 << 16  # bytes between two places that are still read at once
MOST = 4 << 20  # bytes of a read, unless one place is longer
SPREAD = 8 << 20  # places of one file that lie this far apart may go to different tasks


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI; a path without scheme is a local one."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    for hadoop in ("s3a://", "s3n://"):
        folder = folder.replace(hadoop, "s3://", 1) if folder.startswith(hadoop) else folder
    return pafs.FileSystem.from_uri(folder)


def joined(file: np.ndarray, offset: np.ndarray, length: np.ndarray, gap: int = GAP, most: int = MOST) -> Iterator[slice]:
    """Slices of places, sorted by file and offset, that one read covers."""
    start = 0
    for k in range(1, len(offset) + 1):
        if (
            k == len(offset)
            or file[k] != file[start]
            or offset[k] - (offset[k - 1] + length[k - 1]) > gap
            or offset[k] + length[k] - offset[start] > most
        ):
            yield slice(start, k)
            start = k


def read_ranges(places: DataFrame, folder: str, each: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``places`` (file, offset, length, ...) with the bytes found there as ``data``.

    Places are brought together by file and region and sorted, so that neighbours share a read; the number of
    tasks follows from the bytes to be read. ``each`` changes the bytes of a place as they are read."""
    st = T.StructType([*places.schema.fields, T.StructField("data", T.BinaryType())])
    schema = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        name, source = None, None
        for batch in batches:
            file = batch.column("file").to_numpy(zero_copy_only=False)
            offset, length = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            for at in joined(file, offset, length):
                if file[at.start] != name:
                    name = file[at.start]
                    source = fs.open_input_file(f"{root}/{name}")
                start = int(offset[at.start])
                stop = int((offset[at] + length[at]).max())
                read = source.read_at(stop - start, start)
                if len(read) != stop - start:
                    raise OSError(f"{name} ends before byte {stop}")
                data = [read[int(o) - start : int(o + n) - start] for o, n in zip(offset[at], length[at], strict=True)]
                if each is not None:
                    data = list(map(each, data))
                rows = batch.slice(at.start, at.stop - at.start)
                yield pa.RecordBatch.from_arrays(
                    [*(c.cast(f.type) for c, f in zip(rows.columns, schema, strict=False)), pa.array(data, pa.binary())], schema=schema
                )

    total = places.agg(F.sum("length")).first()[0] or 0
    near = places.repartition(max(1, -(-total // (SPREAD))), "file", F.expr(f"offset div {SPREAD}")).sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, st)
