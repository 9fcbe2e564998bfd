"""Small helpers shared by the text operators: words, Arrow batches, tokenizer files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words of the contracts: runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: ``str.split`` also splits at these.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    """Runs without space, tab, \\n, \\v, \\f, \\r."""
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(LOWER)


_kept: dict[tuple, object] = {}


def kept_in_worker[T](key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` makes, kept for all tasks that the worker runs until something else is to be kept or it is let go: a worker
    outlives the operators that it runs, and holds the cache of one of them at most."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drops what the worker has kept for another operator."""
    _kept.clear()


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in parts of at most ``limit`` bytes of ``column`` (a longer value is a part of its own),
    so that what a task holds does not depend on how Spark has cut its batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def arrow_schema(ddl: str) -> tuple[T.StructType, pa.Schema]:
    st = T.StructType.fromDDL(ddl)
    return st, to_arrow_schema(st)


def map_rows(
    df: DataFrame,
    columns: list[str],
    make: Callable[[], Callable[..., Iterator[tuple]]],
    schema: str,
    text: str | None = "text",
) -> DataFrame:
    """Tuples made from each row of ``columns``; ``make`` runs once a task and returns
    ``row(*values) -> iterable of tuples`` (and may carry a ``rest()`` for what is left at the end).
    ``text`` names the column that bounds the size of a batch."""
    st, arrow = arrow_schema(schema)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for part in slices(batches, text) if text else batches:
            rows: list[tuple] = []
            for values in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                rows.extend(row(*values))
            if rows:
                yield packed(rows)
        rest = list(row.rest()) if hasattr(row, "rest") else []
        for at in range(0, len(rest), 10_000):
            yield packed(rest[at : at + 10_000])

    return df.select(*names).mapInArrow(run, st)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[str | None], bool]], text: str = "text") -> DataFrame:
    """Rows, with all their columns, of whose text ``make()(text)`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for part in slices(batches, text):
            yield part.filter(pa.array(map(keep, part.column(text).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
