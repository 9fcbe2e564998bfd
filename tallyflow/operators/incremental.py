"""State that a fix-point keeps between its rounds.

A round of a fix-point adds a little to what is known of some keys. ``KeptState`` holds what was added as a log of written tables and puts
together only what belongs to the keys of the present round: a round reads the log, never the data behind it, and computes on
the keys that it touches. Tables of the log are merged when a later one has grown to half their size, so that their number
grows with the logarithm of the rows and every row is rewritten as often at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.runtime import Scratch, union_all

MOST_TABLES = 8  # of a log, before tables of like size are merged
BUCKET_ROWS = 4_000_000  # a merged table is cut in buckets of about so many rows, of which a round reads those of its keys
MOST_BUCKETS = 1_024


class KeptState:
    """A log of rows per key; ``columns`` tells for each column its type and how rows of a key are put together (an associative aggregate)."""

    def __init__(self, scratch: Scratch, keys: Sequence[str], columns: Mapping[str, tuple[str, Column]], label: str = "state"):
        self.scratch, self.keys, self.label = scratch, list(keys), label
        self.types, self.merge = {c: t for c, (t, _) in columns.items()}, {c: m for c, (_, m) in columns.items()}
        self.tables: list[tuple[DataFrame, int]] = []

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def append(self, table: DataFrame, rows: int) -> None:
        """Take a written table into the log; columns that it lacks are null."""
        if not rows:
            return
        lacking = {c: F.lit(None).cast(t) for c, t in self.types.items() if c not in table.columns}
        self.tables.append((table.withColumns(lacking).select(*self.keys, *self.types), rows))
        if len(self.tables) <= MOST_TABLES:
            return
        sizes = [n for _, n in self.tables]
        first = next((k for k in range(len(sizes) - 1) if sizes[k] <= 2 * sum(sizes[k + 1 :])), len(sizes) - 2)
        merged = union_all([t for t, _ in self.tables[first:]]).groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.merge.items()))
        buckets = min(MOST_BUCKETS, sum(sizes[first:]) // BUCKET_ROWS)
        if buckets > 1:
            merged = merged.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket")
            written = self.scratch.save_by(merged, f"{self.label}-merged", "_bucket")
        else:
            written = self.scratch.save(merged, f"{self.label}-merged")
        self.tables[first:] = [(written, sum(sizes[first:]))]

    def _near(self, table: DataFrame, delta: DataFrame) -> DataFrame:
        """The table without the buckets that hold none of the keys of ``delta``."""
        if "_bucket" not in table.columns:
            return table
        n = table.agg(F.max("_bucket")).first()[0] + 1  # answered from the folder names
        wanted = [r["b"] for r in delta.select(self._bucket(n).alias("b")).distinct().collect()]  # numbers below MOST_BUCKETS
        return table.filter(F.col("_bucket").isin(wanted)).drop("_bucket")

    def beside(self, delta: DataFrame) -> DataFrame:
        """``delta`` (a written table, one row for each key) with the merged columns of its keys as ``old_<column>``, null where nothing was
        known. Only log rows of these keys are put together: Spark knows the size of ``delta`` and sends it to the log if it is small."""
        if not self.tables:
            return delta.withColumns({f"old_{c}": F.lit(None).cast(t) for c, t in self.types.items()})
        log = union_all([self._near(t, delta).join(delta.select(*self.keys), self.keys, "left_semi") for t, _ in self.tables])
        old = log.groupBy(*self.keys).agg(*(c.alias(f"old_{n}") for n, c in self.merge.items()))
        return delta.join(old, self.keys, "left")
