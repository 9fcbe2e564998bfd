"""Writers (K-01, K-02, K-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.runtime import small_table

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def to_csv(df: DataFrame, path: str) -> None:
    """Header, ``yyyy-MM-dd HH:mm:ss`` timestamps, NULL as an empty field."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option(
        "timestampFormat", TIMESTAMP_FORMAT
    ).option("dateFormat", TIMESTAMP_FORMAT).csv(path)


def json_record(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"timestampFormat": TIMESTAMP_FORMAT, "ignoreNullFields": "false"})


def json_split_row(df: DataFrame) -> Column:
    """Row of a split document: the values in column order, without names."""
    return F.to_json(
        F.array(*[F.col(c).cast("string") for c in df.columns]), {"ignoreNullFields": "false"}
    )


def to_json(df: DataFrame, path: str, orient: str = "records") -> None:
    """``records``: one object per line. ``split``: one array per line, the column names in a
    ``columns`` folder beside, so that no task has to hold the whole document."""
    if orient == "records":
        df.select(json_record(df).alias("value")).write.mode("overwrite").text(path)
        return
    df.select(json_split_row(df).alias("value")).write.mode("overwrite").text(f"{path}/data")
    names = small_table(df.sparkSession, [(i, c) for i, c in enumerate(df.columns)], "position int, name string")
    names.write.mode("overwrite").json(f"{path}/columns")


def write_table(df: DataFrame, url: str, table: str, replace: bool = True, options: dict | None = None) -> None:
    """Relational sink: replace the table, or append to it."""
    df.write.format("jdbc").options(url=url, dbtable=table, **(options or {})).mode(
        "overwrite" if replace else "append"
    ).save()
