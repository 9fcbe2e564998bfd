"""Readers of cubes in the shapes statistical offices publish (S-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators.cube import role_of, with_roles
from tallyflow.operators.filters import filter_dims, filter_periods, resolve_column
from tallyflow.runtime import POSITION, Scratch, skew_join, small_table, sorted_numbers, union_all


# -- declared cubes ---------------------------------------------------------------------
def read_cube(spark: SparkSession, path: str, roles: Mapping[str, str], fmt: str = "csv") -> DataFrame:
    """Read a declared cube and bind it to its declaration (name -> role)."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return bind_schema(df, roles)[0]


def with_position(source: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Rows of a file source with ``position``, one long that follows the order of the files' names and of the rows in them.

    Parquet knows the number of a row in its file; for text formats the places of the file's splits and the order inside a task
    take its part. Files (or splits) are numbered by a sort across the cluster: 32 bits, beside 31 for the rows of one. The result is
    written, so that every reader of it sees the same positions; ``declared_first`` and the builders that use it take the first declaration by it."""
    part = F.col("_metadata.file_path")
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    if fmt != "parquet":
        part = F.concat(part, F.lit("\x00"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    scratch = Scratch(source.sparkSession, "position")
    rows = scratch.save(source.select("*", part.alias("_part"), row.alias("_row")), "rows")
    numbers, _ = sorted_numbers(rows, "_part", "_at", scratch)
    place = F.shiftleft(F.shiftright("_at", 33), 20).bitwiseOR(F.col("_at").bitwiseAND((1 << 33) - 1))
    placed = skew_join(rows, numbers, ["_part"]).withColumn(POSITION, F.shiftleft(place, 31).bitwiseOR(F.col("_row")))
    return placed.drop("_part", "_row", "_at")


def bind_schema(df: DataFrame, roles: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Match columns to declared concepts ignoring case.

    Declared case is used, undeclared columns are dropped, dimensions become text, measures
    numbers with NaN as NULL. Returns (cube, issues).
    """
    chosen, issues = [], []
    for name, role in roles.items():
        have = resolve_column(df, name)
        if have is None:
            issues.append(("error", "declared column absent", name, "not found in the data"))
            continue
        c = F.col(have)
        if role == "measure":
            n = c.cast("string").try_cast("double")
            c = F.when(~F.isnan(n), n)
        elif role in ("dimension", "time"):
            c = c.cast("string")
        chosen.append(c.alias(name))
    declared = {n.lower() for n in roles}
    issues += [
        ("warning", "column not declared", c, "dropped") for c in df.columns if c.lower() not in declared
    ]
    issues_df = small_table(df.sparkSession, issues, "level string, rule string, key string, message string")
    bound = df.select(*chosen)
    return with_roles(bound, {n: r for n, r in roles.items() if n in bound.columns}), issues_df


def split_by_name(df: DataFrame, column: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Named datasets held in one table."""
    return {n: df.filter(F.lower(column) == n.lower()).drop(column) for n in names}


def write_by_name(df: DataFrame, column: str, path: str) -> None:
    """All the datasets of one table in one write, a folder each."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


# -- wide periods -----------------------------------------------------------------------
# Status flags that may follow a figure.
STATUS_FLAGS = r"\s+[bcdefnprsuz]+\s*$"


def parse_wide(raw: DataFrame) -> DataFrame:
    """Wide table of text: a composite first column ``dim,dim\\time`` and one column per period.

    The composite key is split, ``:`` becomes NULL, status flags are removed.
    """
    head = raw.columns[0]
    dims = [d.strip() for d in head.split("\\")[0].split(",")]
    key = F.split(F.col(f"`{head}`"), ",")
    periods = [c for c in raw.columns if c != head]
    figure = lambda c: F.regexp_replace(F.trim(F.col(f"`{c}`")), STATUS_FLAGS, "")
    return raw.select(
        *[F.trim(F.get(key, F.lit(i))).alias(d) for i, d in enumerate(dims)],
        *[F.when(~figure(c).startswith(":"), figure(c)).try_cast("double").alias(c.strip()) for c in periods],
    )


def read_wide_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_wide(spark.read.option("sep", "\t").option("header", True).csv(path))


def unpivot_periods(
    df: DataFrame, ids: Sequence[str], period: str = "TIME_PERIOD", value: str = "value"
) -> DataFrame:
    cols = [c for c in df.columns if c not in ids]
    return df.unpivot(list(ids), cols, period, value)


# -- trade ------------------------------------------------------------------------------
def parse_trade(df: DataFrame, dims: Sequence[str], measures: Sequence[str], period: str = "PERIOD") -> DataFrame:
    """Keep the dimensions and measures; ``yyyy52`` periods become the year as text."""
    return df.select(
        *[
            (F.floor(F.col(d).cast("int") / 100)).cast("int").cast("string").alias(d)
            if d == period
            else F.col(d).cast("string").alias(d)
            for d in dims
        ],
        *[F.col(m).cast("string").try_cast("double").alias(m) for m in measures],
    )


def read_trade_csv(spark: SparkSession, path: str, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return parse_trade(spark.read.option("header", True).csv(path), dims, measures)


def trade_extracts(
    frames: Sequence[DataFrame], codes: Sequence[int], years: Sequence[int], freq: str = "A"
) -> DataFrame:
    """Append extracts, drop repeated rows, keep commodities and years, derive the date.

    Columns ``cmdCode`` and ``period`` (yyyy for annual, yyyymm for monthly data).
    """
    df = union_all(list(frames)).filter(F.col("cmdCode").isin(list(codes)))
    if freq == "A":
        df = df.filter(F.col("period").isin(list(years)))
        date = F.make_date(F.col("period").cast("int"), F.lit(1), F.lit(1))
    else:
        year = F.floor(F.col("period") / 100).cast("int")
        df = df.filter(year.isin(list(years)))
        date = F.make_date(year, (F.col("period") % 100).cast("int"), F.lit(1))
    return df.dropDuplicates().withColumn("date", date)


def load_trade_extracts(
    spark: SparkSession, paths: Sequence[str], schema: str, codes: Sequence[int], years: Sequence[int], freq: str = "A"
) -> DataFrame:
    return trade_extracts([spark.read.schema(schema).option("header", True).csv(list(paths))], codes, years, freq)


# -- code / label columns ---------------------------------------------------------------
def code_pairs(columns: Sequence[str]) -> dict[str, str]:
    """Label column -> code column for every ``X`` with a sibling ``X Code`` (or ``XCode``)."""
    pairs = {}
    for c in columns:
        if c.strip().lower().endswith("code"):
            name = c[: -len("Code")].strip()
            if name in columns:
                pairs[name] = c
    return pairs


def normalize_columns(df: DataFrame) -> DataFrame:
    """Keep ``X Code`` as ``X_id`` instead of ``X``; other columns stay; a lone ``Year`` gets a code."""
    if "Year" in df.columns and "Year Code" not in df.columns:
        df = df.withColumn("Year Code", F.col("Year"))
    pairs = code_pairs(df.columns)
    coded = [F.col(f"`{c}`").cast("string").alias(f"{n}_id") for n, c in pairs.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in pairs and c not in pairs.values()]
    return df.select(*coded, *rest)


def _cp1252_chars() -> tuple[str, str]:
    """Characters that cp1252 and latin-1 decode differently (bytes 0x80-0x9f)."""
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((chr(b), bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:
            continue
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def read_normalized(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """cp1252 is not among the charsets of the CSV reader: it is read as latin-1 and the few
    differing characters are put right."""
    windows = encoding.lower() in ("cp1252", "windows-1252")
    df = spark.read.option("header", True).option("encoding", "iso-8859-1" if windows else encoding).csv(path)
    if windows:
        old, new = _cp1252_chars()
        df = df.select(*[F.translate(F.col(f"`{c}`"), old, new).alias(c) for c in df.columns])
    return normalize_columns(df)


def extract_codes(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Distinct (concept, code, label) of label/code column pairs, in one pass."""
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("concept"),
                F.col(f"`{c}`").cast("string").alias("code"),
                F.col(f"`{n}`").cast("string").alias("label"),
            )
            for n, c in pairs.items()
        ]
    )
    return df.select(F.explode(items).alias("_i")).select("_i.*").distinct()


def split_code_label(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``(code) label`` columns as a lower-case code and ``<dim>_desc``; rows without code are dropped."""
    for d in dims:
        df = df.filter(F.col(d).isNotNull())
    return df.withColumns(
        {
            **{f"{d}_desc": F.trim(F.regexp_extract(d, r"^\(([^)]*)\)\s*(.*)$", 2)) for d in dims},
            **{d: F.lower(F.regexp_extract(d, r"^\(([^)]*)\)\s*(.*)$", 1)) for d in dims},
        }
    )


def stack_and_recode(
    df: DataFrame, ids: Sequence[str], codes: DataFrame | None = None, value: str = "value"
) -> DataFrame:
    """Date columns to rows with their year; descriptions to lower-case codes.

    ``codes(concept, code, description)``; a description without a code stays.
    """
    long = df.unpivot(list(ids), [c for c in df.columns if c not in ids], "_date", value).filter(
        F.col(value).isNotNull()
    )
    long = long.withColumn("year", F.year(F.col("_date").try_cast("date"))).drop("_date")
    if codes is not None:
        for d in ids:
            side = codes.filter(F.col("concept") == d).select(
                F.col("description").alias(d), F.lower("code").alias("_code")
            )
            long = long.join(side, d, "left").withColumn(d, F.coalesce("_code", d)).drop("_code")
    return long.select(*ids, "year", value)


def dims_lower(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.withColumns({d: F.lower(F.col(d).cast("string")) for d in dims})


def read_dims_lower(spark: SparkSession, path: str, dims: Sequence[str], lower: bool = True) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return dims_lower(df, dims) if lower else df


# -- other sources ----------------------------------------------------------------------
def read_jdbc_filtered(
    spark: SparkSession, url: str, table: str, where: Mapping[str, Sequence], options: Mapping[str, str] | None = None
) -> DataFrame:
    """Relational source; the IN predicates are pushed to the database by the planner."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()
    for c, values in where.items():
        if values:
            df = df.filter(F.col(c).isin(list(values)))
    return df


def read_local(
    spark: SparkSession, name: str, where: Mapping[str, Sequence], period: str = "year"
) -> DataFrame:
    """Filtered access to a registered cube, StartPeriod / EndPeriod included."""
    where = dict(where)
    start, end = where.pop("StartPeriod", None), where.pop("EndPeriod", None)
    df = spark.table(name)
    if start is not None:
        first = lambda v: v[0] if isinstance(v, (list, tuple)) else v
        df = filter_periods(df, first(start), first(end) if end is not None else None, period)
    return filter_dims(df, where)


def cache_cube(df: DataFrame, path: str) -> DataFrame:
    """Parquet copy of a prepared source, roles kept with the columns."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    roles = {f.name: role_of(f) for f in df.schema.fields if "role" in f.metadata}
    return with_roles(back, roles)


def read_features(spark: SparkSession, path: str, id_property: str = "id") -> DataFrame:
    """GeoJSON features, one row each: (code, properties map, geometry as JSON text)."""
    schema = (
        "features array<struct<id:string,properties:map<string,string>,"
        "geometry:struct<type:string,coordinates:string>>>"
    )
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(
        F.coalesce(F.col("f.id"), F.col("f.properties")[id_property]).alias("code"),
        F.col("f.properties").alias("properties"),
        F.to_json("f.geometry").alias("geometry"),
    )
