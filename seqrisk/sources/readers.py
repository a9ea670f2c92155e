"""Readers. Schemas are declared or checked by name, filters and columns reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqrisk.functions.scalars import parse_list_cell, safe_float
from seqrisk.schemas import (
    AUDIT_COLUMNS,
    EXAMPLES,
    FUSION_REQUIRED,
    HELD_OUT,
    PREDICTIONS,
    TABULAR_META,
    VERSION_REQUIRED,
    require_columns,
)

# Names a code list may give its code column, most specific last.
CODE_COLUMNS = ["code", "concept_code", "diagnosis_code", "condition_code", "medical_code"]


def read_examples(
    spark: SparkSession, root: str, task: str | None = None, version: str | None = None
) -> DataFrame:
    """Sequence tables under ``task=…/version=…`` folders; both columns come from the path.

    Files whose list columns are text (``['a', 'b']``) are parsed cell by cell; a cell of numbers that
    holds anything else is a NULL element.
    """
    df = spark.read.schema(EXAMPLES).parquet(root) if not _text_lists(spark, root) else _from_text(spark.read.parquet(root))
    if task is not None:
        df = df.where(F.col("task") == task)
    if version is not None:
        df = df.where(F.col("version") == version)
    return df


def _text_lists(spark: SparkSession, root: str) -> bool:
    kinds = dict(spark.read.parquet(root).dtypes)
    return any(kinds.get(f.name) == "string" for f in EXAMPLES.fields if isinstance(f.dataType, T.ArrayType))


def _from_text(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)

    def typed(field: T.StructField) -> Column:
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and kinds[field.name] == "string":
            c = F.transform(parse_list_cell(c), lambda e: e.try_cast(field.dataType.elementType))
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[typed(f) for f in EXAMPLES.fields])


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """JSON dictionary, code → id or (when every key is a number) id → code."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", "map<string,string>").alias("m"))
    checked = parsed.select(
        F.when(F.col("m").isNotNull(), F.col("m"))
        .otherwise(F.raise_error(F.lit(f"{path} must hold a JSON object")))
        .alias("m")
    )
    swapped = F.forall(F.map_keys("m"), lambda k: k.try_cast("int").isNotNull())
    entries = checked.select(swapped.alias("swapped"), F.explode("m").alias("key", "value"))
    code = F.when(F.col("swapped"), F.col("value")).otherwise(F.col("key"))
    token = F.when(F.col("swapped"), F.col("key")).otherwise(F.col("value"))
    return entries.select(code.alias("code"), token.cast("int").alias("token_id"))


def read_tabular_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.parquet(path)
    return df, [c for c in df.columns if c not in TABULAR_META]


def _read_table(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Parquet and CSV files, also mixed, aligned by column name.

    Each CSV path is read under its own header, as text: columns come in another order from other
    trainers. Typed casts follow.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    parquet = [p for p in listed if p.rstrip("/").endswith(".parquet")]
    parts = [spark.read.parquet(*parquet)] if parquet else []
    parts += [spark.read.csv(p, header=True, enforceSchema=False) for p in listed if p not in parquet]
    names = {c for part in parts for c in part.columns}
    if len(parts) > 1:  # the same column may be text in one file and typed in another
        mixed = {c for c in names if len({dict(p.dtypes)[c] for p in parts if c in p.columns}) > 1}
        parts = [p.withColumns({c: F.col(c).cast("string") for c in mixed if c in p.columns}) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _typed(df: DataFrame) -> DataFrame:
    """Declared types; a cell that is no number becomes NULL, also ``12.0`` reads as the integer 12."""
    kinds = {f.name: f.dataType for f in PREDICTIONS.fields}
    kinds["logit"] = T.DoubleType()

    def cast(name: str) -> Column:
        c = F.col(f"`{name}`")
        kind = kinds.get(name)
        if kind is None or isinstance(kind, T.StringType):
            return c.cast("string") if kind is not None else c
        if isinstance(kind, (T.IntegerType, T.LongType)):
            whole = safe_float(c)
            return F.coalesce(c.try_cast(kind), F.when(whole == F.floor(whole), whole.try_cast(kind)))
        return safe_float(c)

    return df.select(*[cast(c).alias(c) for c in df.columns])


def unread_cells(df: DataFrame, paths: Sequence[str] | str) -> DataFrame:
    """Per typed column how many cells held text that the types of ``df`` cannot hold."""
    raw = _read_table(df.sparkSession, paths)
    kinds = {f.name for f in PREDICTIONS.fields if not isinstance(f.dataType, T.StringType)}
    names = [c for c in raw.columns if c in kinds]
    typed = _typed(raw.select(*names, *[F.col(c).alias(f"_raw_{c}") for c in names]))
    return typed.agg(*[F.count_if(F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull()).alias(c) for c in names])


def read_predictions(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Predictions from CSV, gzipped CSV or parquet; held-out rows only when there is a split.

    A gzipped file is one task to read, so the rows are spread out again before further work.
    """
    df = _read_table(spark, paths)
    df = df.drop(*[c for c in df.columns if c.startswith("Unnamed:") or c == "_c0"])
    require_columns(df, FUSION_REQUIRED, "prediction table")
    if "split" in df.columns:
        df = df.where(F.col("split") == HELD_OUT)
    listed = [paths] if isinstance(paths, str) else list(paths)
    if any(p.endswith(".gz") for p in listed):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return _typed(df)


def read_predictions_multi(
    spark: SparkSession, paths: Sequence[str], family: str
) -> DataFrame:
    """Several prediction files with possibly different columns, aligned by name.

    ``family`` and ``source`` default to the given family, ``version`` of a tabular table to
    ``tabular_all_features``.
    """
    parts = [_read_table(spark, p) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    defaults = {"family": family, "source": family}
    if family == "tabular":
        defaults["version"] = "tabular_all_features"
    for name, value in defaults.items():
        present = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(present, F.lit(value)))
    return _typed(out)


def read_predictions_provenance(
    spark: SparkSession, paths: Sequence[str], calibration: str = "all"
) -> DataFrame:
    """Predictions with the file each row came from and its place in load order.

    ``load_order`` is (file position, row position); the last row of a repeated key wins in
    ``dedup``.
    """
    parts = []
    for i, path in enumerate(paths):
        part = _read_table(spark, path)
        parts.append(
            part.select(
                *part.columns,
                F.col("_metadata.file_path").alias("source_file"),
                F.struct(
                    F.lit(i).alias("file"),
                    F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"),
                ).alias("load_order"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    require_columns(out, VERSION_REQUIRED, "prediction files")
    if "split" in out.columns:
        out = out.where(F.col("split") == HELD_OUT)
    if calibration != "all":
        out = out.where(F.col("calibration") == calibration)
    return _typed(out)


def read_code_whitelist(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Code list with one of five column names; codes trimmed, blanks dropped."""
    df = spark.read.csv(path, header=True)
    found = [c for c in CODE_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"{path} must contain one of these columns: {CODE_COLUMNS}. Actual columns: {df.columns}")
    code = F.trim(F.col(found[0]))
    return df.select(code.alias("code"), F.lit(source).alias("selection_source")).where(F.col("code") != "")


def read_audit_history(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One audit table per task, stamped with its task and cut to the used columns."""
    out = None
    for task, path in paths.items():
        part = spark.read.csv(path, header=True).withColumn("task", F.lit(task))
        require_columns(part, AUDIT_COLUMNS, path)
        part = part.select(
            "task",
            F.col("row_id").cast("long"),
            F.col("subject_id").cast("long"),
            "split",
            F.col("label").cast("int"),
            *[F.col(c).cast("double") for c in AUDIT_COLUMNS[5:]],
        )
        out = part if out is None else out.unionByName(part)
    return out


def reuse_features(spark: SparkSession, path: str, tasks: Sequence[str]) -> DataFrame:
    """An existing feature table, limited to the wanted tasks at the scan."""
    return spark.read.parquet(path).where(F.col("task").isin(*tasks))
