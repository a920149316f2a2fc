"""Reading coded rows and storing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stanzagraph.operators.checks import check_counts
from stanzagraph.operators.model import Model
from stanzagraph.spec import AccumulateSpec

FORMATS = ("parquet", "orc", "json", "csv")


def read_rows(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Rows from files; text formats should be given a schema."""
    if kind not in FORMATS:
        raise ValueError(f"kind: one of {FORMATS}")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def rows_from(spark: SparkSession, rows: list[dict], order: str = "seq") -> DataFrame:
    """Rows at hand, in their order: ``order`` numbers them from 1."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([(*[r.get(n) for n in names], i) for i, r in enumerate(rows, 1)], [*names, order])


def save_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def load_counts(spark: SparkSession, path: str, spec: AccumulateSpec) -> DataFrame:
    """Stored counts, checked against the specification."""
    counts = spark.read.parquet(path)
    check_counts(counts, spec)
    return counts


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path, wholetext=True).first()[0])
