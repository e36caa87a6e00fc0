"""Sinks: partitioned tables, CSV projections, JSON, Markdown of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_run(tables: dict[str, DataFrame], folder: str, by: str | None = None) -> None:
    """Parquet tables of a run; pages are partitioned by a key if one is named."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{folder}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; arrays are joined by ' | ', structs and maps are JSON."""
    flat = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            flat.append(F.array_join(f.name, " | ").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            flat.append(F.to_json(f.name).alias(f.name))
        else:
            flat.append(F.col(f.name))
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a report: the first rows of a small result."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])
