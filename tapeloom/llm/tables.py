"""Tables of the operators and intermediate results in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.runtime import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder that driver and executors share, and read again: cuts lineage, survives lost executors."""
    return stage(df, f"llm-{name}")


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
