"""Written intermediates below the shared checkpoint folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from adloom.session import work_dir


class Steps:
    """Tables of one job. Each is written once and read back, so no later step recomputes it and a lost
    executor costs only the tasks it ran; `drop` removes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.made = spark, work_dir(spark, label), 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        self.release()
        path = f"{self.base}/{self.made}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables written here."""
        for table in tables:
            for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner see that the shuffles of finished steps are unused, so that their files go."""
        gc.collect()
        self.spark._jvm.System.gc()
