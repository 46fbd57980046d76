"""CSV → typed Parquet as one job."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.casts import cast_by_name
from lodestack.sources.csv import CsvJob, CsvReadError, read_csv
from lodestack.sources.tables import write_parquet


def csv_to_parquet(spark: SparkSession, job: CsvJob) -> dict[str, Any]:
    """Reads, casts and writes; the rows are counted while they are written. Returns path, rows and column_types."""
    raw = read_csv(spark, job.input_path, job.sample_size, job.header, job.delimiter, job.folder, job.multi_line)
    typed = cast_by_name(raw, job.dtype_overrides, job.auto_cast_dates)
    seen = Observation("csv rows")
    try:
        write_parquet(typed.observe(seen, F.count(F.lit(1)).alias("rows")), job.target)
    except (PySparkException, Py4JJavaError) as error:
        raise CsvReadError(f"failed to convert CSV: {error}") from error
    types = {field.name: field.dataType.simpleString() for field in typed.schema.fields}
    return {"output_path": job.target, "rows": seen.get["rows"], "column_types": types}
