"""File routing: list files with their size (the binaryFile source reads no
content when only metadata is selected), keep allowed extensions up to the
size cap, and name the reader each file goes to."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta import params as P


def route_files(files: DataFrame, max_mb: int = P.MAX_UPLOAD_SIZE_MB) -> DataFrame:
    """``files`` (path, length) plus extension, allowed and the reader (null: rejected).  A file of
    exactly ``max_mb`` is allowed; a null length isn't."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    route = (F.when(ext == "ofx", "ofx").when(ext == "csv", "csv").when(ext == "pdf", "pdf")
             .when(ext.isin("png", "jpg", "jpeg"), "image"))
    fits = F.coalesce(F.col("length") <= max_mb * 1024 * 1024, F.lit(False))
    return (files.withColumn("extension", ext)
            .withColumn("allowed", ext.isin(P.ALLOWED_EXTENSIONS) & fits)
            .withColumn("reader", F.when(F.col("allowed"), route)))


def route_by_format(spark: SparkSession, path: str, max_mb: int = P.MAX_UPLOAD_SIZE_MB) -> DataFrame:
    """The files below ``path``, routed; only their names and sizes are read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length"))
    return route_files(files, max_mb)
