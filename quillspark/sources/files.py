"""Sources and sinks: files by path, registries, and tables of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Every file below a folder: path, checksum, text, error. A file that isn't UTF-8 has a null text and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    decoded = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.sha2("content", 256).alias("checksum"), decoded.alias("text")).withColumn("error", F.when(F.col("text").isNull(), "not UTF-8")).where(~F.col("path").rlike("(?i)/media_to_upload"))


def path_metadata(path: str | F.Column) -> F.Column:
    """struct(grade, subject, language, chapter) of a path like .../class 7/science/english/chapter.pdf."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    language = F.get(F.filter(parts, lambda x: T.language_code(x).isin("en", "hi", "kn", "ta", "te", "de", "fr", "es")), F.lit(0))
    return F.struct(T.grade_of(p).alias("grade"), T.subject_name(F.element_at(parts, -2)).alias("subject"), F.coalesce(T.language_code(language), F.lit("en")).alias("language"), T.chapter_title(name).alias("chapter"))


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose checksum the cache(path, checksum) doesn't have."""
    return files.join(cache.select("path", "checksum").distinct(), ["path", "checksum"], "left_anti")


def write_artifacts(df: DataFrame, path: str, key: str = "pack_id") -> None:
    df.write.mode("overwrite").partitionBy(key).json(path)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def url_parts(url: str | F.Column) -> F.Column:
    """struct(host, site, section, page, has_query) of a URL."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.struct(host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("site"), F.coalesce(F.get(segments, F.lit(0)), F.lit("")).alias("section"), T.slug(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit(""))).alias("page"), F.contains(u, F.lit("?")).alias("has_query"))
