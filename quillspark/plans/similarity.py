"""Registered queries over similar names and repeated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import similarity as S
from quillspark.plans.queries import query, table


@query()
def fuzzy_part_names(spark, sf_dir):
    """Names of parts that match those of parts whose key is divisible by 20: equal, contained, or of a matching ratio of 0.82. Python's difflib is not in SQL; tests hold it against all pairs."""
    names = table(spark, sf_dir, "part").select("p_partkey", T.normalize_name("p_name").alias("name"))
    return S.fuzzy_names(names.where(F.col("p_partkey") % 20 == 0), names)


@query()
def near_repeats(spark, sf_dir):
    """Documents that repeat an earlier text or one of the last 40 kept of their source and language. A fold over earlier decisions; tests hold it against a plain loop."""
    return S.near_repeats(table(spark, sf_dir, "documents"), ["source", "lang"]).select("doc_id", "status")
