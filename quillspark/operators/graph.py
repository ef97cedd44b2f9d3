"""Concept graphs: edges of clean concepts, and merging of relations into a graph that is kept as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Why a concept is no node, in the order in which reasons are given.
REMOVED = ("invalid", "no_evidence", "repeat")
EDGE = "source string, target string, relationship string, weight long, relation string"


def cleaned(concepts: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """concepts with `removed`, the reason why a concept is no node (null for nodes).

    concepts: keys, name, related (array), n_chunks, n_formulas, definition, and a column for the order of concepts. Invalid are those for which
    `valid` is not true; without evidence those without related names, definition and formula in fewer than two chunks; of the rest, the first of each
    name, trimmed and in small letters, of a group stays. Ties of order go by name. Null names are invalid.
    """
    bare = (F.coalesce(F.size("related"), F.lit(0)) <= 0) & (F.coalesce("n_chunks", F.lit(0)) < 2) & (F.coalesce("n_formulas", F.lit(0)) == 0) & (F.coalesce("definition", F.lit("")) == "")
    first = F.when(~F.coalesce(valid, F.lit(False)) | F.col("name").isNull(), REMOVED[0]).when(bare, REMOVED[1])
    rows = concepts.withColumns({"_key": T.strip(F.lower("name")), "removed": first})
    place = F.row_number().over(Window.partitionBy(*keys, "_key", F.col("removed").isNull()).orderBy(order, "name"))
    return rows.withColumn("_place", place).withColumn("removed", F.when(F.col("removed").isNull() & (F.col("_place") > 1), REMOVED[2]).otherwise(F.col("removed"))).drop("_key", "_place")


def clean_up(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of cleaned concepts: keys, input_nodes, output_nodes, removed_nodes and the number for each reason."""
    return marked.groupBy(*keys).agg(F.count("*").alias("input_nodes"), F.count_if(F.col("removed").isNull()).alias("output_nodes"), F.count("removed").alias("removed_nodes"), *[F.count_if(F.col("removed") == r).alias(r) for r in REMOVED])


def concept_edges(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of the nodes among cleaned concepts: keys, source, target, relationship.

    A node is related to those of its related names that are nodes of its group; every prerequisite leads to it, node or not. One edge
    a mention, as often as a name is given. keys must not be null.
    """
    nodes = marked.where("removed is null")
    said = lambda column: nodes.select(*keys, "name", F.explode(column).alias("other")).where("other is not null")
    known = nodes.select(*keys, F.col("name").alias("other")).distinct()
    related = said("related").join(known, [*keys, "other"], "left_semi").select(*keys, F.col("name").alias("source"), F.col("other").alias("target"), F.lit("related").alias("relationship"))
    needs = said("prerequisites").select(*keys, F.col("other").alias("source"), F.col("name").alias("target"), F.lit("prerequisite").alias("relationship"))
    return related.unionByName(needs)


def read_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The edges in a folder: source, target, relationship, weight, relation; none if nothing was merged yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], EDGE)
    return spark.read.schema(EDGE).parquet(folder)


def _counted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "source", "target", "relationship").agg(F.sum("weight").alias("weight"))


def merge_graph(spark: SparkSession, folder: str, relations: dict[str, DataFrame]) -> DataFrame:
    """Puts relations, each edges of source and target with optional relationship and weight, in place of those of their names in a graph.

    Edges of other relations stay as they are and are not read. Equal edges become one, with their weights (1 where not given) added; edges with a null
    end are dropped. Returns a row for each relation given: relation, before, after (edges), added, dropped, changed (of another weight) and
    invalid (edges with a null end), computed before the folders are exchanged by one dynamic partition overwrite; a run that fails leaves the graph
    as it was. A relation without edges becomes empty. The same relations a second time change nothing.
    """
    if not relations:
        raise ValueError("no relations given")

    def one(name: str, df: DataFrame) -> DataFrame:
        relationship = F.col("relationship") if "relationship" in df.columns else F.lit(name)
        weight = F.coalesce(F.col("weight").cast("long"), F.lit(1)) if "weight" in df.columns else F.lit(1)
        return df.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), relationship.cast("string").alias("relationship"), weight.cast("long").alias("weight"), F.lit(name).alias("relation"))

    given = reduce(DataFrame.unionByName, [one(n, df) for n, df in relations.items()]).persist()
    new = _counted(given.where("source is not null and target is not null")).select("source", "target", "relationship", "weight", "relation")
    old = read_graph(spark, folder).where(F.col("relation").isin(*relations)).withColumnRenamed("weight", "held")
    on = reduce(lambda a, b: a & b, [new[c].eqNullSafe(old[c]) for c in ("relation", "source", "target", "relationship")])
    both = new.join(old, on, "full").select(F.coalesce(new["relation"], old["relation"]).alias("relation"), "weight", "held")
    n = lambda c, name: F.count_if(c).alias(name)
    w, h = F.col("weight"), F.col("held")
    counts = both.groupBy("relation").agg(n(h.isNotNull(), "before"), n(w.isNotNull(), "after"), n(h.isNull(), "added"), n(w.isNull(), "dropped"), n(w != h, "changed"))
    invalid = given.groupBy("relation").agg(F.count_if(F.col("source").isNull() | F.col("target").isNull()).alias("invalid"))
    names = spark.createDataFrame([(r,) for r in relations], "relation string")
    rows = names.join(counts, "relation", "left").join(invalid, "relation", "left").na.fill(0).collect()  # a row for each relation given
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("relation").parquet(folder)
    for r in rows:
        if r["after"] == 0 and r["before"] > 0:  # an overwrite leaves the folders of relations without rows
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/relation={r['relation']}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    given.unpersist()
    return spark.createDataFrame(rows, "relation string, before long, after long, added long, dropped long, changed long, invalid long")
