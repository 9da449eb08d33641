"""One document of each group of near duplicates, by fingerprints and by shingle sets.

Fingerprints of three-word shingles link copies and almost equal texts, but seldom a text that had every tenth
shingle changed.  Sets of five-word shingles find those: texts that share four fifths of them link, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import countjoin, simhash
from .common import col
from .components import connected_components


def _merged(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """``prints`` with the groups in ``component`` joined that a class of ``classes`` has members of."""
    keys = ["none", "id", "h"]
    key = [F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h"]
    prints = materialize(prints.select(*key, "component"), "print-groups")
    both = prints.join(classes.where(F.col("class").isNotNull()).select(*key, "class"), keys)
    both = materialize(both.select("component", "class").distinct(), "groups-and-classes")
    least = both.groupBy("class").agg(F.min("component").alias("least"))
    links = both.join(least, "class").where(F.col("component") != F.col("least")).select("component", "least").distinct()
    roots = connected_components(links).withColumnRenamed("node", "component")
    # A hot group's rows are many on one side and one row on the other: such a join can be split.
    return prints.join(roots, "component", "left").select(*keys, F.coalesce("root", "component").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, words: int = 5, percent: int = 80, **options) -> DataFrame:
    """One document of each group, with all its columns as they were.

    Groups are what links of both kinds reach: fingerprints (``options`` are those of ``simhash.near_duplicates``) and
    Jaccard similarity of at least ``percent`` hundredths of the sets of ``words``-word shingles.  The document of
    the least id stays, nulls last, then the least hash of the text; of rows repeated with the same id and text one
    stays.  Null, empty and blank texts are one group.  An empty table stays empty.  Texts are shuffled once, by their key.
    """
    keyed = docs.select(
        F.struct("*").alias("row"), col(id_col).alias("id"), col(text).alias("text"),
        F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("h"),
    )
    prints = simhash.near_duplicates(keyed, "id", "text", ("h",), **options)
    classes = countjoin.jaccard_classes(keyed.select("id", "text"), "id", "text", words=words, percent=percent, with_class=True)
    grouped = _merged(prints.select("id", "h", "component"), classes)
    first = F.struct("none", "id", "h")
    chosen = grouped.groupBy("group").agg(F.min(first).alias("first")).select("first.*")
    rows = keyed.select("row", F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "h")
    kept = rows.join(chosen, ["none", "id", "h"], "left_semi").dropDuplicates(["none", "id", "h"])
    return kept.select("row.*")
