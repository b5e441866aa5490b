"""Reference and related lists of work ids made into records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hydrate_references(refs: DataFrame, works: DataFrame) -> DataFrame:
    """refs(work_id, ref_id, ord) with the columns of works(ref_id, ...) in order: number from 1; unknown works are stubs."""
    w = Window.partitionBy("work_id").orderBy("ord", "ref_id")
    own = refs.withColumn("number", F.row_number().over(w).cast("long"))
    return own.join(works.withColumn("_known", F.lit(True)), "ref_id", "left").withColumn("stub", F.col("_known").isNull()).drop("_known")


def hydrate_related(related: DataFrame, works: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` of related(work_id, ref_id, ord), pos from 0, with the columns of works; unknown works go."""
    w = Window.partitionBy("work_id").orderBy("ord", "ref_id")
    own = related.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).where(F.col("pos") < limit)
    return own.join(works, "ref_id")
