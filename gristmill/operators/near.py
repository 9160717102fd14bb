"""Near-duplicate SimHash values, exact within a distance, by blocks that must agree.

Tables of keys are merged, never broadcast: a value has (k + 1)**2 keys, but Spark takes an exploded
array for one row when it estimates a size, and would send a table of gigabytes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.simhash import distance, table_keys


def near_values(values: DataFrame, column: str = "simhash", k: int = 3) -> DataFrame:
    """(value_a, value_b, distance) of the distinct values within distance ``k``; value_a < value_b.

    Copies are one value, and null values are left out. Values meet in tables keyed by far more
    bits than a bucket could fill, so no bucket of the collection is compared as a whole.
    """
    v = values.select(F.col(column).alias("v")).where("v is not null").distinct()
    keyed = v.select("v", F.explode(table_keys(F.col("v"), k)).alias("t")).select("v", "t.*")
    pairs = keyed.hint("merge").join(keyed.withColumnRenamed("v", "w"), ["block", "bits", "part", "rest"]).where("v < w")
    apart = distance(F.col("v"), F.col("w"))
    return pairs.where(apart <= k).select(F.col("v").alias("value_a"), F.col("w").alias("value_b"), apart.alias("distance")).distinct()


def search(queries: DataFrame, index: DataFrame, column: str = "simhash", k: int = 3) -> DataFrame:
    """``queries`` (all columns) with value, distance and n_entries of every distinct value of the
    index within distance ``k``; a value's entries may be looked up by it.

    Copies in the index are one value with a count, so hot values cost one row per query. Null
    values neither ask nor answer.
    """
    q, v = queries.where(F.col(column).isNotNull()), index.where(F.col(column).isNotNull())
    counted = v.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_entries"))
    asked = q.select(F.col(column).alias("asked")).distinct()
    left = asked.select("asked", F.explode(table_keys(F.col("asked"), k)).alias("t")).select("asked", "t.*")
    right = counted.select("value", F.explode(table_keys(F.col("value"), k)).alias("t")).select("value", "t.*")
    apart = distance(F.col("asked"), F.col("value"))
    met = left.hint("merge").join(right, ["block", "bits", "part", "rest"]).where(apart <= k).select("asked", "value", apart.alias("distance")).distinct()
    found = met.join(counted, "value").withColumnRenamed("asked", column)
    return q.join(found, column)
