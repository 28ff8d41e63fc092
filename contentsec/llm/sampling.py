"""Bounded samples of labelled rows, which is all that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentsec.llm.common import materialize


def remainder(id_col: str, of: int):
    """crc32 of the id as text (a null id as empty text), modulo `of`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def bounded(rows: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label): at most `most` different ids of each label that isn't null, those with the least hash of the id.

    An id counts once for a label however many rows it has, so a common id neither fills its label's sample nor starves
    it. A label's ids are counted first; only hashes so small that about 2 * most ids have them reach the window, so its
    input doesn't grow with the table."""
    ids = materialize(rows.select(F.col(id_col), F.col(label)).filter(F.col(label).isNotNull()).distinct(), "label-ids")
    sizes = materialize(ids.groupBy(F.col(label).alias("_of")).agg(F.count("*").alias("_size")), "label-sizes")
    h = F.md5(F.col(id_col).cast("string"))
    share = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / 16**12
    few = ids.join(sizes, F.col(label) == F.col("_of")).filter(share * F.col("_size") < 2 * most).drop("_of", "_size")
    order = Window.partitionBy(label).orderBy(h, id_col)
    return few.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= most).drop("_place")
