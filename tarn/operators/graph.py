"""Lineage cuts for iterative operators, and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import urls as U
from tarn.operators.html_record import link_domains
from tarn.sources.shared import shared_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def link_edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between domains, all links of all pages."""
    rows = link_domains(pages).select(U.domain(F.col("url")).alias("source"), F.col("domain").alias("target"), "n")
    return rows.groupBy("source", "target").agg(F.sum("n").alias("n"))
