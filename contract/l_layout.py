"""Partition counts: the content stays, only the number of partitions changes."""

from __future__ import annotations

from contract.a_sources import CONTENT_SQL, _coded_orders, _content
from contract.registry import query
from tallyweave.operators import layout


@query("l01_ingest_repack", CONTENT_SQL)
def l01(spark, sf):
    df = _coded_orders(spark, sf)
    return _content(layout.repacked_for_ingest(df, df.count()))


@query("l02_persist_repack", CONTENT_SQL)
def l02(spark, sf):
    df = _coded_orders(spark, sf)
    return _content(layout.repacked_for_persist(df, df.count()))


@query("l03_size_repack", CONTENT_SQL)
def l03(spark, sf):
    df = _coded_orders(spark, sf)
    return _content(layout.repacked_to_size(df, df.count(), df.rdd.getNumPartitions()))
