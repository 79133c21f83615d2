"""Address to place lookup as a bucketed range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.joins import measured
from auditloom.functions.once import keep_where

# Addresses that have no place.
LOCAL_ADDRESSES = ("127.0.0.1", "localhost", "::1", "0.0.0.0")


def ip_number(ip: Column) -> Column:
    """IPv4 text to its number; null for anything else."""
    parts = F.split(F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ip), r"\.")
    return F.aggregate(F.transform(parts, lambda p: p.cast("long")), F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)


def locate(df: DataFrame, geo_ranges: DataFrame, ip: str = "client_ip") -> DataFrame:
    """Add ``lat`` and ``lon`` (null if unknown).

    Only distinct addresses meet the ranges. Both sides carry the /16 block of the address, so the
    range condition is checked inside an equi-join instead of a nested loop over all ranges.
    """
    distinct = df.where(~F.col(ip).isin(*LOCAL_ADDRESSES)).select(F.col(ip).alias("_ip")).distinct()
    addresses = keep_where(distinct, {"_n": ip_number(F.col("_ip"))}, lambda r: r["_n"].isNotNull()).withColumn(
        "_block", F.shiftright("_n", 16))
    ranges = geo_ranges.withColumn("_block", F.explode(F.sequence(F.shiftright("start_num", 16),
                                                                  F.shiftright("end_num", 16))))
    hit = addresses.join(ranges, (addresses["_block"] == ranges["_block"])
                         & F.col("_n").between(F.col("start_num"), F.col("end_num")))
    place = hit.groupBy("_ip").agg(F.min_by(F.struct("lat", "lon"), F.struct("start_num", "end_num")).alias("_p"))
    place = measured(place)
    return (df.join(place, df[ip] == place["_ip"], "left")
            .select(*[df[c] for c in df.columns], F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon")))
