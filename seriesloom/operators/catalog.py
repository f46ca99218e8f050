"""Lookups in a store's catalogue tables: files that a time range needs, streams by an inverted index."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import canonical_id
from .orphans import json_elements


def required_files(files: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of files(id, filename, start_ts, end_ts) that overlap start to end, both included; a null end_ts is still
    open. Rows with a null start_ts never do. In order of start_ts only where the caller sorts."""
    return files.where((F.col("end_ts").isNull() | (F.col("end_ts") >= start)) & (F.col("start_ts") <= end))


def streams_by_postings(postings: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(stream_id) of the streams that stand in the posting lists of all wanted (name, value) pairs.

    postings(name, value, ids as JSON text): a pair's list may be spread over several rows. Ids are canonical; null,
    empty and broken lists hold none. No wanted pairs, no streams. One aggregation by id, whatever the lists' sizes."""
    if not wanted:
        return postings.select(F.lit("").alias("stream_id")).where(F.lit(False))
    pairs = [(F.col("name") == k) & (F.col("value") == v) for k, v in wanted.items()]
    hits = postings.where(reduce(or_, pairs)).select("name", F.explode(json_elements(F.col("ids"))).alias("e"))
    ids = hits.where(F.col("e").isNotNull()).groupBy(canonical_id(F.col("e")).alias("stream_id"))
    per = ids.agg(*(F.max((F.col("name") == k).cast("int")).alias(f"p{i}") for i, k in enumerate(wanted)))
    return per.where(reduce(lambda a, b: a & b, (F.col(f"p{i}") == 1 for i in range(len(wanted))))).select("stream_id")
