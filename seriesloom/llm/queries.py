"""Queries of the text operators, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut
from ..sources.store import readings
from .language import corrections, labelled, language_segments, languages_found, train
from .leaks import leaks
from .mix import mix, reached, token_counts
from .percentiles import percentiles, relabelled, state


PERMILLE = [10, 50, 250, 500, 750, 950, 990]
DAY_MS = 86_400_000


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def days(rows: DataFrame) -> DataFrame:
    """Readings by stream and UTC day, with the metric on the row, if any, as their label."""
    return rows.select(F.col("stream_id").alias("grp"), F.col("name").alias("label"), F.floor(F.col("ts") / F.lit(DAY_MS)).cast("int").alias("period"), "value", F.lit(1).alias("n"))


def named(states: DataFrame, kind: str) -> DataFrame:
    return states.withColumn("grp", F.concat(F.lit(f"{kind}:"), "grp"))


def shown(df: DataFrame) -> DataFrame:
    return df.select(F.split_part("grp", F.lit(":"), F.lit(1)).alias("kind"), F.substring_index("grp", ":", -1).alias("key"), "n", "permille", "value")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of each stream and, from the same states, each metric."""
    states = cut(state(days(readings(spark, d))), "state")
    return shown(percentiles(named(states, "stream").unionByName(named(relabelled(states), "metric")), PERMILLE, written=True))


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same per metric from two states that were built apart: days with even and with odd numbers."""
    rows = days(readings(spark, d))
    even = F.pmod("period", F.lit(2)) == 0
    states = cut(state(rows.where(even)).unionByName(state(rows.where(~even))), "state")
    return shown(percentiles(named(relabelled(states), "metric"), PERMILLE, written=True))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents with their tokens and repeats."""
    return mix(token_counts(read(spark, d, "documents")), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    targets = read(spark, d, "mix_targets")
    return reached(mix(token_counts(read(spark, d, "documents")), targets), targets)


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the draw, per source: no document over its limit, none of another source or without text, the
    reached share within a hundredth of the target."""
    targets, documents = read(spark, d, "mix_targets"), read(spark, d, "documents").select("doc_id", F.col("source").alias("own"), "text")
    drawn = mix(token_counts(read(spark, d, "documents")), targets)
    joined = drawn.join(documents, "doc_id", "left").join(targets.select("source", "max_repeats"), "source")
    wrong = joined.groupBy("source").agg(F.count(F.when(F.col("repeats") > F.col("max_repeats"), 1)).alias("over_limit"), F.count(F.when(~F.coalesce((F.col("own") == F.col("source")) & (F.col("text") != ""), F.lit(False)), 1)).alias("foreign_documents"))
    close = reached(drawn, targets).select("source", (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.01).alias("share_reached"))
    return close.join(wrong, "source", "left")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return labelled(read(spark, d, "documents"), read(spark, d, "lang_names"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    rows = docs(spark, d)
    return language_segments(rows, train(rows)).drop("enough")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document of enough letters: share and confidence per language."""
    rows = docs(spark, d)
    return languages_found(language_segments(rows, train(rows)))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d)
    return corrections(language_segments(rows, train(rows))).select("doc_id", "lang_found")


def p9_covered(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the segments: every document with a text has some, they follow one another without a gap, make
    up the whole text, and have a confidence if and only if they have a language."""
    by = Window.partitionBy("doc_id").orderBy("segment")
    segments = p9_segments(spark, d).withColumn("expected", F.coalesce(F.lag("last_line").over(by) + 1, F.lit(0)))
    broken = (F.col("first_line") != F.col("expected")) | (F.col("last_line") < F.col("first_line")) | (F.col("lang_found").isNull() != F.col("confidence").isNull()) | ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    per = segments.groupBy("doc_id").agg(F.count(F.when(broken, 1)).alias("broken"), F.sum("share").alias("share"))
    return per.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"), F.count(F.when(F.abs(F.col("share") - 1) > 1e-6, 1)).alias("not_whole"))


def queries() -> dict:
    return {f.__name__: f for f in (p4_percentiles, p4_merged, p7_found, p8_mix, p8_shares, p8_limits, p9_found, p9_segments, p9_languages, p9_covered)}


def oracle_sql() -> dict[str, str]:
    rows = "r AS (SELECT * FROM samples WHERE stream_id IS NOT NULL AND ts >= 1514764800000 AND ts < 1798761600000 AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))"
    names = "n AS (SELECT stream_id, min(name) AS metric FROM samples WHERE stream_id IS NOT NULL AND value IS NOT NULL AND ts >= 1514764800000 AND ts < 1798761600000 GROUP BY ALL)"
    pct = f"g AS (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY value) AS i, count(*) OVER (PARTITION BY grp) AS n FROM x), p AS (SELECT unnest({PERMILLE}) AS permille) SELECT split_part(grp, ':', 1) AS kind, split_part(grp, ':', 2) AS key, n, permille, value FROM g JOIN p ON i = greatest(1, (n * permille + 999) // 1000)"
    by_metric = "SELECT 'metric:' || metric AS grp, value FROM r JOIN n USING (stream_id) WHERE metric IS NOT NULL"
    words = lambda t, i: f"SELECT {i}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {t} WHERE text IS NOT NULL AND {i} IS NOT NULL"
    grams = lambda t, i: f"SELECT {i}, unnest(list_transform(range(1, len(w) - 13), lambda k: array_to_string(w[k:k + 14], ' '))) AS g FROM ({words(t, i)}) WHERE len(w) >= 15"
    return {
        "p4_percentiles": f"WITH {rows}, {names}, x AS (SELECT 'stream:' || stream_id AS grp, value FROM r UNION ALL {by_metric}), {pct}",
        "p4_merged": f"WITH {rows}, {names}, x AS ({by_metric}), {pct}",
        "p8_limits": "SELECT source, 0 AS over_limit, 0 AS foreign_documents, true AS share_reached FROM mix_targets",
        "p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({grams('documents', 'doc_id')}) d JOIN (SELECT DISTINCT * FROM ({grams('eval_items', 'item_id')})) e USING (g)",
        "p9_covered": "SELECT count(*) AS documents, 0 AS broken, 0 AS not_whole FROM documents WHERE text IS NOT NULL",
    }
