"""A cache of what providers answered: keyed tables of payloads, with counts of hits and misses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "\u001f"
SCHEMA = "cache_key string, namespace string, payload string, updated_at double"


def cache_key(namespace: Column, *components: Column) -> Column:
    return F.concat_ws(SEPARATOR, namespace, *components)


def loaded(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (with cache_key and namespace) with payload and whether it was a hit."""
    found = cache.select("cache_key", "payload", F.lit(True).alias("hit"))
    return requests.join(found, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def stored(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """cache with the answers in place of older ones; of several with one key the latest counts."""
    w = Window.partitionBy("cache_key").orderBy(F.desc("updated_at"), F.desc("payload"))
    new = answers.select("cache_key", "namespace", "payload", "updated_at").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").select(new.columns).unionByName(new)


def hit_rates(requests: DataFrame) -> DataFrame:
    """namespace, hits, misses, hit_rate (0 without requests)."""
    out = requests.groupBy("namespace").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 6))


def through(cache: DataFrame, requests: DataFrame, provide: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new rows of the cache): the provider is asked once for each distinct request that the cache has no answer to.

    provide takes the distinct missing requests and returns them with payload; requests have cache_key and namespace.
    """
    got = loaded(cache, requests)
    missing = got.where("NOT hit").drop("payload", "hit").dropDuplicates(["cache_key"])
    new = provide(missing).withColumn("updated_at", F.unix_timestamp().cast("double"))
    answers = got.join(new.select("cache_key", F.col("payload").alias("_new")), "cache_key", "left").withColumn("payload", F.coalesce("payload", "_new")).drop("_new")
    return answers, new.select("cache_key", "namespace", "payload", "updated_at")
