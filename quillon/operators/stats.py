"""Counts of a catalogue, lists by attribute, and the trigram table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.sources.catalog import with_derived


def counts(catalog: DataFrame) -> DataFrame:
    flags = [F.count_if(paths.has_flag(F.col("flags"), f)).alias(f) for f in paths.FLAGS]
    return catalog.agg(F.count("*").alias("entries"), F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), *flags)


def attribute_lists(catalog: DataFrame) -> DataFrame:
    """(attribute, id): dir, file and the four flags, one row per entry and attribute."""
    named = [F.when(F.col("is_dir"), "dir").otherwise("file")]
    named += [F.when(paths.has_flag(F.col("flags"), f), f) for f in paths.FLAGS]
    return catalog.select(F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("attribute"), "id")


def trigram_rows(catalog: DataFrame) -> DataFrame:
    """(trigram, id): the distinct trigrams of each name."""
    return with_derived(catalog).select(F.explode(paths.trigrams(F.col("name_l"))).alias("trigram"), "id")
