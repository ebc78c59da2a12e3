"""Rebuilding the ontology, and checks of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEVANCES = ("primary", "supporting")


def primary(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))) == "primary"


def merge_concepts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing, then what new adds by id; ``ord`` keeps both orders."""
    fresh = new.join(existing.select("concept_id"), "concept_id", "left_anti").select(*existing.columns)
    both = existing.withColumn("__part", F.lit(0)).unionByName(fresh.withColumn("__part", F.lit(1)))
    return both.withColumn("ord", F.col("__part") * F.lit(1 << 40) + F.col("ord")).drop("__part")


def merge_aliases(concepts: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts with aliases added, error rows, (n_added)).  extra has concept_id, alias, ord.

    An alias that is there in any case isn't added; the first spelling stays.
    """
    known = concepts.select("concept_id").distinct()
    errors = extra.join(known, "concept_id", "left_anti").select("concept_id").distinct().select("concept_id", F.lit("unknown concept in extra aliases").alias("problem"))
    old = concepts.select("concept_id", F.posexplode("aliases").alias("i", "alias")).select("concept_id", "alias", F.lit(0).alias("part"), F.col("i").cast("bigint").alias("at"))
    new = extra.join(known, "concept_id", "left_semi").select("concept_id", "alias", F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("at"))
    seen = Window.partitionBy("concept_id", F.lower("alias")).orderBy("part", "at")
    fresh = old.unionByName(new).withColumn("n", F.row_number().over(seen)).where("n = 1 and part = 1")
    added = fresh.groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("more"))
    merged = concepts.join(added, "concept_id", "left").withColumn("aliases", F.concat("aliases", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    return merged, errors, fresh.agg(F.count("*").alias("n_added"))


def mapping_errors(pairs: DataFrame, sections: DataFrame, concepts: DataFrame) -> DataFrame:
    """(section_id, concept_id, problem): unknown section first, then unknown concept, then relevance."""
    s = sections.select("section_id").distinct().withColumn("__s", F.lit(True))
    c = concepts.select("concept_id").distinct().withColumn("__c", F.lit(True))
    problem = F.when(F.col("__s").isNull(), "unknown section").when(F.col("__c").isNull(), "unknown concept").when(~F.coalesce("relevance", F.lit("")).isin(*RELEVANCES), "bad relevance")
    return pairs.join(s, "section_id", "left").join(c, "concept_id", "left").withColumn("problem", problem).where("problem is not null").select("section_id", "concept_id", "problem")


def merge_mappings(applies_to: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, (added, upgraded)): new pairs are inserted, supporting becomes primary, never the other way."""
    rank = F.when(primary(F.col("relevance")), 0).otherwise(1)
    new = pairs.groupBy("section_id", "concept_id").agg(F.min(rank).alias("new"))
    old = applies_to.groupBy("section_id", "concept_id").agg(F.min(rank).alias("old"))
    both = old.join(new, ["section_id", "concept_id"], "full_outer")
    merged = both.select("section_id", "concept_id", F.when(F.least("old", "new") == 0, "primary").otherwise("supporting").alias("relevance"))
    stats = both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if((F.col("old") == 1) & (F.col("new") == 0)).alias("upgraded"))
    return merged, stats


def sorted_mappings(applies_to: DataFrame) -> DataFrame:
    """(concept_id, maps_to): primaries first, then by section."""
    row = F.struct(F.when(primary(F.col("relevance")), 0).otherwise(1).alias("rank"), "section_id", "relevance")
    return applies_to.groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["section_id"].alias("section_id"), x["relevance"].alias("relevance"))).alias("maps_to"))


def anchor_errors(concepts: DataFrame, applies_to: DataFrame, sections: DataFrame, acts: DataFrame, state_only: DataFrame) -> DataFrame:
    """(concept_id, problem): no primary in force, or none of central law where one is needed."""
    live = applies_to.where(primary(F.col("relevance"))).join(sections.select("section_id", "act_id"), "section_id").join(acts.select("act_id", "status", "jurisdiction"), "act_id").where("status != 'repealed'")
    counts = live.groupBy("concept_id").agg(F.count("*").alias("live"), F.count_if(F.col("jurisdiction") == "Central").alias("central"))
    excused = state_only.select("concept_id").distinct().withColumn("__state", F.lit(True))
    each = concepts.select("concept_id").join(counts, "concept_id", "left").join(excused, "concept_id", "left")
    problem = F.when(F.coalesce("live", F.lit(0)) == 0, "no primary in force").when((F.coalesce("central", F.lit(0)) == 0) & F.col("__state").isNull(), "no central primary in force")
    return each.withColumn("problem", problem).where("problem is not null").select("concept_id", "problem")


def coverage_stats(applies_to: DataFrame, sections: DataFrame, acts: DataFrame) -> DataFrame:
    """(act_id, total, mapped, live, live_mapped, unmapped_live) for each act with sections."""
    mapped = applies_to.select("section_id").distinct().withColumn("__m", F.lit(True))
    rows = sections.select("section_id", "act_id").join(mapped, "section_id", "left").join(acts.select("act_id", "status"), "act_id", "left")
    live, m = F.coalesce("status", F.lit("in_force")) != "repealed", F.col("__m").isNotNull()
    return rows.groupBy("act_id").agg(F.count("*").alias("total"), F.count_if(m).alias("mapped"), F.count_if(live).alias("live"), F.count_if(live & m).alias("live_mapped"), F.count_if(live & ~m).alias("unmapped_live"))
