"""Tables of the graph: upserts, gates and checks.  Every gate returns what it refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.snapshots import publish


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """existing with the rows of new merged in: fields that new gives win; the last row of a key in ``order`` wins."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", order)
    fields = [c for c in existing.columns if c not in keys]
    a, b = existing.alias("a"), new.alias("b")
    merged = a.join(b, keys, "full_outer")
    value = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c)
    return merged.select(*keys, *[value(c) for c in fields])


def upsert_acts(existing: DataFrame, sections: DataFrame) -> DataFrame:
    """Acts as their section rows name them."""
    return upsert(existing, sections.select("act_id", "act_name", "year", "jurisdiction", "short_name", "ord"), ["act_id"], "ord")


def upsert_sections(existing: DataFrame, new: DataFrame, acts: DataFrame) -> DataFrame:
    """Only sections of acts that exist."""
    return upsert(existing, new.join(acts.select("act_id"), "act_id", "left_semi"), ["section_id"], "ord" if "ord" in new.columns else None)


def upsert_cites(existing: DataFrame, new: DataFrame, sections: DataFrame) -> DataFrame:
    """Only CITES rows with both ends there; the last evidence wins."""
    ids = sections.select(F.col("section_id").alias("__id")).distinct()
    ok = new.where("relationship_type = 'CITES'")
    for end in ("source_section_id", "target_section_id"):
        ok = ok.join(ids, ok[end] == ids["__id"], "left_semi")
    return upsert(existing, ok, ["source_section_id", "target_section_id"], "ord" if "ord" in new.columns else None)


def upsert_concepts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Raises if a concept has no id; missing texts become empty."""
    if not new.where("concept_id is null or concept_id = ''").isEmpty():
        raise ValueError("a concept has no concept_id")
    filled = new.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "description")} | {"aliases": F.coalesce("aliases", F.array().cast("array<string>"))})
    return upsert(existing, filled, ["concept_id"], "ord" if "ord" in new.columns else None)


def load_applies_to(maps: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applies_to, skipped with a reason)."""
    known = sections.select("section_id").distinct().withColumn("__known", F.lit(True))
    gate = maps.join(known, "section_id", "left").withColumn(
        "reason", F.when(F.coalesce("section_id", F.lit("")) == "", "MISSING_SECTION_ID").when(F.col("__known").isNull(), "SECTION_NOT_FOUND")
    )
    kept = gate.where("reason is null").select("section_id", "concept_id", F.coalesce("relevance", F.lit("supporting")).alias("relevance"))
    return kept.dropDuplicates(["section_id", "concept_id"]), gate.where("reason is not null").select("section_id", "concept_id", "reason")


def annotate_acts(acts: DataFrame, meta: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acts with status and dates, skipped with a reason): an update, never an insert.

    A repealed act whose authority is no section stays as it was.
    """
    fields = ["status", "in_force_from", "repealed_by", "repeal_authority", "act_priority"]
    ids = sections.select(F.col("section_id").alias("repeal_authority")).distinct().withColumn("__auth", F.lit(True))
    have = acts.select("act_id").distinct().withColumn("__have", F.lit(True))
    gate = meta.join(have, "act_id", "left").join(ids, "repeal_authority", "left").withColumn(
        "reason", F.when(F.col("__have").isNull(), "ACT_NOT_FOUND").when((F.col("status") == "repealed") & F.col("__auth").isNull(), "AUTHORITY_NOT_FOUND")
    )
    good = gate.where("reason is null").select("act_id", *[F.col(c).alias(f"__{c}") for c in fields])
    base = acts.drop(*fields).join(good, "act_id", "left")
    for c in fields:
        base = base.withColumnRenamed(f"__{c}", c)
    return base, gate.where("reason is not null").select("act_id", "reason")


def build_overrides(meta: DataFrame, annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newer_act_id, older_act_id, authority), and targets that don't exist."""
    own = annotated.where("status is not null").select("act_id").distinct()
    each = meta.join(own, "act_id", "left_semi").select(F.col("act_id").alias("newer_act_id"), F.explode("repeals").alias("older_act_id"))
    older = annotated.select(F.col("act_id").alias("older_act_id"), F.col("repeal_authority").alias("authority"))
    return each.join(older, "older_act_id").select("newer_act_id", "older_act_id", "authority"), each.join(older, "older_act_id", "left_anti").select("newer_act_id", "older_act_id")


def reload_tables(tables: dict[str, DataFrame], path: str) -> int:
    """Replace everything that was there, tables that aren't given too; if any can't be written, all stay as they were."""
    return publish(tables, path)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{key} is not unique")


def load_summary(acts: DataFrame, sections: DataFrame, cites: DataFrame) -> DataFrame:
    """(act_id, act_name, n_sections, n_cites): acts without sections count 0; n_cites is of all."""
    per_act = acts.join(sections.select("act_id", "section_id"), "act_id", "left").groupBy("act_id", "act_name").agg(F.count("section_id").alias("n_sections"))
    return per_act.crossJoin(F.broadcast(cites.agg(F.count("*").alias("n_cites"))))  # one row
