"""Readers and writers.  Each reader declares its schema; malformed input is an error that names its line or element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import break_before_first_header
from tessera.sources.snapshots import publish


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; lines count from 1 and blank ones count, too.

    A file is read in pieces: lines are numbered within each, and the pieces' counts, a row for each of them, tell where it
    begins.  So no task holds more of a file than a piece.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"))
    counts = raw.groupBy("file", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "piece", "first", F.coalesce(before, F.lit(0)).alias("before"))
    # ids of a piece's lines follow each other, as one task reads them in order
    return raw.join(starts, ["file", "piece"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def _parsed(rows: DataFrame, text: str, schema: str) -> tuple[DataFrame, list[str], Column]:
    """rows with r, the record in a JSON object's text; its fields; and whether the text is no such record."""
    out = rows.withColumn("r", F.from_json(text, f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r").isNull() | F.col("r.__bad").isNotNull() | ~F.startswith(F.ltrim(text), F.lit("{"))
    return out, [f.name for f in out.schema["r"].dataType.fields if f.name != "__bad"], F.coalesce(bad, F.lit(True))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with file and line, bad lines as (file, line, text)) of JSON lines; blank lines are neither."""
    rows, names, bad = _parsed(numbered_lines(spark, path).where(F.trim("value") != ""), "value", schema)
    return rows.where(~bad).select("file", "line", *[F.col(f"r.{c}").alias(c) for c in names]), rows.where(bad).select("file", "line", F.col("value").alias("text"))


def _strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records; a malformed line is an error that names it."""
    rows, names, bad = _parsed(numbered_lines(spark, path).where(F.trim("value") != ""), "value", schema)
    named = F.concat(F.lit("malformed record in "), "file", F.lit(", line "), F.col("line").cast("string"))
    return rows.where(F.when(bad, F.raise_error(named).cast("boolean")).otherwise(True)).select(*[F.col(f"r.{c}").alias(c) for c in names])


def _json(spark: SparkSession, path: str, schema: str, start: str) -> DataFrame:
    """Records of files that are one JSON value each, an array of objects ([) or an object ({); ``__i`` is the place in the array.

    A value of another kind, or a malformed one, is an error that names the file and the element.
    """
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    texts = F.when(F.startswith(F.ltrim("value"), F.lit(start)), F.from_json("value", "array<string>") if start == "[" else F.array("value"))
    unread = whole.withColumn("texts", texts)
    known = F.when(F.col("texts").isNull(), F.raise_error(F.concat(F.lit("no array in " if start == "[" else "no object in "), "file")).cast("boolean")).otherwise(True)
    each = unread.where(known).select("file", F.posexplode("texts").alias("__i", "text"))
    rows, names, bad = _parsed(each, "text", schema)
    named = F.concat(F.lit("malformed element "), F.col("__i").cast("string"), F.lit(" of "), "file")
    return rows.where(F.when(bad, F.raise_error(named).cast("boolean")).otherwise(True)).select("__i", *[F.col(f"r.{c}").alias(c) for c in names])


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """One section a line; blank lines don't count."""
    return _strict(spark, path, schemas.SECTIONS)


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    return _strict(spark, path, schemas.CITES_RAW)


def read_concept_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concepts with their order, applies_to) from an array of nested concepts."""
    raw = _json(spark, path, schemas.CONCEPT_MAP, "[").withColumn("ord", F.col("__i").cast("bigint"))
    concepts = raw.select("concept_id", "name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "ord")
    maps = raw.select("concept_id", F.posexplode("maps_to").alias("ord", "m")).select("m.section_id", "concept_id", F.coalesce("m.relevance", F.lit("supporting")).alias("relevance"), "ord")
    return concepts, maps


def read_act_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(acts with their order, jurisdiction aliases with their order)."""
    raw = _json(spark, path, schemas.ACT_METADATA, "{")
    acts = raw.select(F.posexplode("acts").alias("ord", "a")).select("ord", "a.*")
    text = lambda c, default="": F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)
    acts = acts.select(
        "ord", "act_id", text("act_name"), text("short_name"), text("jurisdiction", "Central"), text("status", "in_force"), text("in_force_from"), F.coalesce("repeals", F.array().cast("array<string>")).alias("repeals"),
        text("repealed_by"), text("repeal_authority"), F.coalesce("act_priority", F.lit(0)).alias("act_priority"), text("covers"),
    )
    aliases = raw.select(F.posexplode(F.map_entries(F.from_json("jurisdiction_aliases", "map<string,string>"))).alias("ord", "e"))
    return acts, aliases.select(F.lower("e.key").alias("alias"), F.col("e.value").alias("jurisdiction"), "ord")


def act_metadata_violations(acts: DataFrame) -> DataFrame:
    """(act_id, problem): one row for each broken rule; an empty table breaks one too."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = F.array(
        F.when(missing("act_id"), "act_id is missing"),
        F.when(~F.coalesce("status", F.lit("")).isin("in_force", "repealed"), "status is unknown"),
        F.when((F.col("status") == "repealed") & missing("repeal_authority"), "repealed without authority"),
    )
    broken = acts.select("act_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem"))
    none = acts.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("act_id"), F.lit("no acts").alias("problem"))
    return broken.unionByName(none)


_SECTION_MAP = "mappings string, extra_aliases string, state_only_concepts array<string>"


def read_section_map_extras(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(extra aliases as (concept_id, alias, ord), concepts that need no central law as (concept_id)) of the same object."""
    raw = _json(spark, path, _SECTION_MAP, "{")
    each = raw.select(F.posexplode(F.map_entries(F.from_json("extra_aliases", "map<string,array<string>>"))).alias("i", "e")).where(~F.startswith(F.col("e.key"), F.lit("_")))
    aliases = each.select("i", F.col("e.key").alias("concept_id"), F.posexplode("e.value").alias("j", "alias"))
    return aliases.select("concept_id", "alias", (F.col("i").cast("bigint") * 100_000 + F.col("j")).alias("ord")), raw.select(F.explode("state_only_concepts").alias("concept_id"))


def read_section_map(spark: SparkSession, path: str) -> DataFrame:
    """(section_id, concept_id, relevance, ord) from an object of lists of pairs; keys that start with _ are comments."""
    raw = _json(spark, path, _SECTION_MAP, "{")
    each = raw.select(F.posexplode(F.map_entries(F.from_json("mappings", "map<string,array<array<string>>>"))).alias("i", "e")).where(~F.startswith(F.col("e.key"), F.lit("_")))
    pairs = each.select("i", F.col("e.key").alias("section_id"), F.posexplode("e.value").alias("j", "p"))
    return pairs.select("section_id", F.col("p")[0].alias("concept_id"), F.col("p")[1].alias("relevance"), (F.col("i").cast("bigint") * 100_000 + F.col("j")).alias("ord"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.CASES, "[").drop("__i")


def document_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of pages (key, page_no, text): joined by lines, words broken at line ends mended."""
    joined = pages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return joined.select(key, break_before_first_header(F.regexp_replace("text", "-\n", "")).alias("text"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_concept_map(concepts: DataFrame, errors: DataFrame, path: str, dry_run: bool = False) -> bool:
    """Publish the concepts only if there are no errors and it isn't a trial; tells whether it did.

    They replace the earlier ones as one (``snapshots.read_table(spark, path, "concepts")``).
    """
    if dry_run or not errors.isEmpty():
        return False
    publish({"concepts": concepts}, path)
    return True


def first_rows(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
