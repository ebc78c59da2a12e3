"""Reads of the graph: lookups, neighbours, listings, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ontology import primary
from tessera.sources.tables import cut

#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a task in which each of them becomes many, or all are held with all columns.
TASK_ROWS = 500_000
#: Pieces of texts that one task makes.
TASK_PIECES = 2_000_000
#: Words of 64 bits, a row each, that tell at which pieces nothing waits.
BIT_WORDS = 1 << 17
#: Letters of the pieces by which texts meet what they contain: the most that a needle has.
PIECES = (1, 2, 4, 8)


def _fits(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if _fits(df) else df


def few(df: DataFrame, else_by: str = "merge") -> DataFrame:
    """df, broadcast if it has few rows, else never, however small its files make it look."""
    return F.broadcast(df) if _fits(df) else df.hint(else_by)


def tasks(rows: DataFrame, each: int = 0) -> int:
    """The number of tasks that ``rows`` are to be dealt to: counted, since neither the files of a small table nor the bytes of a shuffle tell what becomes of a row."""
    return max(1, -(-rows.count() // (each or TASK_ROWS)))


def _pieces(text: Column, n: int) -> Column:
    """The substrings of n letters; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def _calls(texts: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """texts with a row for each place (__at) of each of their pieces (__piece) of so many letters, dealt to tasks by the number of pieces."""
    letters = texts.agg(F.sum(F.length(text))).first()[0] or 0
    dealt = texts.repartition(max(1, -(-letters * len(sizes) // TASK_PIECES)))
    each = dealt.withColumn("__size", F.explode(F.array([F.lit(k) for k in sizes]))).where(F.length(text) >= F.col("__size"))
    ends = F.when(F.col("__size") == 0, 1).otherwise(F.length(text) - F.col("__size") + 1)
    at = each.withColumn("__at", F.explode(F.sequence(F.lit(1), ends)))
    return at.withColumn("__piece", F.substring(text, F.col("__at"), F.col("__size"))).drop("__size")


def _likely(called: DataFrame, waiting: DataFrame) -> DataFrame:
    """called without most pieces at which nothing waits.

    Of the hash of each piece that waits three bits are set in one of BIT_WORDS words, so as many rows are broadcast at
    most, whatever the input.  That saves work only; the exact join follows.
    """
    if BIT_WORDS > BROADCAST_ROWS:
        return called
    hashed = lambda rows: rows.withColumn("__h", F.xxhash64("__piece"))
    word = F.pmod(F.col("__h"), F.lit(BIT_WORDS)).alias("__word")
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(__h, {by}) & 63 as int))" for by in (32, 40, 48)))
    words = cut(hashed(waiting.select("__piece").distinct()).groupBy(word).agg(F.bit_or(mask).alias("__bits")))
    near = hashed(called).withColumns({"__word": word, "__mask": mask}).join(F.broadcast(words), "__word")
    return near.where((F.col("__bits").bitwiseAND(F.col("__mask"))) == F.col("__mask")).select(called.columns)


def join_contained(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """texts with every row of needles whose ``needle`` stands in their ``text``; columns have names of their own.

    Not all pairs are compared: a needle waits at that piece of it which the fewest needles have, of the most letters of
    PIECES that it has, and a text calls at all its pieces.  Distinct texts call, and the pairs found are dealt to the rows
    at the end, by number.  A needle waits at one piece and counts where that piece stands first in the text, so no pair
    is found twice.  An empty needle is in every text; null is in none.
    """
    n, size = F.length(needle), F.lit(0)
    for k in PIECES:
        size = F.when(n >= k, k).otherwise(size)
    own = cut(needles.select(needle).where(F.col(needle).isNotNull()).distinct().withColumn("__size", size))
    sizes = sorted(r[0] for r in own.select("__size").distinct().collect()) or [0]
    of = F.array(F.lit("")).cast("array<string>")
    for k in PIECES:
        of = F.when(F.col("__size") == k, F.array_distinct(_pieces(F.col(needle), k))).otherwise(of)
    each = own.select(needle, F.explode(of).alias("__piece"))
    waiting = cut(each.join(each.groupBy("__piece").agg(F.count("*").alias("__n")).hint("merge"), "__piece").groupBy(needle).agg(F.min_by("__piece", F.struct("__n", "__piece")).alias("__piece")))
    asked = cut(texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("__text", F.monotonically_increasing_id()))
    # estimates of sizes know nothing of how many pieces a text has, so that side is never one to broadcast
    called = _calls(asked, text, sizes)
    called = called.join(F.broadcast(waiting), "__piece") if _fits(waiting) else _likely(called, waiting).join(waiting.hint("merge"), "__piece")
    first = F.call_function("locate", F.col("__piece"), F.col(text)) == F.col("__at")
    pairs = called.where(F.contains(F.col(text), F.col(needle)) & first).select("__text", needle)
    return texts.join(few(asked), text).join(pairs.join(needles.hint("merge"), needle).hint("merge"), "__text").drop("__text")


def default(c: str, value: str | int) -> Column:
    """The column, where null or empty its default."""
    return (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(value)) if isinstance(value, str) else F.coalesce(F.col(c), F.lit(value))).alias(c)


def lookup_sections(ids: DataFrame, sections: DataFrame) -> DataFrame:
    return ids.join(sections, "section_id")


def act_metadata(acts: DataFrame) -> DataFrame:
    """Acts with defaults, by id."""
    return acts.where("act_id is not null").select(
        "act_id", default("act_name", ""), default("short_name", ""), default("jurisdiction", "Central"), default("status", "in_force"), default("in_force_from", ""), default("repealed_by", ""), default("repeal_authority", ""), default("act_priority", 0)
    ).orderBy("act_id")


def with_act_meta(sections: DataFrame, acts: DataFrame) -> DataFrame:
    """sections with name, territory, status and priority of their acts, defaults where unknown."""
    meta = acts.select("act_id", "act_name", "jurisdiction", F.col("status").alias("in_force_status"), "act_priority")
    joined = sections.drop("act_name", "jurisdiction").join(small(meta), "act_id", "left")
    keep = [c for c in sections.columns if c not in ("act_name", "jurisdiction")]
    return joined.select(*keep, default("act_name", ""), default("jurisdiction", "Central"), default("in_force_status", "in_force"), default("act_priority", 0))


def sections_for_exact_concept(asked: DataFrame, concepts: DataFrame, applies_to: DataFrame, sections: DataFrame) -> DataFrame:
    """asked (query_id, concept) joined with the sections of the concept of that name, in any case."""
    named = concepts.select("concept_id", F.col("name").alias("concept_name"))
    found = asked.join(named, F.lower("concept") == F.lower("concept_name"))
    return found.join(applies_to, "concept_id").join(sections, "section_id")


def sections_for_concept(asked: DataFrame, concepts: DataFrame, applies_to: DataFrame, sections: DataFrame) -> DataFrame:
    """The same where name or alias contains the phrase or is contained in it.  An empty phrase matches all."""
    terms = concepts.select("concept_id", F.col("name").alias("concept_name"), F.explode(F.concat(F.array("name"), "aliases")).alias("term")).withColumn("term", F.lower("term"))
    low, keep = asked.withColumn("__low", F.lower("concept")), [*asked.columns, "concept_id", "concept_name"]
    both = join_contained(low, "__low", terms, "term").select(*keep).unionByName(join_contained(terms, "term", low, "__low").select(*keep))
    found = both.dropDuplicates([*asked.columns, "concept_id"])
    return found.join(applies_to, "concept_id").join(sections, "section_id")


def anchor_order() -> list[Column]:
    """Primaries first, then act, then section number as text."""
    return [F.when(primary(F.col("relevance")), 0).otherwise(1), F.col("act_id"), F.col("section_number")]


def edge_view(cites: DataFrame, applies_to: DataFrame, overrides: DataFrame, sections: DataFrame) -> DataFrame:
    """(src, dst, rel_type) of all kinds of edges."""
    return (
        cites.select(F.col("source_section_id").alias("src"), F.col("target_section_id").alias("dst"), F.lit("CITES").alias("rel_type"))
        .unionByName(applies_to.select(F.col("section_id").alias("src"), F.col("concept_id").alias("dst"), F.lit("APPLIES_TO").alias("rel_type")))
        .unionByName(overrides.select(F.col("newer_act_id").alias("src"), F.col("older_act_id").alias("dst"), F.lit("OVERRIDES").alias("rel_type")))
        .unionByName(sections.select(F.col("act_id").alias("src"), F.col("section_id").alias("dst"), F.lit("HAS_SECTION").alias("rel_type")))
    )


def neighbors(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(section_id, neighbor_id, rel_type, direction), distinct, over edges either way."""
    way = lambda at, to, name: F.struct(F.col(at).alias("section_id"), F.col(to).alias("neighbor_id"), "rel_type", F.lit(name).alias("direction"))
    both = edges.select(F.explode(F.array(way("src", "dst", "outgoing"), way("dst", "src", "incoming"))).alias("e")).select("e.*")
    return both.join(ids.select("section_id"), "section_id", "left_semi").distinct()


def induced_subgraph(members: DataFrame, cites: DataFrame) -> DataFrame:
    """Edges of which both ends are members (query_id, section_id) of one query."""
    src = members.select("query_id", F.col("section_id").alias("source_section_id"))
    dst = members.select("query_id", F.col("section_id").alias("target_section_id"))
    return src.join(cites.select("source_section_id", "target_section_id"), "source_section_id").join(dst, ["query_id", "target_section_id"], "left_semi").select("query_id", "source_section_id", "target_section_id").distinct()


def graph_stats(acts: DataFrame, sections: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): nodes by label, edges by type."""
    nodes = acts.select(F.lit("Act").alias("label")).unionAll(sections.select(F.lit("Section"))).unionAll(concepts.select(F.lit("Concept")))
    both = nodes.select(F.lit("node").alias("kind"), "label").unionAll(edges.select(F.lit("edge"), "rel_type"))
    return both.groupBy("kind", "label").agg(F.count("*").alias("n"))


def list_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", "name").orderBy("name", "concept_id")
