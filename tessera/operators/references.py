"""Citations between sections of one act, from their texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import section_number, squeeze

#: How sections are cited.
SECTION_REF = r"(?i)\b(?:section|sections|sec\.|secs\.)\s+(\d+[A-Z]{0,3}(?:-[A-Z]{1,3})?)(?:\s*(?:to|-|and)\s*(\d+[A-Z]{0,3}(?:-[A-Z]{1,3})?))?"
SUBSECTION_REF = r"(?i)\bsub-section\s*\([^)]+\)\s+of\s+section\s+(\d+[A-Z]{0,3}(?:-[A-Z]{1,3})?)"
#: What follows when another law or body is meant.
EXTERNAL_KINDS = "Act Code Rules Rule Regulation Regulations Order Ordinance Corporation Commission Authority Board Tribunal Court Constitution".split()
EXTERNAL_AFTER = rf"(?i)\bof\s+(?:the\s+)?[A-Z][A-Za-z&.,'’() -]{{0,120}}?\b({'|'.join(EXTERNAL_KINDS)})\b"
#: Names of other laws and bodies.
EXTERNAL_NAMES = (
    "Companies Act", "Company Act", "Factories Act", "Factory Act", "Employees.? State Insurance Act", "Employees.? Provident Fund", "Payment of Wages Act", "Minimum Wages Act", "Payment of Gratuity Act",
    "Industrial Disputes Act", "Trade Unions Act", "Income[- ]?tax Act", "Indian Penal Code", "Code of Criminal Procedure", "Criminal Procedure Code", "Constitution of India", "Contract Labour",
    "Shops and Commercial Establishments Act", "Maternity Benefit Act", "Apprentices Act", "Bonus Act", "Railways Act", "Mines Act", "Plantations Labour Act", "Consumer Protection Act",
    "Sexual Harassment of Women at Workplace", "Life Insurance Corporation Act", "Food Corporations Act", "Warehousing Corporations Act", "State Bank of India Act", "Banking Companies",
    "Airports Authority of India Act", "Dock Workers", "Coal Mines Provident Fund", "Industrial Finance Corporation", "National Housing Bank", "Regional Rural Banks Act",
    "Small Industries Development Bank", "Working Journalists", "Sales Promotion Employees", "Karnataka Gazette", "Official Gazette",
)
#: Hints that the same act is meant.
INTERNAL_HINTS = (
    "this Act", "this Code", "this Chapter", "this section", "this sub-section", "the foregoing provisions", "the provisions of this Act", "under this Act", "under this Code", "for the purposes of this Act",
    "for the purposes of this section", "in accordance with this Act", "as provided in", "referred to in", "specified in", "mentioned in", "subject to", "notwithstanding anything contained in",
    "save as otherwise provided in", "under section", "under sections", "in section", "in sections", "sub-section",
)
BEFORE, AFTER = 140, 160
#: Letters of a text's pages, and values summed at once.
PAGE, CHUNK = 4096, 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _running_sums(values: Column) -> Column:
    """The sums of all values before each: within chunks, and over the chunks' sums, so no array grows step by step."""
    add = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    each = lambda chunk, base: F.transform(chunk, lambda v, i: base + add(F.slice(chunk, F.lit(1), i)))
    bases = lambda chunks: _let(F.transform(chunks, add), lambda sums: F.transform(sums, lambda v, c: add(F.slice(sums, F.lit(1), c))))
    whole = _let(cut_up, lambda chunks: F.flatten(F.zip_with(chunks, bases(chunks), each)))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _matches(text: Column, pages: Column, pattern: str, groups: int, kind: int) -> Column:
    """Structs (start, end, kind, ord, a, b, near, following), 0-based, end exclusive: running sums of pieces and matches."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    spans = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("m")))
    number = lambda m, g: F.nullif(F.regexp_extract(m, pattern, g), F.lit("")) if g <= groups else F.lit(None).cast("string")

    def row(x: Column, start: Column, end: Column, i: Column) -> Column:
        lo = F.greatest(start - BEFORE, F.lit(0))
        cut_out = lambda at, n: F.substring(pages[F.floor(at / PAGE).cast("int")], at % PAGE + 1, n)
        long = end - start > PAGE  # a match with very much blank in it
        near = F.when(long, F.substring(text, lo + 1, end + BEFORE - lo)).otherwise(cut_out(lo, end + BEFORE - lo))
        return F.struct(
            start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), i.alias("ord"), number(x["m"], 1).alias("a"), number(x["m"], 2).alias("b"),
            squeeze(near).alias("near"), squeeze(F.when(end >= F.length(text), "").otherwise(cut_out(end, F.lit(AFTER)))).alias("following"),
        )

    def rows(spans: Column) -> Column:
        before = _let(F.transform(spans, lambda x: x["gap"] + x["len"]), _running_sums)
        return F.transform(F.zip_with(spans, before, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda z, i: row(z["x"], z["at"] + z["x"]["gap"], z["at"] + z["x"]["gap"] + z["x"]["len"], i))

    return _let(spans, rows)


def reference_candidates(sections: DataFrame) -> DataFrame:
    """sections with raw_no, start, end, cand_ord, near and following, without their texts: a pair or range gives both its ends, with one span.

    The words around a match are cut from a page of the text, so a candidate costs the same wherever it stands, and none carries the whole text.
    """
    text = F.coalesce("section_text", F.lit(""))
    pages = lambda t: F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / PAGE).cast("int")), lambda k: F.substring(t, k * PAGE + 1, F.lit(2 * PAGE + BEFORE * 2 + AFTER)))
    found = _let(text, lambda t: _let(pages(t), lambda p: F.concat(_matches(t, p, SECTION_REF, 2, 0), _matches(t, p, SUBSECTION_REF, 1, 1))))
    each = sections.select(*[c for c in sections.columns if c != "section_text"], F.explode(found).alias("__m"))
    each = each.withColumn("__n", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("i"), F.col("__m.a").alias("no")), F.struct(F.lit(1).alias("i"), F.col("__m.b").alias("no"))), lambda x: x["no"].isNotNull())))
    columns = {"raw_no": F.col("__n.no"), "cand_ord": (F.col("__m.kind") * 1_000_000_000 + F.col("__m.ord")).cast("bigint") * 2 + F.col("__n.i")}
    return each.withColumns(columns | {c: F.col(f"__m.{c}") for c in ("start", "end", "near", "following")}).drop("__m", "__n")


def section_lookup(sections: DataFrame) -> DataFrame:
    """(act_id, number, target_id): the last row of a key wins."""
    keyed = sections.select("act_id", section_number(F.col("section_number"), upper=True).alias("number"), F.col("section_id").alias("target_id"), "ord")
    last = Window.partitionBy("act_id", "number").orderBy(F.desc("ord"))
    return keyed.withColumn("n", F.row_number().over(last)).where("n = 1").select("act_id", "number", "target_id")


def is_external(near: Column, following: Column, act_name: Column, short_name: Column) -> Column:
    """Another law is meant, unless this act is named nearby (a bare substring is enough)."""
    both = F.concat_ws(" ", near, following)
    own = F.contains(F.lower(both), F.lower(act_name)) | F.contains(F.lower(both), F.lower(short_name))
    return ~own & (F.rlike(following, F.lit(EXTERNAL_AFTER)) | F.rlike(both, F.lit(rf"(?i)\b({'|'.join(EXTERNAL_NAMES)})\b")))


def has_internal_hint(near: Column) -> Column:
    return F.rlike(near, F.lit(rf"(?i)\b({'|'.join(INTERNAL_HINTS)})\b"))


def resolve_references(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """Candidates whose number is another section of the same act."""
    numbered = candidates.withColumn("number", section_number(F.col("raw_no"), upper=True)).where(F.col("number") != section_number(F.col("section_number"), upper=True))
    return numbered.join(lookup, ["act_id", "number"]).where("target_id != section_id")


def extract_cites(sections: DataFrame) -> DataFrame:
    """Edges between sections (rows carry ``ord``, the input order); the first evidence of an edge is kept."""
    found = resolve_references(reference_candidates(sections), section_lookup(sections))
    found = found.where(~is_external(F.col("near"), F.col("following"), F.col("act_name"), F.col("short_name")) & has_internal_hint(F.col("near")))
    first = Window.partitionBy("section_id", "target_id").orderBy("ord", "cand_ord")
    kept = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select(
        F.col("section_id").alias("source_section_id"), F.col("act_id").alias("source_act_id"), F.lit("CITES").alias("relationship_type"), F.col("target_id").alias("target_section_id"), F.col("number").alias("target_section_number"), F.col("near").alias("evidence_text")
    )
