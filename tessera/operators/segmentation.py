"""Documents into sections.

A document is cut by a pointer into the list of expected numbers: a line opens a section only if it bears the next
number.  Documents of a usual length are cut in one row, so that nothing but their text moves.  The lines of longer ones are rows; there, with many header
lines, the walk is a chain of pointers between them, followed by doubling, and everything else is windows and joins, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.tables import FILE_FACTOR, cut

#: Lines that may open a section, up to which a document of many lines is walked in one row.
FOLDED = 64
#: Lines up to which a document is cut into sections in one row.
FOLDED_LINES = 1000
#: A line after which nothing counts until a section opens.
AMENDMENT = "STATE AMENDMENT"
#: What a document's configuration says of its act.
ABOUT = ("act_id", "act_name", "year", "jurisdiction", "short_name", "source_file")


def document_lines(docs: DataFrame, col: str) -> DataFrame:
    """(doc_id, pos, line): cleaned lines that aren't empty."""
    # cleaned before they are dealt to rows, else the filter would clean them once more
    return docs.select("doc_id", F.posexplode(F.transform(T.lines(F.col(col)), T.clean_line)).alias("pos", "line")).where("line != ''")


def headers(lines: DataFrame) -> DataFrame:
    """lines with number (null where no section could open) and rest."""
    m = F.rlike("line", F.lit(T.SECTION_START))
    return lines.withColumns({"number": F.when(m, T.section_number(F.regexp_extract("line", T.SECTION_START, 1))), "rest": F.when(m, T.strip(F.regexp_extract("line", T.SECTION_START, 2)))})


def _number(line: Column) -> Column:
    """What a line of ``clean_line`` that may open a section begins with, before ``section_number``; empty for others."""
    return F.when(T.lettered(line), "").otherwise(F.regexp_extract(line, T.SECTION_START, 1))


def expected_sections(lines: Column) -> Column:
    """Numbers in the cleaned lines of an arrangement, up to the first schedule, each number once."""
    listed = lambda x: F.array_distinct(F.transform(F.filter(F.transform(F.filter(x, lambda line: ~T.is_noise(line)), _number), lambda n: n != ""), lambda n: T.section_number(n)))
    return T.once(lines, lambda x: listed(_before(x, F.array_position(F.transform(x, lambda line: F.rlike(line, F.lit(T.SCHEDULE_HEADING))), F.lit(True)))))


def _before(lines: Column, at: Column) -> Column:
    """Lines before place ``at`` (0: all)."""
    return T.once(at.cast("int"), lambda n: F.when(n > 0, F.slice(lines, F.lit(1), n - 1)).otherwise(lines))


def _opened(lines: Column, expected: Column) -> Column:
    """Places of a document's cleaned lines that open a section, one for each expected number as far as these come."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("at"))
    heads = lambda numbers: F.filter(F.transform(numbers, lambda n, i: F.when(n != "", i)), F.isnotnull)
    opens = lambda acc, number: T.section_number(number) == F.try_element_at(expected, acc["next"] + 1)
    step = lambda numbers: lambda acc, i: F.when(opens(acc, F.try_element_at(numbers, i + 1)), F.struct((acc["next"] + 1).alias("next"), F.concat(acc["at"], F.array(i)).alias("at"))).otherwise(acc)
    return T.once(F.transform(lines, _number), lambda numbers: F.aggregate(heads(numbers), start, step(numbers), lambda acc: acc["at"]))


def folded_sections(lines: Column, expected: Column) -> Column:
    """[(ord, number, buffer)] of a document's cleaned lines and expected numbers: ``segment`` in one row.

    First the places of lines that open, then for each of them what stands up to the next.
    """
    body = lambda x: F.filter(_before(x, F.array_position(F.transform(x, F.upper), F.lit(AMENDMENT))), T.tells)
    rest = lambda line: T.strip(F.regexp_extract(line, T.SECTION_START, 2))

    def sections(x: Column, opened: Column) -> Column:
        upto = lambda k: F.coalesce(F.try_element_at(opened, k + 2), F.size(x))
        parts = lambda at, k: F.concat(F.array(rest(F.try_element_at(x, at + 1))), T.once(F.slice(x, at + 2, upto(k) - at - 1), body))
        return F.transform(opened, lambda at, k: F.struct(k.alias("ord"), F.try_element_at(expected, k + 1).alias("number"), F.array_join(parts(at, k), " ").alias("buffer")))

    return T.once(lines, lambda x: T.once(_opened(x, expected), lambda opened: sections(x, opened)))


def opened_lines(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, pos, number, ord) of header lines that bear the next expected number.

    The pointer never skips: without a header for a number, later ones never open.  Where a document has few such lines the pointer
    passes over them in one row; longer ones are chains of pointers.
    """
    known = candidates.join(expected, ["doc_id", "number"]).select("doc_id", "number", "ord", "pos")
    known = cut(known.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))))
    short, long = known.where(F.col("n") <= FOLDED), known.where(F.col("n") > FOLDED).drop("n")
    walked = short.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "number", "ord"))).alias("lines")).select("doc_id", F.explode(_walk(F.col("lines"))).alias("x"))
    opened = walked.select("doc_id", "x.pos", "x.number", "x.ord")
    return opened if long.isEmpty() else opened.unionByName(_chained(long))


def _walk(lines: Column) -> Column:
    """Of lines (pos, number, ord) those that open, one after the other; where a number follows itself, a line opens one of the two."""
    start = F.struct(F.lit(0).alias("next"), F.lit(-1).alias("pos"), F.slice(lines, F.lit(1), F.lit(0)).alias("out"))
    opens = lambda at, x: (x["ord"] == at["next"]) & (x["pos"] > at["pos"])
    step = lambda at, x: F.when(opens(at, x), F.struct((at["next"] + 1).alias("next"), x["pos"].alias("pos"), F.concat(at["out"], F.array(x)).alias("out"))).otherwise(at)
    return F.aggregate(lines, start, step, lambda at: at["out"])


def _chained(known: DataFrame) -> DataFrame:
    """The same for rows (doc_id, number, ord, pos) of any number.

    Each line that bears an expected number points to the first later one with the number after it; what opens is the chain
    from the first line of the first number.  The chain is followed by doubling: a round joins what is known to open with the
    lines that lie 1, 2, 4, ... pointers on, so a document's lines are rows throughout, and the rounds grow with the logarithm of its sections.
    """
    # a number's lines and those of the next one, from the last to the first: the last seen of the next one is the first that follows
    both = known.select("doc_id", F.col("ord").alias("level"), "pos", "number", F.lit(None).cast("int").alias("next")).unionByName(
        known.where("ord > 0").select("doc_id", (F.col("ord") - 1).alias("level"), "pos", F.lit(None).cast("string").alias("number"), F.col("pos").alias("next"))
    )
    back = Window.partitionBy("doc_id", "level").orderBy(F.desc("pos"), F.col("next").isNotNull())
    nodes = both.withColumn("next", F.last("next", True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("number is not null")
    # what a line itself could open next comes after it in that order, so "next" is a later line
    nodes = cut(nodes.withColumnsRenamed({"level": "ord"}))
    opened = nodes.where("ord = 0").groupBy("doc_id").agg(F.min("pos").alias("pos")).withColumn("ord", F.lit(0))
    steps = nodes.where("next is not null").select("doc_id", "ord", "pos", (F.col("ord") + 1).alias("to_ord"), F.col("next").alias("to_pos"))
    while True:
        steps = cut(steps)
        further = opened.join(steps, ["doc_id", "ord", "pos"]).select("doc_id", F.col("to_pos").alias("pos"), F.col("to_ord").alias("ord"))
        opened = cut(opened.unionByName(further))
        then = steps.select("doc_id", F.col("ord").alias("to_ord"), F.col("pos").alias("to_pos"), F.col("to_ord").alias("on_ord"), F.col("to_pos").alias("on_pos"))
        steps = steps.join(then, ["doc_id", "to_ord", "to_pos"]).select("doc_id", "ord", "pos", F.col("on_ord").alias("to_ord"), F.col("on_pos").alias("to_pos"))
        if further.isEmpty():
            return opened.join(nodes.select("doc_id", "ord", "pos", "number"), ["doc_id", "ord", "pos"]).select("doc_id", "pos", "number", "ord")


def segment(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, ord, number, buffer): sections with their lines joined by spaces.

    Header lines come before all filters.  After STATE AMENDMENT nothing counts until
    the next section opens; noise and footnotes are dropped; what precedes the first section, too.
    """
    known = cut(headers(lines))
    opened = opened_lines(known.where("number is not null").select("doc_id", "pos", "number"), expected)
    marked = known.drop("number").join(opened, ["doc_id", "pos"], "left")
    doc = Window.partitionBy("doc_id").orderBy("pos")
    amend = F.upper("line") == AMENDMENT
    event = F.when(F.col("ord").isNotNull(), F.lit("open")).when(amend, F.lit("amend"))
    marked = marked.withColumns({"at": F.last("ord", True).over(doc), "event": F.last(event, True).over(doc)})
    body = F.col("ord").isNull() & (F.col("event") == "open") & ~T.is_noise(F.col("line")) & ~T.is_footnote(F.col("line"))
    kept = marked.where(F.col("at").isNotNull() & (F.col("ord").isNotNull() | body))
    parts = kept.select("doc_id", F.col("at").alias("ord"), "pos", F.when(F.col("ord").isNotNull(), F.col("rest")).otherwise(F.col("line")).alias("part"), "number")
    return parts.groupBy("doc_id", "ord").agg(F.max("number").alias("number"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ").alias("buffer"))


def section_records(segments: DataFrame) -> DataFrame:
    """Section rows of segments with ABOUT: id, title and body, and what the document's configuration says of its act."""
    split = segments.withColumn("tb", T.title_and_body(F.col("buffer")))
    return split.select(
        "act_id", "act_name", "year", "jurisdiction", "short_name", F.concat("act_id", F.lit("_S"), "number").alias("section_id"), F.col("number").alias("section_number"),
        F.col("tb.title").alias("section_title"), F.col("tb.body").alias("section_text"), "source_file", "ord",
    )


def missing_sections(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found.select("doc_id", "number"), ["doc_id", "number"], "left_anti")


def _read(joined: DataFrame) -> DataFrame:
    """(doc_id, ABOUT, expected, lines, n) of documents with their configuration: cleaned lines of the body, and their number, as far as these go in one row."""
    arranged = F.col("parser_mode") == "arrangement_based"
    ab = T.split_arrangement(F.col("text"), F.col("start_marker"), F.col("fallback_start_marker"))
    body = F.when(arranged, T.cut_at_markers(F.col("ab.body"), F.col("stop_markers"))).otherwise(T.trim_to_body(F.col("text"), F.col("start_marker"), F.col("stop_markers")))
    derived = F.when(arranged, expected_sections(T.clean_lines(F.col("ab.arrangement")))).otherwise(F.array().cast("array<string>"))
    expected = F.when(F.size("expected_sections") > 0, F.col("expected_sections")).otherwise(derived)
    cleaned = joined.where("parser_mode in ('arrangement_based', 'body_only')").withColumn("ab", F.when(arranged, ab))
    cleaned = cleaned.select("doc_id", *ABOUT, expected.alias("expected"), F.coalesce(T.clean_lines(body), F.array().cast("array<string>")).alias("lines"))
    return cut(cleaned.withColumn("n", F.size("lines")))


def parse_documents(docs: DataFrame, configs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, problems) of documents (doc_id, text) by their configuration, which may be columns of docs.

    An explicit list of numbers overrides the one in the arrangement; no list at all,
    or a mode that is not known, is a problem of that document.  Documents of up to FOLDED_LINES lines are rows throughout; longer ones become rows of lines.
    """
    docs.sparkSession.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)  # else all lines look few enough to broadcast
    joined = docs if configs is None else docs.join(configs, "doc_id")
    read = _read(joined)
    folded = read.where(F.col("n") <= FOLDED_LINES).select("doc_id", *ABOUT, F.explode(folded_sections(F.col("lines"), F.col("expected"))).alias("x")).select("doc_id", *ABOUT, "x.*")
    long = read.where(F.col("n") > FOLDED_LINES)
    if not long.isEmpty():
        segments = segment(long.select("doc_id", F.posexplode("lines").alias("pos", "line")), long.select("doc_id", F.posexplode("expected").alias("ord", "number")))
        folded = folded.unionByName(segments.join(long.select("doc_id", *ABOUT), "doc_id").select(*folded.columns))
    unknown = joined.where("parser_mode is null or parser_mode not in ('arrangement_based', 'body_only')").select("doc_id", F.lit("unknown parser mode").alias("problem"))
    unlisted = read.where(F.size("expected") == 0).select("doc_id", F.lit("no expected sections").alias("problem"))
    return section_records(folded), unknown.unionByName(unlisted)


def missing_numbers(docs: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(doc_id, number): expected numbers that no section of ``parse_documents`` bears, without making the sections."""
    docs.sparkSession.conf.set("spark.sql.sources.fileCompressionFactor", FILE_FACTOR)  # as in parse_documents
    read = _read(docs if configs is None else docs.join(configs, "doc_id"))
    found = F.slice("expected", F.lit(1), F.size(_opened(F.col("lines"), F.col("expected"))))
    missing = T.once(found, lambda have: F.filter("expected", lambda number: ~F.array_contains(have, number)))
    folded = read.where(F.col("n") <= FOLDED_LINES).select("doc_id", F.explode(missing).alias("number"))
    long = read.where(F.col("n") > FOLDED_LINES)
    if long.isEmpty():
        return folded
    lines, expected = long.select("doc_id", F.posexplode("lines").alias("pos", "line")), long.select("doc_id", F.posexplode("expected").alias("ord", "number"))
    opened = opened_lines(headers(lines).where("number is not null").select("doc_id", "pos", "number"), expected)
    return folded.unionByName(missing_sections(expected, opened).select("doc_id", "number"))
