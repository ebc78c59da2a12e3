"""Drafts to checked answers: citations, confidence, status, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.citations import act_of, cited_ids, render_markers
from tessera.operators.calculators import rupees
from tessera.sources.tables import cut

WEIGHTS = {"concept_coverage": 0.35, "seed_strength": 0.25, "sufficiency_score": 0.20, "citation_validity": 0.20}
MIN_CONFIDENCE, CONFLICT_CAP = 0.4, 0.5
HIGH, MODERATE = 0.7, 0.4
NO_CONTENT = ("error", "rejected", "out_of_domain")
#: Its last three words are a fixed value: evaluation looks for them.
DISCLAIMER = "For information only; this is not legal advice."
#: Words that mean that no safety flag was raised.
NOT_FLAGS = ("none", "null", "nil", "false", "no", "n/a", "na", "-", "not applicable")
#: Labels of the two personas.
LAWYER_LABELS = ("lawyer", "judge", "advocate", "legal", "professional")
#: What the part of an answer that lists its sections begins with.
RESTS_ON, CHECKED = "This rests on: ", "Sections checked: "
STRUCT_ORDERED = lambda df_col: F.transform(F.sort_array(F.collect_list(df_col)), lambda x: x["v"])


def persona(c: Column) -> Column:
    """Citizen unless a lawyer's label is known."""
    return F.when(F.lower(F.trim(c)).isin(*LAWYER_LABELS), "lawyer").otherwise("citizen")


def parse_citations(drafts: DataFrame) -> DataFrame:
    """(query_id, section_id, ord) in the order first cited."""
    return drafts.select("query_id", F.posexplode(cited_ids(F.col("draft_answer"))).alias("ord", "section_id"))


def verify_citations(cited: DataFrame, retrieved: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verified, warnings): shown to the model, and there at all."""
    shown = retrieved.select("query_id", "section_id").distinct()
    stray = cited.join(shown, ["query_id", "section_id"], "left_anti").select("query_id", "ord", F.concat(F.lit("Stripped citation "), "section_id", F.lit(": not in the retrieval set.")).alias("warning"))
    inside = cited.join(shown, ["query_id", "section_id"], "left_semi")
    ids = sections.select("section_id").distinct()
    absent = inside.join(ids, "section_id", "left_anti").select("query_id", "ord", F.concat(F.lit("Stripped citation "), "section_id", F.lit(": no such section.")).alias("warning"))
    return inside.join(ids, "section_id", "left_semi").select("query_id", "section_id", "ord"), stray.unionByName(absent)


def verify_calculations(calculations: DataFrame, retrieved: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two checks for amounts, which are marked and written once."""
    shown = retrieved.select("query_id", "section_id").distinct().withColumn("__shown", F.lit(True))
    known = sections.select("section_id").distinct().withColumn("__known", F.lit(True))
    marked = calculations.join(shown, ["query_id", "section_id"], "left").join(known, "section_id", "left")
    marked = cut(marked.select(*calculations.columns, (F.col("__shown").isNotNull() & F.col("__known").isNotNull()).alias("__ok")))
    ok = marked.where("__ok").drop("__ok")
    lost = marked.where("not __ok").join(ok.select("query_id", "ord"), ["query_id", "ord"], "left_anti").select("query_id", "ord", F.concat(F.lit("Dropped calculation "), "label", F.lit(".")).alias("warning"))
    return ok, lost


def confidence(facts: DataFrame) -> DataFrame:
    """query_id with the four factors, confidence and status.

    facts: query_id, n_extracted, n_ungrounded, n_grounded, seed, sufficient (null without a verdict), n_retrieved, n_cited, n_verified, has_conflict.
    """
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    factors = {
        "concept_coverage": F.when(F.col("n_extracted") > 0, clamp((F.col("n_extracted") - F.col("n_ungrounded")) / F.when(F.col("n_extracted") > 0, F.col("n_extracted")))).when(F.col("n_grounded") > 0, 1.0).otherwise(0.0),
        "seed_strength": clamp(F.coalesce("seed", F.lit(0.0))),
        "sufficiency_score": F.when(F.col("sufficient"), 1.0).when(F.col("sufficient").isNotNull() & (F.col("n_retrieved") > 0), 0.5).otherwise(0.0),
        "citation_validity": F.when(F.col("n_cited") > 0, clamp(F.col("n_verified") / F.when(F.col("n_cited") > 0, F.col("n_cited")))).otherwise(0.0),
    }
    rounded = facts.select("query_id", "has_conflict", *[F.round(v, 4).alias(k) for k, v in factors.items()])
    total = F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4)
    capped = F.when(F.col("has_conflict"), F.least(total, F.lit(CONFLICT_CAP))).otherwise(total)
    return rounded.withColumn("confidence", capped).withColumn("status", F.when(F.col("confidence") < MIN_CONFIDENCE, "insufficient_evidence").otherwise("ok")).drop("has_conflict")


def is_unsafe(flag: Column) -> Column:
    """A reason was given, and it isn't one of the words for none."""
    word = F.lower(F.regexp_replace(F.trim(F.coalesce(flag, F.lit(""))), r"^\.+|\.+$", ""))
    return (word != "") & ~word.isin(*NOT_FLAGS)


def resolve_status(error: Column, safety_flag: Column, in_domain: Column, guardrail: Column) -> Column:
    """error, then rejected, then out_of_domain, then what the guardrail says."""
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(is_unsafe(safety_flag), "rejected").when(~F.coalesce(in_domain, F.lit(True)), "out_of_domain").otherwise(F.coalesce(guardrail, F.lit("ok")))


def confidence_band(score: Column, partial: Column) -> Column:
    return F.when((score >= HIGH) & ~partial, "high").when(score >= MODERATE, "moderate").otherwise("low")


def superseded_notes(suppressed: DataFrame, acts: DataFrame, notes: DataFrame, verified: DataFrame) -> DataFrame:
    """Notes on withheld acts whose successor is cited."""
    cited = verified.select("query_id", act_of(F.col("section_id")).alias("repealed_by")).distinct()
    return suppressed.select("query_id", "act_id").distinct().join(acts.select("act_id", "repealed_by"), "act_id").join(cited, ["query_id", "repealed_by"], "left_semi").join(notes, "act_id").select("query_id", "act_id", "repeal_note", "replacement_note")


def display_names(verified: DataFrame, sections: DataFrame) -> DataFrame:
    """verified with name: 'Section N of the Act', or the id."""
    about = sections.select("section_id", "section_number", "act_name")
    named = (F.coalesce("section_number", F.lit("")) != "") & (F.coalesce("act_name", F.lit("")) != "")
    return verified.join(about, "section_id", "left").withColumn("name", F.when(named, F.concat(F.lit("Section "), "section_number", F.lit(" of the "), "act_name")).otherwise(F.col("section_id")))


def answer_lines(verified_named: DataFrame, calculations: DataFrame, conflicts: DataFrame, notes: DataFrame, superseded: DataFrame) -> DataFrame:
    """One row for each query with the pieces that assembly puts in order."""
    v = verified_named.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("ord", F.col("section_id").alias("v"))).alias("ids"), STRUCT_ORDERED(F.struct("ord", F.col("name").alias("v"))).alias("names"))
    amount = F.when(F.col("amount").isNull(), F.concat("label", F.lit(" — not calculated: "), "note")).otherwise(F.concat("label", F.lit(": "), rupees(F.col("amount"))))
    c = calculations.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("ord", amount.alias("v"))).alias("amounts"))
    older = F.when(F.col("predecessor") != "", F.concat(F.lit(" "), "predecessor", F.lit(" came before it."))).otherwise("")
    t = conflicts.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("act_id", F.concat("act_name", F.lit(" (in force from "), "since", F.lit(")."), older).alias("v"))).alias("conflicts"))
    n = notes.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("n", F.concat("act_name", F.lit(" — "), "since").alias("v"))).alias("since"))
    s = superseded.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("act_id", F.col("repeal_note").alias("v"))).alias("repealed"), STRUCT_ORDERED(F.struct("act_id", F.col("replacement_note").alias("v"))).alias("replaced"))
    out = v
    for x in (c, t, n, s):
        out = out.join(x, "query_id", "full_outer")
    return out


def assemble_answers(states: DataFrame, lines: DataFrame, scope: str = "", warnings: DataFrame | None = None) -> DataFrame:
    """(query_id, status, final_answer, confidence, verified_section_ids, persona, warnings).

    states: query_id, draft_answer, persona, error, safety_flag, in_domain, guardrail_status, confidence,
    sufficient, missing.  Answers without content have no citations and confidence 0; the persona only changes wording.
    warnings: query_id, ord, warning, of any step; they are given in order, whatever the status.
    """
    none = F.array().cast("array<string>")
    if warnings is not None:
        states = states.join(warnings.groupBy("query_id").agg(STRUCT_ORDERED(F.struct("ord", F.col("warning").alias("v"))).alias("said")), "query_id", "left")
    else:
        states = states.withColumn("said", none)
    has = lambda c: F.size(F.coalesce(c, none)) > 0
    row = states.join(lines, "query_id", "left").withColumns({"persona": persona(F.col("persona")), "status": resolve_status(F.col("error"), F.col("safety_flag"), F.col("in_domain"), F.col("guardrail_status"))})
    lawyer = F.col("persona") == "lawyer"
    ids, partial = F.coalesce("ids", none), F.col("status") == "insufficient_evidence"
    body = render_markers(F.coalesce("draft_answer", F.lit("")), ids, ~lawyer)
    gap = F.when(F.coalesce("missing", F.lit("")) != "", F.concat(F.lit(" Not covered: "), "missing", F.lit("."))).otherwise("")
    weak = partial | ~F.coalesce("sufficient", F.lit(True))
    when = lambda cond, *cols: F.when(cond, F.concat(*cols))
    pieces = F.array(
        when(has("conflicts"), F.when(lawyer, "Date check: the event is dated before commencement. ").otherwise("Please note first that the law came later than what you describe. "), F.array_join("conflicts", " "), F.lit("\n")),
        when(partial, F.when(lawyer, "Evidence incomplete: some of the query has no section behind it.").otherwise("Some of your question is left open by the sections found."), gap, F.lit("\n")),
        F.when(body == "", "There is no draft for this query, so nothing is cited.").otherwise(body),
        when(has("amounts"), F.when(lawyer, "\nAmounts by rule:\n").otherwise("\nWhat the rules come to:\n"), F.array_join("amounts", "\n\n")),
        F.concat(F.lit("\n"), F.when(lawyer, F.concat(F.lit(CHECKED), F.when(has("ids"), F.array_join(ids, ", ")).otherwise("none"))).otherwise(F.when(has("ids"), F.concat(F.lit(RESTS_ON), F.array_join("names", "; "))).otherwise("None of the cited sections passed the checks."))),
        when(has("since"), F.when(lawyer, "Commencement: ").otherwise("These laws began on: "), F.array_join("since", "; "), F.lit(".")),
        when(has("replaced"), F.when(lawyer, F.concat(F.lit("Left out, repealed: "), F.array_join("repealed", " "))).otherwise(F.concat(F.lit("Older law you may come across: "), F.array_join("replaced", " ")))),
        F.when(lawyer, F.concat(F.lit("Score: "), F.format_number("confidence", 2))).otherwise(F.concat(F.lit("Certainty: "), confidence_band(F.col("confidence"), weak), F.lit("."))),
        F.concat(F.lit("\n"), F.lit(DISCLAIMER)),
    )
    fixed = (
        F.when(F.col("status") == "error", F.concat(F.lit("Processing failed.\n\nCause: "), F.coalesce("error", F.lit(""))))
        .when(F.col("status") == "rejected", "No answer is given to this request.")
        .when(F.col("status") == "out_of_domain", F.concat(F.lit("The question is about something else than the laws held here.\n\n"), F.lit(scope)))
    )
    empty = F.col("status").isin(*NO_CONTENT)
    return row.select(
        "query_id", "status", F.when(empty, fixed).otherwise(F.array_join(F.filter(pieces, lambda x: x.isNotNull()), "\n")).alias("final_answer"), F.when(empty, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(empty, none).otherwise(ids).alias("verified_section_ids"), "persona",
        F.coalesce("said", none).alias("warnings"),
    )


def first_cited(verified: DataFrame) -> DataFrame:
    """verified with act_id and the order in which acts are cited first."""
    own = verified.withColumn("act_id", act_of(F.col("section_id")))
    return own.withColumn("act_ord", F.min("ord").over(Window.partitionBy("query_id", "act_id")))
