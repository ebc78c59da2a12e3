"""Plain phrases to concepts of the vocabulary, for tables of phrases.

Stage 1: a name or alias stands in the phrase.  Stage 2: shared stems.  Stage 3, only
where both find nothing: close spelling of a word n-gram.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph_reads import few, join_contained, small, tasks
from tessera.sources.tables import cut

MAX_DF, MIN_SHARE, MAX_OVERLAP = 2, 0.5, 3
FUZZY_RATIO, FUZZY_TERMS = 0.8, 2
#: Letters by which texts of close spelling meet.
TOGETHER = 3
#: Texts of a task that cuts them into tokens.
TASK_TEXTS = 20_000
#: Terms that share a token, beyond which pairs don't meet at it.
COMMON_TERMS = 64


def terms_of(concepts: DataFrame) -> DataFrame:
    """(name, ord, term_ord, term) in lower case: the name, then its aliases."""
    return concepts.select("name", "ord", F.posexplode(F.concat(F.array("name"), "aliases")).alias("term_ord", "t")).select("name", "ord", "term_ord", F.lower("t").alias("term"))


def normalize(phrases: DataFrame) -> DataFrame:
    """phrases (phrase_id, phrase) squeezed and lowered; empty ones ground to nothing."""
    return phrases.withColumn("phrase", T.squeeze(F.lower("phrase"))).where("phrase != ''")


def ground_substring(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, name, ord)."""
    return join_contained(phrases, "phrase", terms.where("term != ''"), "term").select("phrase_id", "name", "ord").distinct()


def build_vocabulary(concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term tokens, name token counts, document frequency counted by concept)."""
    terms = terms_of(concepts).withColumn("tokens", T.content_tokens(F.col("term"))).where(F.size("tokens") > 0)
    exploded = terms.select("name", "ord", "term_ord", F.size("tokens").alias("n_term"), F.explode("tokens").alias("token"))
    names = concepts.select("name", T.content_tokens(F.col("name")).alias("name_tokens"))
    df = exploded.groupBy("token").agg(F.count_distinct("name").alias("df"))
    return exploded, names, df


def _scored(shared: DataFrame, *keys: str) -> DataFrame:
    """keys and score of rows keys, n_phrase, n_term, sole, token, df, one for each token that a pair shares.

    One shared token counts if it is the whole name (sole) or rare; one of them has four letters or more.
    """
    pairs = shared.groupBy(*keys, "n_phrase", "n_term", "sole").agg(F.count("*").alias("k"), F.max(F.length("token")).alias("longest"), F.min("df").alias("df"), F.min("token").alias("one"))
    ok = (F.col("longest") >= 4) & ((F.col("k") > 1) | (F.col("sole") == F.col("one")) | (F.col("df") <= MAX_DF))
    return pairs.where(ok).withColumn("score", F.greatest(F.col("k") / F.col("n_phrase"), F.col("k") / F.col("n_term"))).where(F.col("score") >= MIN_SHARE).select(*keys, "score")


def _best(scored: DataFrame, key: str) -> DataFrame:
    """(key, name, ord, score, n): the best MAX_OVERLAP concepts of each key."""
    top = Window.partitionBy(key).orderBy(F.desc("score"), "ord")
    return scored.groupBy(key, "name", "ord").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= MAX_OVERLAP)


def _kinds(tokens: DataFrame, row: list[str], kind: list[str], number: str) -> tuple[DataFrame, DataFrame]:
    """(kinds: number, kind, words; rows: row, number): rows of the same tokens and kind, numbered."""
    rows = cut(tokens.groupBy(*row, *kind).agg(F.sort_array(F.collect_list("token")).alias("words")))
    kinds = cut(rows.select("words", *kind).distinct().withColumn(number, F.monotonically_increasing_id()))
    return kinds, rows.join(few(kinds), ["words", *kind]).select(*row, number)


def ground_overlap(phrases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(phrase_id, name, ord, score, n): the best MAX_OVERLAP concepts of each phrase.

    Pairs that share a token of few terms meet there.  What shares only common tokens scores by these alone, so phrases and
    terms of the same common tokens meet once, and of such terms only the first MAX_OVERLAP concepts can be among the
    best: whatever else they share adds to their score and never takes from it.
    """
    exploded, names, df = build_vocabulary(concepts)
    sole = names.select("name", F.when(F.size("name_tokens") == 1, F.col("name_tokens")[0]).otherwise("").alias("sole")).distinct()
    uses = exploded.groupBy("token").agg((F.count("*") > COMMON_TERMS).alias("common"))
    terms = cut(exploded.join(df, "token").join(uses, "token").join(sole, "name"))
    known = cut(terms.select("token", "df", "common").distinct())
    texts = cut(phrases.select("phrase").distinct().withColumn("said", F.monotonically_increasing_id()))
    own = texts.repartition(tasks(texts, TASK_TEXTS)).select("said", T.content_tokens(F.col("phrase")).alias("tokens")).where(F.size("tokens") > 0)
    own = cut(own.select("said", F.size("tokens").alias("n_phrase"), F.explode("tokens").alias("token")).join(few(known), "token"))

    term = ["name", "ord", "term_ord"]
    rare = own.where("not common").select("said", "n_phrase", "token").join(terms.where("not common").select(*term, "token"), "token").select("said", "n_phrase", *term).distinct()
    shared = cut(rare).join(own.select("said", "token", "df").hint("merge"), "said").join(terms.select(*term, "token", "n_term", "sole").hint("merge"), [*term, "token"])
    near = _scored(shared, "said", *term).select("said", "name", "ord", "score")

    phrase_kinds, phrases_by = _kinds(own.where("common"), ["said"], ["n_phrase"], "p")
    term_kinds, terms_by = _kinds(terms.where("common"), term, ["n_term", "sole"], "t")
    first = Window.partitionBy("t").orderBy("ord", "name")
    firsts = terms_by.select("t", "name", "ord").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= MAX_OVERLAP).drop("n")
    each = lambda kinds: kinds.withColumn("token", F.explode("words")).drop("words")
    met = _scored(each(phrase_kinds).join(each(term_kinds).join(known.select("token", "df"), "token"), "token"), "p", "t")
    wide = cut(_best(met.join(cut(firsts), "t"), "p").drop("n"))
    both = near.unionByName(phrases_by.join(few(wide), "p").select("said", "name", "ord", "score"))
    best = cut(_best(both, "said"))
    return phrases.join(texts, "phrase").select("phrase_id", "said").join(few(best), "said").drop("said")


def _letters(text: Column) -> Column:
    """Each letter of a text with the number of times it has come before: what two texts can share, as a set."""
    each = F.split(text, "")
    # sorted, so that equal letters stand together; a letter's place among them is its place less the first such place
    together = F.array_sort(F.filter(each, lambda x: x != ""))
    return F.transform(together, lambda x, i: F.concat(x, (i - F.array_position(together, x) + 1).cast("string")))


def _choices(items: Column, n: Column) -> Column:
    """Hashes of all n items, one to TOGETHER, of an array, in its order."""
    out = F.transform(items, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("i")))
    longer = lambda out: F.flatten(F.transform(out, lambda c: F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda j: F.struct(F.xxhash64(c["h"], F.try_element_at(items, j + 1)).alias("h"), F.when(j > c["i"], j).alias("i")))))
    ways = [out]
    while len(ways) < TOGETHER:
        ways.append(F.filter(longer(ways[-1]), lambda c: c["i"].isNotNull()))
    chosen = ways[-1]
    for k in range(TOGETHER - 1, 0, -1):
        chosen = F.when(n == k, ways[k - 1]).otherwise(chosen)
    return F.array_distinct(F.transform(chosen, lambda c: c["h"]))


def close_pairs(left: DataFrame, right: DataFrame, ratio: float = FUZZY_RATIO) -> DataFrame:
    """(gram, term, r) of texts in left.gram and right.term whose matching ratio is ``ratio`` or more.

    The ratio is twice the letters matched in order over both lengths, so at least ratio / 2 of all letters are shared.
    Letters are numbered by occurrence and ordered by rarity.  Two texts of n and m letters that share so many also share
    TOGETHER of the first few of each; these, with both lengths, are the join's key.  Shared letters are compared before the ratio itself; no pair that has it is lost.
    """
    part = ratio / 2
    texts = left.select("gram").distinct().select(F.col("gram").alias("t"), F.lit(0).alias("side")).unionByName(right.select("term").distinct().select(F.col("term").alias("t"), F.lit(1).alias("side")))
    texts = cut(texts.where("t != ''").withColumns({"letters": _letters(F.col("t")), "len": F.length("t")}))
    each = texts.select("t", "side", F.explode("letters").alias("letter"))
    seen = each.groupBy("letter").agg(F.count("*").alias("n"))
    ranked = each.join(few(seen), "letter").groupBy("t", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "letter"))), lambda x: x["letter"]).alias("ranked"))
    ranked = cut(ranked.withColumn("len", F.size("ranked")))
    lengths = [ranked.where(F.col("side") == side).select(F.col("len").alias(name)).distinct() for side, name in ((0, "n"), (1, "m"))]
    lengths = lengths[0].crossJoin(lengths[1]).withColumn("need", F.ceil((F.col("n") + F.col("m")) * part - 1e-9).cast("int")).where(F.col("need") <= F.least("n", "m"))
    lengths = cut(lengths)

    def keyed(side: int, name: str, own: str) -> DataFrame:
        some = F.least(F.lit(TOGETHER), F.col("need"))
        firsts = F.slice("ranked", F.lit(1), F.col("len") - F.col("need") + some)
        rows = ranked.where(F.col("side") == side).join(few(lengths), F.col("len") == F.col(own))
        return rows.select(F.col("t").alias(name), "n", "m", "need", F.explode(_choices(firsts, some)).alias("key"))

    met = keyed(0, "gram", "n").join(keyed(1, "term", "m").drop("need").hint("merge"), ["n", "m", "key"]).select("gram", "term", "need").distinct()
    own = lambda side, name: texts.where(F.col("side") == side).select(F.col("t").alias(name), F.col("letters").alias(f"{name}_letters"))
    met = met.join(few(own(0, "gram")), "gram").join(few(own(1, "term")), "term").where(F.size(F.array_intersect("gram_letters", "term_letters")) >= F.col("need"))

    @F.pandas_udf("double")
    def matched(term: pd.Series, gram: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, t, g).ratio() for t, g in zip(term, gram, strict=True)])

    return met.select("gram", "term", matched("term", "gram").alias("r")).where(F.col("r") >= ratio)


def ground_fuzzy(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, name, n) from the first n-gram, longest first, with a term of ratio FUZZY_RATIO or more.

    Distinct n-grams meet distinct terms in ``close_pairs``.  Of equal texts the last concept counts.
    """
    last = terms.groupBy("term").agg(F.max_by("name", F.struct("ord", "term_ord")).alias("name"))
    grams = cut(phrases.select("phrase_id", F.posexplode(T.word_ngrams(F.col("phrase"))).alias("g", "gram")))
    close = grams.join(cut(close_pairs(grams, last)), "gram")
    first = close.withColumn("first", F.min("g").over(Window.partitionBy("phrase_id"))).where("g = first")
    order = Window.partitionBy("phrase_id").orderBy(F.desc("r"), F.desc("term"))
    top = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FUZZY_TERMS).join(last, "term")
    return top.groupBy("phrase_id", "name").agg(F.min("n").alias("n"))


def ground(phrases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(phrase_id, name, ord): stage 1 in the order of concepts, then stage 2 by score, else stage 3.

    Equal phrases are grounded once, by number, and their names dealt to the rows at the end.
    """
    concepts = cut(concepts.select("name", "ord", "aliases"))
    phrases, terms = normalize(phrases), terms_of(concepts)
    texts = cut(phrases.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    one = ground_substring(texts, terms).select("phrase_id", "name", F.lit(1).alias("stage"), F.col("ord").cast("bigint").alias("at"))
    two = ground_overlap(texts, concepts).select("phrase_id", "name", F.lit(2).alias("stage"), F.col("n").cast("bigint").alias("at"))
    found = cut(one.unionByName(two))
    three = ground_fuzzy(texts.join(found.select("phrase_id").distinct().hint("merge"), "phrase_id", "left_anti"), terms)
    every = found.unionByName(three.select("phrase_id", "name", F.lit(3).alias("stage"), F.col("n").cast("bigint").alias("at")))
    first = every.groupBy("phrase_id", "name").agg(F.min(F.struct("stage", "at")).alias("o"))
    names = first.select(F.col("phrase_id").alias("__said"), "name", F.row_number().over(Window.partitionBy("phrase_id").orderBy("o")).alias("ord"))
    return phrases.join(few(texts.withColumnRenamed("phrase_id", "__said")), "phrase").join(names.hint("merge"), "__said").select("phrase_id", "name", "ord")


def ground_queries(queries: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grounded, ungrounded, warnings) of queries (query_id, raw_query, legal_concepts).

    The extracted phrases, or the raw query if there are none, then the raw query;
    what only the raw query grounds doesn't make a phrase grounded.
    """
    queries = cut(queries.select("query_id", "raw_query", "legal_concepts"))
    some = F.size(F.coalesce("legal_concepts", F.array().cast("array<string>"))) > 0
    said = queries.select("query_id", F.posexplode(F.when(some, F.col("legal_concepts")).otherwise(F.array("raw_query"))).alias("i", "phrase"))
    raw = queries.select("query_id", F.lit(1 << 20).alias("i"), F.col("raw_query").alias("phrase"))
    each = said.unionByName(raw).withColumn("phrase_id", F.struct("query_id", "i"))
    names = cut(ground(each.select("phrase_id", "phrase"), concepts))
    first = names.groupBy(F.col("phrase_id.query_id").alias("query_id"), "name").agg(F.min(F.struct("phrase_id.i", "ord")).alias("o"))
    grounded = cut(first.select("query_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("ord")))
    ungrounded = each.where(F.col("i") < (1 << 20)).join(names.select("phrase_id").distinct(), "phrase_id", "left_anti").where(T.squeeze(F.col("phrase")) != "").select("query_id", "i", "phrase")
    none = queries.select("query_id").join(grounded.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("no concept matched").alias("warning"))
    part = ungrounded.join(grounded.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "phrase"))), lambda x: x["phrase"]), ", ").alias("p"))
    return grounded, ungrounded, none.unionByName(part.select("query_id", F.concat(F.lit("no concept matched for: "), "p").alias("warning")))


def unknown_companions(companions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Names in the adjacency that are no concept."""
    named = companions.select(F.col("trigger_name").alias("name")).union(companions.select("companion_name")).distinct()
    return named.join(concepts.select("name"), "name", "left_anti")


def companions_for(grounded: DataFrame, companions: DataFrame) -> DataFrame:
    """(query_id, name, ord): companions of grounded concepts that aren't grounded, first seen first."""
    found = grounded.join(small(companions), F.col("name") == F.col("trigger_name")).select("query_id", F.col("companion_name").alias("name"), F.struct(F.col("ord").alias("g"), F.col("companion_ord").alias("c")).alias("o"))
    fresh = found.groupBy("query_id", "name").agg(F.min("o").alias("o")).join(grounded.select("query_id", "name"), ["query_id", "name"], "left_anti")
    return fresh.select("query_id", "name", F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("ord"))


def relevance_for(grounded: DataFrame, companions: DataFrame, concepts: DataFrame, applies_to: DataFrame) -> DataFrame:
    """(query_id, section_id, relevance): primary wins; what only companions reach is supporting.

    Sections are dealt by query before they are grouped, so a task that joins a concept of very many queries only passes rows on.
    """
    ids = concepts.select("concept_id", "name")
    rank = F.when(F.col("relevance") == "primary", 1).otherwise(0)
    own = grounded.join(ids, "name").join(applies_to, "concept_id").select("query_id", "section_id", rank.alias("r"))
    by = companions.join(ids, "name").join(applies_to, "concept_id").select("query_id", "section_id", F.lit(0).alias("r"))
    every = own.unionByName(by)
    return every.repartition(tasks(every), "query_id").groupBy("query_id", "section_id").agg(F.when(F.max("r") == 1, "primary").otherwise("supporting").alias("relevance"))

