"""Bounded walks over citations, one for each query and concept.

Only keys travel: texts are joined at ranking.  Queries that ask for the same walk share it.  Each hop is a join of the frontier
with the edges (both directions), an anti-join with what was seen, and the filter for
validity, so suppressed sections are neither returned nor walked through.  A hop is
written to the shared folder; the driver sees only whether it is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph_reads import few
from tessera.operators.temporal import is_suppressed
from tessera.sources.tables import cut

WALK = ["query_id", "concept"]
MAX_HOPS, MAX_HOPS_CAP, MAX_PASSES = 2, 4, 2
PER_CONCEPT = 40


def shared_walks(asked: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """(asked by walk, members): queries that ask the same concept from the same place walk once.

    What a walk finds follows from its concept and from the jurisdiction that was named, so asked gets these two as its
    ``query_id``; members (walk, query_id, concept) tell whose walk it is, see ``by_query``.  Queries that differ in a column of ``also`` don't share.
    """
    walk = F.to_json(F.struct("concept", "query_jurisdiction", *also))
    members = asked.select(walk.alias("walk"), "query_id", "concept").distinct()
    return asked.withColumn("query_id", walk).distinct(), members


def by_query(found: DataFrame, members: DataFrame) -> DataFrame:
    """What a walk found, for each of the queries that share it."""
    return found.withColumnRenamed("query_id", "walk").join(members, ["walk", "concept"]).select(*found.columns)


def find_anchors(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, suppressed) of rows query_id, concept, section_id, relevance, act_id, section_number, jurisdiction, in_force_status, query_jurisdiction.

    Only an edge that says supporting is supporting; everything else is primary.
    """
    gone = is_suppressed(F.col("in_force_status"), F.col("jurisdiction"), F.col("query_jurisdiction"))
    kept = asked.where(~gone).withColumn("relevance", F.when(F.lower(F.coalesce("relevance", F.lit(""))) == "supporting", "supporting").otherwise("primary"))
    return kept, asked.where(gone)


def seed_confidence(anchors: DataFrame) -> DataFrame:
    """(query_id, concept, confidence): 1 with a primary anchor, 0.6 with supporting ones only."""
    return anchors.groupBy(*WALK).agg(F.max(F.when(F.col("relevance") == "primary", 1.0).otherwise(0.6)).alias("confidence"))


def symmetric_edges(cites: DataFrame) -> DataFrame:
    """(src, dst), distinct, either way: dealt by dst, where equal ones meet and whoever looks up their ends joins."""
    pairs = cites.select(F.col("source_section_id").alias("src"), F.col("target_section_id").alias("dst"))
    return pairs.union(pairs.select("dst", "src")).where("src != dst").repartition("dst").distinct()


def _ways(cites: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, and of dst: jurisdiction, in_force_status) of all edges, either way, that end in a section."""
    return symmetric_edges(cites).join(nodes.select(F.col("section_id").alias("dst"), "jurisdiction", "in_force_status"), "dst")


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(walks with a number w, rows by w): a number travels instead of names."""
    names = [*WALK, "query_jurisdiction"]
    walks = cut(rows.select(*names).distinct().withColumn("w", F.monotonically_increasing_id()))
    same = [rows[c].eqNullSafe(walks[c]) for c in names]
    return walks, cut(rows.join(few(walks), same).select("w", "section_id", "hop"))


def _reached(frontier: DataFrame, seen: DataFrame, walks: DataFrame, ways: DataFrame, hop: int, whole: bool) -> DataFrame:
    """(w, section_id, gone), distinct: what lies one edge beyond the frontier and wasn't seen; gone, of which there is none if not whole, is what isn't valid for the walk.

    What was seen, at lesser hops, goes along with what is found, dealt by walk: there each section keeps its least hop.
    """
    ahead = frontier.select("w", F.col("section_id").alias("src")).join(few(walks.select("w", "query_jurisdiction")), "w").join(ways, "src")
    gone = is_suppressed(F.col("in_force_status"), F.col("jurisdiction"), F.col("query_jurisdiction"))
    ahead = ahead.select("w", F.col("dst").alias("section_id"), gone.alias("gone"), F.lit(hop).alias("hop"))
    every = (ahead if whole else ahead.where("not gone")).unionByName(seen.select("w", "section_id", F.lit(False).alias("gone"), "hop"))
    return every.repartition("w").groupBy("w", "section_id").agg(F.min("hop").alias("hop"), F.max("gone").alias("gone")).where(F.col("hop") == hop).drop("hop")


def _without(frontier: DataFrame, done: DataFrame) -> DataFrame:
    return cut(frontier.join(done.select("w"), "w", "left_anti"))


def expand(seeds: DataFrame, cites: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS, start: DataFrame | None = None, first_hop: int = 1, enough: tuple[DataFrame, int] | None = None, whole: bool = True, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, suppressed): sections by the hop that reached them first.

    seeds: query_id, concept, section_id, query_jurisdiction.  nodes: section_id, act_id,
    jurisdiction, in_force_status.  ``start`` (rows of found) resumes at first_hop.  ``enough`` (anchors, n): a walk that has
    n sections, anchors included, after a hop goes no further.  If not whole, nothing is told of what is suppressed, and the last
    hop is left to whoever reads it, once.  With ``members`` (of ``shared_walks``) found has a row for each of the queries that share a walk.
    """
    key = [*WALK, "section_id"]
    given = seeds.select(*key, "query_jurisdiction", F.lit(0).alias("hop")).distinct()
    walks, seen = _numbered(given if start is None else start.select(*key, "query_jurisdiction", "hop").unionByName(given))
    have = _of_walks(enough[0], walks) if enough else None
    ways, frontier = None, seen.where(F.col("hop") == first_hop - 1)
    hops, dropped = [], []
    for hop in range(first_hop, max_hops + 1):
        if have is not None:
            frontier = _without(frontier, have.groupBy("w").agg(F.count_distinct("section_id").alias("n")).where(F.col("n") >= enough[1]))
        if frontier.isEmpty():
            break
        ways = ways if ways is not None else cut(_ways(cites, nodes))
        new = _reached(frontier, seen, walks, ways, hop, whole)
        new = cut(new) if whole or hop < max_hops else new
        frontier = new.where("not gone").select("w", "section_id", F.lit(hop).alias("hop"))
        hops.append(frontier)
        if whole:
            dropped.append(new.where("gone").select("w", "section_id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
        have = have.unionByName(frontier.select("w", "section_id")) if have is not None else None
    found = suppressed = seen.where("false")
    for x in hops:
        found = found.unionByName(x)
    for x in dropped:
        suppressed = suppressed.unionByName(x)
    named = few(walks)
    acts = nodes.select("section_id", "act_id")
    if members is not None:
        named = cut(walks.withColumnRenamed("query_id", "walk").join(members, ["walk", "concept"]).drop("walk"))
        named = few(named, "shuffle_hash")
        return found.join(named, "w").select(*key, "query_jurisdiction", "hop"), suppressed
    return found.join(named, "w").select(*key, "query_jurisdiction", "hop"), suppressed.distinct().join(named, "w").join(acts, "section_id").select(*key, "act_id", "query_jurisdiction", "hop")


def _of_walks(rows: DataFrame, walks: DataFrame) -> DataFrame:
    """(w, section_id) of rows by name."""
    return cut(rows.join(few(walks), [rows[c].eqNullSafe(walks[c]) for c in [*WALK, "query_jurisdiction"]]).select("w", "section_id"))


def depths(asked: DataFrame, cites: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS, members: DataFrame | None = None) -> DataFrame:
    """(query_id, concept, hops_taken) as of ``traverse`` (also what ``members`` is), without the sections of the last hop.

    For the last hop one new section is enough, so a walk tries a few ends of its frontier, then four times as many, until one leads to something new.
    """
    asked, members = (asked, members) if members is not None else shared_walks(asked)
    members = cut(members)
    seeds = find_anchors(asked)[0].where("relevance = 'primary'").select(*WALK, "section_id", "query_jurisdiction")
    seeds = cut(seeds)
    found = cut(expand(seeds, cites, nodes, max_hops - 1, whole=False)[0])
    walks, seen = _numbered(found.unionByName(seeds.select(*WALK, "section_id", "query_jurisdiction", F.lit(0).alias("hop")).distinct()))
    ends = seen.where(F.col("hop") == max_hops - 1).withColumn("place", F.row_number().over(Window.partitionBy("w").orderBy("section_id")))
    ends, ways, deeper, n = cut(ends), None, [], 4
    while not ends.isEmpty():
        ways = ways if ways is not None else cut(_ways(cites, nodes))
        now = ends.where(F.col("place") <= n)
        on = cut(_reached(now, seen.join(now.select("w").distinct(), "w", "left_semi"), walks, ways, max_hops, False).select("w").distinct())
        deeper.append(on)
        ends, n = _without(ends.where(F.col("place") > n), on), n * 4
    taken = found.select(*WALK, "hop")
    for on in deeper:
        taken = taken.unionByName(on.join(few(walks), "w").select(*WALK, F.lit(max_hops).alias("hop")))
    return by_query(hops_taken(taken), members)


def hops_taken(found: DataFrame) -> DataFrame:
    return found.groupBy(*WALK).agg(F.max("hop").alias("hops_taken"))


def walked_sections(anchors: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors (hop 0, primaries first) then what was found; a section counts where it is seen first."""
    about = nodes.select("section_id", "act_id", "section_number")
    first = anchors.select(*WALK, "section_id", F.lit(0).alias("hop"), F.when(F.col("relevance") == "primary", 0).otherwise(1).alias("part"))
    rest = found.select(*WALK, "section_id", "hop", F.lit(2).alias("part"))
    order = Window.partitionBy(*WALK, "section_id").orderBy("part", "hop")
    return first.unionByName(rest).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n").join(about, "section_id")


def cap_sections(walked: DataFrame, n: int = PER_CONCEPT) -> DataFrame:
    """At most n for each walk: anchors first, the rest by hop, act and number (as text)."""
    order = Window.partitionBy(*WALK).orderBy(F.col("part") == 2, F.when(F.col("part") < 2, F.col("part")), F.when(F.col("part") == 2, F.col("hop")), "act_id", "section_number", "section_id")
    return walked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def filter_edges(kept: DataFrame, cites: DataFrame) -> DataFrame:
    """Citations with both ends among the kept sections of one walk, which are few: each of them takes all to its citations.

    Only what is found is made distinct, not all citations before.
    """
    own = kept.groupBy(*WALK).agg(F.collect_list("section_id").alias("own"))
    src = own.select(*WALK, "own", F.explode("own").alias("source_section_id"))
    met = src.join(cites.select("source_section_id", "target_section_id"), "source_section_id")
    return met.where(F.array_contains("own", F.col("target_section_id"))).drop("own").distinct()


def traverse(asked: DataFrame, cites: DataFrame, nodes: DataFrame, max_hops: int = MAX_HOPS, max_sections: int = PER_CONCEPT, whole: bool = True, members: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole walk: kept sections, edges, confidence, hops taken and what was withheld.

    Walks are shared between queries, capped, and only then dealt to them.  Nearer sections come first under the cap, so
    where only sections, edges and confidence are asked (not whole), a walk ends as soon as the cap is full.  Given ``members``,
    asked is that of ``shared_walks`` already: cheaper where walks are shared before their sections are looked up.
    """
    asked, members = (asked, members) if members is not None else shared_walks(asked)
    members = cut(members)
    anchors, withheld = find_anchors(asked)
    anchors = cut(anchors)
    seeds = anchors.where("relevance = 'primary'").select(*WALK, "section_id", "query_jurisdiction")
    found, dropped = expand(seeds, cites, nodes, max_hops, enough=None if whole else (anchors, max_sections), whole=whole)
    kept = cut(cap_sections(walked_sections(anchors, found, nodes), max_sections))
    out = {"sections": kept, "edges": filter_edges(kept, cites), "confidence": seed_confidence(anchors)}
    if whole:
        out["hops"] = hops_taken(found)
        out["suppressed"] = withheld.select(*WALK, "section_id", "act_id", F.lit(0).alias("hop")).unionByName(dropped.select(*WALK, "section_id", "act_id", "hop"))
    return {k: by_query(v, members) for k, v in out.items()}


def needs_expansion(state: DataFrame) -> DataFrame:
    """Queries (query_id, sufficient, iteration, max_hops, n_sections) to walk one hop further."""
    return state.where((~F.coalesce("sufficient", F.lit(False))) & (F.col("iteration") < MAX_PASSES) & (F.col("n_sections") > 0)).select("query_id", (F.col("iteration") + 1).alias("iteration"), F.least(F.col("max_hops") + 1, F.lit(MAX_HOPS_CAP)).alias("max_hops"))


def deepen(state: DataFrame, seeds: DataFrame, found: DataFrame, cites: DataFrame, nodes: DataFrame, max_hops: int, members: DataFrame | None = None) -> DataFrame:
    """found, with one more hop for the queries that need it, from where they stopped; with ``members``, for each of the queries that share a walk."""
    again = needs_expansion(state).select("query_id")
    more, _ = expand(seeds.join(again, "query_id", "left_semi"), cites, nodes, max_hops + 1, start=found.join(again, "query_id", "left_semi"), first_hop=max_hops + 1, whole=False, members=members)
    return (found if members is None else by_query(found, members)).unionByName(more)
