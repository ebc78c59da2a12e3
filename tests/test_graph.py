import json
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import answers, calculators, evaluation, graph_build, graph_reads, grounding, ontology, ranking, references, segmentation, temporal, traversal
from tessera.sources import readers, snapshots


def df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(frame, *cols):
    return sorted(tuple(r[c] for c in cols) for r in frame.collect())


def test_segmentation_pointer_never_skips(spark):
    text = "THE ACT\n1. One\n2. Two\n3. Three\nTHE ACT\n1. One.—first text\n12\n3. Three.—lost in one\nSubs. by Act 9\n2. Two.—second\nSTATE AMENDMENT\nhidden\nCHAPTER II\n3. Three.—third"
    docs = df(spark, "doc_id string, text string", [("d", text), ("e", "no sections"), ("f", "THE ACT\n1. X.—y")])
    cfg = "doc_id string, act_id string, act_name string, year int, jurisdiction string, short_name string, source_file string, parser_mode string, start_marker string, fallback_start_marker string, stop_markers array<string>, expected_sections array<string>"
    configs = df(spark, cfg, [("d", "A", "Act", 2000, "Central", "A", "f", "arrangement_based", "THE ACT", None, [], []), ("e", "B", "B", 1, "Central", "B", "f", "arrangement_based", "THE ACT", None, [], []), ("f", "C", "C", 1, "Central", "C", "f", "body_only", "the act", None, [], ["1"])])
    sections, problems = segmentation.parse_documents(docs, configs)
    assert rows(sections, "section_id", "section_title", "section_text") == [
        ("A_S1", "One", "first text 3. Three.—lost in one"), ("A_S2", "Two", "second"), ("A_S3", "Three", "third"), ("C_S1", "X", "y"),
    ]
    assert rows(problems, "doc_id", "problem") == [("e", "no expected sections")]
    # without a header for 2, it and all later ones are lost in 1
    lines = segmentation.document_lines(df(spark, "doc_id string, body string", [("d", "1. One.—a\n3. Three.—b")]), "body")
    expected = df(spark, "doc_id string, ord int, number string", [("d", 0, "1"), ("d", 1, "2"), ("d", 2, "3")])
    found = segmentation.segment(lines, expected)
    assert rows(found, "number", "buffer") == [("1", "One.—a 3. Three.—b")]
    assert rows(segmentation.missing_sections(expected, found), "number") == [("2",), ("3",)]


def test_opened_lines_against_a_walk(spark):
    rng = random.Random(8)
    docs = {d: ([str(rng.randint(1, 12)) for _ in range(rng.randint(0, 60))], [str(i) for i in range(1, rng.randint(1, 14))]) for d in range(40)}
    docs[99] = ([str(i) for i in range(1, 700)], [str(i) for i in range(1, 650)])
    docs[98] = (["1", "2", "2", "1"], ["2", "1", "2"])  # an explicit list may repeat a number
    lines = df(spark, "doc_id int, pos int, number string", [(d, i, x) for d, (own, _) in docs.items() for i, x in enumerate(own)])
    expected = df(spark, "doc_id int, ord int, number string", [(d, i, x) for d, (_, want) in docs.items() for i, x in enumerate(want)])
    want = []
    for d, (own, numbers) in docs.items():
        at = 0
        for i, x in enumerate(own):
            if at < len(numbers) and x == numbers[at]:
                want.append((d, i, x, at))
                at += 1
    assert rows(segmentation.opened_lines(lines, expected), "doc_id", "pos", "number", "ord") == sorted(want)


def test_references_of_long_texts(spark):
    rng = random.Random(3)
    part = lambda: rng.choice([f"Subject to section {rng.randint(1, 99)} of this Act, ", f"sections {rng.randint(1, 9)} to {rng.randint(1, 9)}A  x ", f"sub-section (2) of section {rng.randint(1, 50)} é ", "words and more words. " * rng.randint(1, 30)])
    texts = ["", None, "section 5", *["".join(part() for _ in range(n)) for n in (40, 300, 4000)], "section " + " " * 9000 + "7 end"]
    got = references.reference_candidates(df(spark, "ord int, section_text string", list(enumerate(texts))))
    flat = lambda x: " ".join(x.split())
    want = []
    for i, t in enumerate(texts):
        for kind, (pattern, groups) in enumerate(((references.SECTION_REF, 2), (references.SUBSECTION_REF, 1))):
            for k, m in enumerate(re.finditer(pattern, t or "")):
                want += [(i, (kind * 1_000_000_000 + k) * 2 + j, m.start(), m.end(), m[j + 1], flat(t[max(0, m.start() - 140) : m.end() + 140]), flat(t[m.end() : m.end() + 160])) for j in range(groups) if m[j + 1]]
    assert rows(got, "ord", "cand_ord", "start", "end", "raw_no", "near", "following") == sorted(want)


def test_references(spark):
    schema = "section_id string, act_id string, act_name string, short_name string, section_number string, section_text string, ord int"
    texts = [
        ("A_S1", "A", "Wage Code", "WC", "1", "subject to section 2 and sections 3 to 5; section 1 too; sub-section (1) of section 3", 0),
        ("A_S2", "A", "Wage Code", "WC", "2", "under section 3 of the Companies Act, 1956", 1),
        ("A_S3", "A", "Wage Code", "WC", "3", "under section 1 of this Act", 2),
        ("A_S4", "A", "Wage Code", "IRC", "4", "in circumstances under section 1 of this Act", 3),
        ("A_S5", "A", "Wage Code", "WC", "5", "Section 2 applies.", 4),
    ]
    got = references.extract_cites(df(spark, schema, texts))
    assert rows(got, "source_section_id", "target_section_id") == [("A_S1", "A_S2"), ("A_S1", "A_S3"), ("A_S1", "A_S5"), ("A_S4", "A_S1")]
    first = {r.target_section_id: r.evidence_text for r in got.collect() if r.source_section_id == "A_S1"}
    assert first["A_S3"].startswith("subject to section 2")


def test_close_pairs_are_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = random.Random(1)
    syllables = ["ta", "ren", "ou", "lik", "se", "mo", "grat", "ice", "é", "dz"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    terms = sorted({word() + rng.choice(["", " " + word()]) for _ in range(2000)})

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(t) + 1)
            t[i : i + rng.randint(0, 1)] = [rng.choice("abcdeilnorst")]
        return "".join(t)

    grams = sorted({changed(rng.choice(terms)) for _ in range(120)} - {""})
    got = grounding.close_pairs(df(spark, "gram string", [(g,) for g in grams]), df(spark, "term string", [(t,) for t in terms] + [("",), (None,)]))
    want = []
    for t in terms:
        for g in grams:
            m = SequenceMatcher(None, t, g)
            if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8:
                want.append((g, t, m.ratio()))
    assert want and rows(got, "gram", "term", "r") == sorted(want)


def test_upserts_and_gates(spark):
    acts = df(spark, "act_id string, act_name string", [("A", "Act A"), ("B", "Act B")])
    sections = df(spark, "section_id string, act_id string, title string", [("A_S1", "A", "old"), ("B_S1", "B", "keep")])
    new = df(spark, "section_id string, act_id string, title string, ord int", [("A_S1", "A", "first", 0), ("A_S1", "A", "last", 1), ("Z_S1", "Z", "no act", 2), ("A_S2", "A", None, 3)])
    got = graph_build.upsert_sections(sections, new, acts)
    assert [tuple(r) for r in got.orderBy("section_id").select("section_id", "title").collect()] == [("A_S1", "last"), ("A_S2", None), ("B_S1", "keep")]
    cites = df(spark, "source_section_id string, target_section_id string, evidence_text string", [])
    raw = df(spark, "source_section_id string, target_section_id string, relationship_type string, evidence_text string, ord int", [("A_S1", "B_S1", "CITES", "e1", 0), ("A_S1", "B_S1", "CITES", "e2", 1), ("A_S1", "X", "CITES", "", 2), ("A_S1", "B_S1", "OTHER", "", 3)])
    assert rows(graph_build.upsert_cites(cites, raw, sections), "source_section_id", "target_section_id", "evidence_text") == [("A_S1", "B_S1", "e2")]
    kept, skipped = graph_build.load_applies_to(df(spark, "section_id string, concept_id string, relevance string", [("A_S1", "c", None), (None, "c", None), ("X", "c", "primary")]), sections)
    assert rows(kept, "section_id", "relevance") == [("A_S1", "supporting")] and rows(skipped, "reason") == [("MISSING_SECTION_ID",), ("SECTION_NOT_FOUND",)]
    with pytest.raises(ValueError):
        graph_build.assert_unique(new, "section_id")
    with pytest.raises(ValueError):
        graph_build.upsert_concepts(df(spark, "concept_id string, name string, description string, aliases array<string>", []), df(spark, "concept_id string, name string, description string, aliases array<string>", [(None, "x", None, None)]))


def test_readers(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"act_id":"A","section_id":"A_S1"}\n\n{"act_id":"A","section_id":"A_S2"}\n')
    assert readers.read_sections(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"act_id":"A"}\n{oops\n')
    with pytest.raises(Exception, match="malformed record in .*bad.jsonl, line 2"):
        readers.read_sections(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "c.json").write_text(json.dumps([{"concept_id": "c", "name": "N", "aliases": ["x"], "maps_to": [{"section_id": "A_S1"}]}]))
    concepts, maps = readers.read_concept_map(spark, str(tmp_path / "c.json"))
    assert rows(concepts, "concept_id", "name") == [("c", "N")] and rows(maps, "section_id", "relevance") == [("A_S1", "supporting")]
    (tmp_path / "m.json").write_text(json.dumps({"acts": [{"act_id": "A", "status": "repealed"}, {"act_id": "B"}], "jurisdiction_aliases": {"India": "Central", "karnataka": "Karnataka"}}))
    acts, aliases = readers.read_act_metadata(spark, str(tmp_path / "m.json"))
    assert rows(acts, "act_id", "status", "jurisdiction") == [("A", "repealed", "Central"), ("B", "in_force", "Central")]
    assert rows(aliases, "ord", "alias") == [(0, "india"), (1, "karnataka")]
    assert rows(readers.act_metadata_violations(acts), "act_id", "problem") == [("A", "repealed without authority")]
    assert readers.act_metadata_violations(acts.where("false")).count() == 1
    (tmp_path / "sm.json").write_text(json.dumps({"mappings": {"_note": [], "A_S1": [["c", "primary"], ["d", "supporting"]]}}))
    assert rows(readers.read_section_map(spark, str(tmp_path / "sm.json")), "section_id", "concept_id") == [("A_S1", "c"), ("A_S1", "d")]
    pages = df(spark, "doc_id string, page_no int, text string", [("d", 2, "tion ends"), ("d", 1, "a sec-")])
    assert readers.document_text(pages).first().text == "a section ends"
    assert not readers.write_concept_map(concepts, maps, str(tmp_path / "out"), False) and not (tmp_path / "out").exists()
    assert readers.write_concept_map(concepts, maps.where("false"), str(tmp_path / "out"))
    assert rows(snapshots.read_table(spark, str(tmp_path / "out"), "concepts"), "concept_id", "aliases") == [("c", ["x"])]
    for text, problem in (('{"concept_id": "c"}', "no array"), ('[{"concept_id": "c"}, 7]', "malformed element 1"), ('[{"concept_id": "c"}, {"aliases": "x"}]', "malformed element 1"), ('[{"concept_id": ', "no array"), ("[]", None)):
        (tmp_path / "x.json").write_text(text)
        if problem is None:
            assert readers.read_concept_map(spark, str(tmp_path / "x.json"))[0].collect() == []
        else:
            with pytest.raises(Exception, match=f"{problem}.*x.json"):
                readers.read_concept_map(spark, str(tmp_path / "x.json"))[0].collect()
    (tmp_path / "m.json").write_text("[1]")
    with pytest.raises(Exception, match="no object in .*m.json"):
        readers.read_act_metadata(spark, str(tmp_path / "m.json"))[0].collect()


def test_bad_lines_are_rows_with_their_place(spark, tmp_path):
    want_good, want_bad = [], []
    for f in range(3):
        lines = []
        for i in range(1, 2000):
            text = "" if i % 50 == 0 else "  " if i % 51 == 0 else '{"a": %d, "b": "x' % i if i % 97 == 0 else "[1]" if i % 201 == 0 else '{"a": "no number"}' if i % 301 == 0 else '{"a": %d, "c": 1}' % i
            lines.append(text)
            if text.strip():
                (want_good if text == '{"a": %d, "c": 1}' % i else want_bad).append((f"f{f}.jsonl", i, i if text == '{"a": %d, "c": 1}' % i else text))
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many pieces a file
    try:
        good, bad = readers.read_records(spark, str(tmp_path), "a int, b string")
        name = F.element_at(F.split("file", "/"), -1).alias("file")
        assert rows(good.select(name, "line", "a"), "file", "line", "a") == sorted(want_good)
        assert rows(bad.select(name, "line", "text"), "file", "line", "text") == sorted(want_bad)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_snapshots_are_replaced_as_one(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert snapshots.current(spark, root) is None
    with pytest.raises(ValueError, match="nothing was published"):
        snapshots.read_table(spark, root, "acts")
    acts = lambda n: df(spark, "act_id string, n int", [(f"A{i}", n) for i in range(n)])
    assert graph_build.reload_tables({"acts": acts(3), "concepts": acts(2)}, root) == 1
    reading = snapshots.read_table(spark, root, "acts")
    broken = acts(5).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        graph_build.reload_tables({"acts": acts(5), "concepts": broken}, root)
    assert snapshots.read_table(spark, root, "acts").count() == 3 and snapshots.read_table(spark, root, "concepts").count() == 2
    assert graph_build.reload_tables({"acts": acts(4)}, root) == 2
    assert snapshots.read_table(spark, root, "acts").count() == 4 and reading.count() == 3
    with pytest.raises(Exception, match="concepts"):
        snapshots.read_table(spark, root, "concepts")  # what isn't given again is gone


def test_ontology(spark):
    c = "concept_id string, name string, aliases array<string>, ord bigint"
    merged = ontology.merge_concepts(df(spark, c, [("a", "A", ["x"], 0)]), df(spark, c, [("a", "other", [], 0), ("b", "B", [], 1)]))
    assert rows(merged, "concept_id", "name") == [("a", "A"), ("b", "B")]
    got, errors, n = ontology.merge_aliases(merged, df(spark, "concept_id string, alias string, ord int", [("a", "X", 0), ("a", "New", 1), ("a", "new", 2), ("z", "q", 3)]))
    assert {r.concept_id: r.aliases for r in got.collect()} == {"a": ["x", "New"], "b": []} and errors.count() == 1 and n.first().n_added == 1
    ap = "section_id string, concept_id string, relevance string"
    out, stats = ontology.merge_mappings(df(spark, ap, [("s", "a", "supporting"), ("t", "a", "primary")]), df(spark, ap, [("s", "a", "primary"), ("t", "a", "supporting"), ("u", "b", "supporting")]))
    assert rows(out, "section_id", "relevance") == [("s", "primary"), ("t", "primary"), ("u", "supporting")] and tuple(stats.first()) == (1, 1)
    errs = ontology.mapping_errors(df(spark, ap, [("x", "zz", "primary"), ("s", "zz", "primary"), ("s", "a", "main")]), df(spark, "section_id string", [("s",)]), merged)
    assert rows(errs, "problem") == [("bad relevance",), ("unknown concept",), ("unknown section",)]


def concepts_of(spark):
    names = [("retrenchment", ["job cuts"]), ("gratuity", ["end of service pay"]), ("industrial dispute", ["labour dispute"]), ("dispute tribunal", []), ("dispute conciliation", []), ("minimum wages", ["floor pay"])]
    return df(spark, "concept_id string, name string, aliases array<string>, ord int", [(f"c{i}", n, a, i) for i, (n, a) in enumerate(names)])


@pytest.mark.parametrize(("phrase", "want"), [
    ("must an employer retrench workmen", ["retrenchment"]),
    ("property dispute", []),
    ("my job cuts", ["retrenchment"]),
    ("gratuty amount", ["gratuity"]),
    ("xyzzy", []),
    ("", []),
])
def test_grounding(spark, phrase, want):
    got = grounding.ground(df(spark, "phrase_id int, phrase string", [(1, phrase)]), concepts_of(spark))
    assert [r.name for r in got.orderBy("ord").collect()] == want


def test_query_grounding_and_companions(spark):
    q = df(spark, "query_id int, raw_query string, legal_concepts array<string>", [(1, "gratuity please", ["retrenchment", "moon law"]), (2, "nothing", None), (3, "minimum wages", [])])
    grounded, ungrounded, warnings = grounding.ground_queries(q, concepts_of(spark))
    assert [(r.query_id, r.name) for r in grounded.orderBy("query_id", "ord").collect()] == [(1, "retrenchment"), (1, "gratuity"), (3, "minimum wages")]
    assert rows(ungrounded, "query_id", "phrase") == [(1, "moon law"), (2, "nothing")] and rows(warnings, "query_id") == [(1,), (2,)]
    comp = df(spark, "trigger_name string, companion_name string, companion_ord int", [("retrenchment", "dispute tribunal", 0), ("retrenchment", "gratuity", 1), ("gratuity", "dispute tribunal", 0), ("x", "y", 0)])
    assert rows(grounding.companions_for(grounded, comp), "query_id", "name", "ord") == [(1, "dispute tribunal", 1)]
    assert rows(grounding.unknown_companions(comp, concepts_of(spark)), "name") == [("x",), ("y",)]


def test_temporal(spark):
    schema = "act_id string, act_name string, short_name string, jurisdiction string, status string, in_force_from string, repealed_by string, repeal_authority string, act_priority int, covers string, ord int"
    acts = df(spark, schema, [("O", "Old Act", "OA", "Central", "repealed", "1950-01-01", "N", "N_S9", 0, "", 0), ("N", "New Code", "NC", "Central", "in_force", "2025-11-21", "", "", 5, "pay", 1), ("K", "State Act", "KA", "Karnataka", "in_force", "1960-02-01", "", "", 1, "", 2)])
    notes = {r.act_id: (r.repeal_note, r.replacement_note) for r in temporal.repeal_notes(acts).collect()}
    assert notes["O"] == ("The Old Act has been repealed by the New Code (section 9).", "The Old Act was replaced by the New Code on 21 November 2025.") and notes["N"] == ("", "")
    qa = df(spark, "query_id int, act_id string, event_date string", [(1, "N", "2025-08"), (2, "N", "2025-11-21"), (3, "N", None), (4, "N", "bad")])
    assert rows(temporal.commencement_conflicts(qa, acts), "query_id", "act_name", "predecessor") == [(1, "New Code", "Old Act")]
    j = df(spark, "jurisdiction string", [("I work in Bangalore",), ("india",), (" ",), (None,), ("goa",), ("indiana",)])
    al = df(spark, "alias string, jurisdiction string, ord int", [("bangalore", "Karnataka", 0), ("india", "Central", 1)])
    assert sorted(str(r.jurisdiction) for r in temporal.normalize_jurisdiction(j, al).collect()) == ["Central", "Central", "Goa", "Karnataka", "None", "None"]
    q = df(spark, "query_id int, raw_query string", [(1, "section 25n of the new code"), (2, "sec. 4"), (3, "Section 1 of the Old Act"), (4, "none")])
    refs = temporal.resolve_section_refs(q, acts)
    assert rows(refs, "query_id", "section_id") == [(1, "N_S25N"), (2, "K_S4"), (2, "N_S4"), (3, "K_S1"), (3, "N_S1")]
    s = df(spark, "query_id int, act_id string, act_name string, jurisdiction string, in_force_status string, query_jurisdiction string, ord int", [(1, "O", "Old Act", "Central", "repealed", None, 0), (1, "K", "State Act", "Karnataka", "in_force", "Central", 1), (1, "K", "State Act", "Karnataka", "in_force", None, 2)])
    kept, gone = temporal.suppress(s, temporal.repeal_notes(acts))
    assert kept.count() == 1 and temporal.suppressed_acts(gone).first().suppressed_acts["K"] == "The State Act applies only in Karnataka, and this query concerns Central."
    assert temporal.scope_text(acts).first().scope.endswith("New Code and the State Act.")


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_is_shortest_path_among_valid_sections(spark, seed):
    rng = random.Random(seed)
    n = 40
    status = {f"s{i}": rng.random() < 0.2 for i in range(n)}
    edges = {(f"s{rng.randrange(n)}", f"s{rng.randrange(n)}") for _ in range(60)}
    seeds = {q: {x for x in rng.sample(sorted(status), 3) if not status[x]} for q in (1, 2)}
    nodes = df(spark, "section_id string, act_id string, jurisdiction string, in_force_status string, section_number string", [(s, "A", "Central", "repealed" if g else "in_force", s[1:]) for s, g in status.items()])
    cites = df(spark, "source_section_id string, target_section_id string", sorted(edges))
    start = df(spark, "query_id int, concept string, section_id string, query_jurisdiction string", [(q, "c", s, None) for q, ss in seeds.items() for s in ss])
    want = {}
    for q, ss in seeds.items():
        dist, todo = dict.fromkeys(ss, 0), deque(ss)
        while todo:
            x = todo.popleft()
            for a, b in edges:
                for u, v in ((a, b), (b, a)):
                    if u == x and v not in dist and not status[v] and dist[x] < 3:
                        dist[v] = dist[x] + 1
                        todo.append(v)
        want |= {(q, s): d for s, d in dist.items() if d}
    found, _ = traversal.expand(start, cites, nodes, 3)
    assert {(r.query_id, r.section_id): r.hop for r in found.collect()} == want
    two, _ = traversal.expand(start, cites, nodes, 2)
    state = df(spark, "query_id int, sufficient boolean, iteration int, max_hops int, n_sections int", [(1, False, 0, 2, 5), (2, True, 0, 2, 5)])
    deeper = traversal.deepen(state, start, two, cites, nodes, 2)
    assert {(r.query_id, r.section_id) for r in deeper.collect()} == {k for k, d in want.items() if d <= (3 if k[0] == 1 else 2)}


def test_supporting_anchor_rediscovered_keeps_hop_zero(spark):
    nodes = df(spark, "section_id string, act_id string, jurisdiction string, in_force_status string, section_number string", [(s, "A", "Central", "in_force", str(i)) for i, s in enumerate("pqrs")])
    asked = nodes.where("section_id in ('p', 'q')").select(F.lit(1).alias("query_id"), F.lit("c").alias("concept"), "section_id", F.when(F.col("section_id") == "p", "primary").otherwise("supporting").alias("relevance"), "act_id", "section_number", "jurisdiction", "in_force_status", F.lit(None).cast("string").alias("query_jurisdiction"))
    cites = df(spark, "source_section_id string, target_section_id string", [("q", "p"), ("q", "r"), ("s", "r")])
    got = traversal.traverse(asked, cites, nodes, 3, 3)
    assert rows(got["sections"], "section_id", "hop") == [("p", 0), ("q", 0), ("r", 2)]
    assert got["hops"].first().hops_taken == 3 and got["confidence"].first().confidence == 1.0
    assert rows(got["edges"], "source_section_id", "target_section_id") == [("q", "p"), ("q", "r")]


def test_queries_that_share_a_walk_get_what_each_gets_alone(spark):
    rng = random.Random(2)
    names = [f"s{i}" for i in range(40)]
    node_rows = [(s, f"A{i % 4}", ("Central", "Goa", "Asia", "Central")[i % 4], "repealed" if i % 9 == 8 else "in_force", str(i)) for i, s in enumerate(names)]
    nodes = df(spark, "section_id string, act_id string, jurisdiction string, in_force_status string, section_number string", node_rows)
    cites = df(spark, "source_section_id string, target_section_id string", [(rng.choice(names), rng.choice(names)) for _ in range(90)] + [("s0", s) for s in names])
    anchors = {"c": names[:3], "d": names[5:9]}
    asked_rows = [(q, c, s, ("primary", "supporting")[i % 2], place) for q, c, place in ((1, "c", None), (2, "c", None), (3, "c", "Goa"), (4, "d", None), (4, "c", None), (5, "d", "Asia")) for i, s in enumerate(anchors[c])]
    asked = df(spark, "query_id int, concept string, section_id string, relevance string, query_jurisdiction string", asked_rows).join(nodes, "section_id")
    every = traversal.traverse(asked, cites, nodes, 2, 12)
    columns = {"sections": ("concept", "section_id", "hop", "part"), "edges": ("concept", "source_section_id", "target_section_id"), "hops": ("concept", "hops_taken"), "confidence": ("concept", "confidence"), "suppressed": ("concept", "section_id", "hop")}
    for q in (1, 3, 4, 5):
        alone = traversal.traverse(asked.where(F.col("query_id") == q), cites, nodes, 2, 12)
        for k, cols in columns.items():
            assert rows(every[k].where(F.col("query_id") == q), *cols) == rows(alone[k], *cols), (q, k)
    assert rows(every["sections"].where("query_id = 1"), *columns["sections"]) == rows(every["sections"].where("query_id = 2"), *columns["sections"])
    # by a plain walk
    valid = lambda s, place: (n := node_rows[names.index(s)])[3] != "repealed" and not (place and n[2] not in ("Central", place))
    near = {}
    for a, b in {(r.source_section_id, r.target_section_id) for r in cites.collect()}:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for q, place in ((1, None), (3, "Goa")):
        seen = {s: 0 for i, s in enumerate(anchors["c"]) if i % 2 == 0 and valid(s, place)}
        for hop in (1, 2):
            for s in [s for s, h in seen.items() if h == hop - 1]:
                for t in near.get(s, ()):
                    if valid(t, place):
                        seen.setdefault(t, hop)
        got = {r.section_id: r.hop for r in traversal.traverse(asked.where(F.col("query_id") == q), cites, nodes, 2, 1000)["sections"].collect()}
        assert {s: h for s, h in got.items() if h > 0} == {s: h for s, h in seen.items() if h > 0 and s not in anchors["c"]}


def test_bm25_and_ranking(spark):
    import math

    q = df(spark, "query_id int, raw_query string, jurisdiction string", [(1, "wages bonus wages", None)])
    c = df(spark, "query_id int, section_id string, title string, text string, relevance string, hop int, concept_hits int, act_priority int, jurisdiction string, act_id string", [(1, "a", "wages", "bonus paid", "supporting", 1, 1, 2, "Central", "A"), (1, "b", "other", "nothing here", "primary", 0, 2, 0, "Central", "A"), (1, "c", "leave", "wages", "supporting", 0, 1, 1, "Goa", "G")])
    lens, n = {"a": 5, "b": 5, "c": 4}, 3  # titles count three times; 'here' is a stopword
    docs = {"a": ["wages"] * 3 + ["bonus", "paid"], "b": ["nothing"], "c": ["leave"] * 3 + ["wages"]}
    lens = {k: len(v) for k, v in docs.items()}
    avg, raw = sum(lens.values()) / n, {}
    for k, d in docs.items():
        raw[k] = sum(math.log(1 + (n - sum(t in x for x in docs.values()) + 0.5) / (sum(t in x for x in docs.values()) + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * lens[k] / avg)) for t in ("wages", "bonus", "wages") if t in d)
    got = {r.section_id: r.lexical for r in ranking.bm25(q, c.replace("other", "such", "title")).collect()}
    assert all(abs(got[k] - raw[k] / max(raw.values())) < 1e-9 for k in docs)
    capped = ranking.rank_and_cap(q, c, 1)
    assert [r.section_id for r in capped.collect()] == ["b"]  # a primary never gives way
    ranked = ranking.rank(q, c).withColumn("via_remedy", F.lit(False))
    low = {r.section_id: r.score for r in ranking.unstated_penalty(ranked, q).collect()}
    full = {r.section_id: r.score for r in ranked.collect()}
    assert abs(low["c"] - 0.6 * full["c"]) < 1e-5 and low["a"] == full["a"]
    budget = ranking.companion_budget(q, c.withColumn("via_remedy", F.col("section_id") == "c"), 2, 1)
    assert rows(budget, "section_id") == [("b",), ("c",)]
    pack = ranking.evidence_pack(ranked.withColumns({"act_name": F.lit("Act"), "section_number": F.lit("1")})).first().pack
    assert pack.startswith("#1 [") and "(PRIMARY) Act — Section 1: other\nnothing here" in pack


@pytest.mark.parametrize(("amount", "want"), [(1234567.0, "₹12,34,567"), (999.0, "₹999"), (-1000.4, "-₹1,000"), (100000.0, "₹1,00,000")])
def test_rupees(spark, amount, want):
    assert spark.range(1).select(calculators.rupees(F.lit(amount)).alias("x")).first().x == want


def test_calculators(spark):
    facts = df(spark, "query_id int, monthly_salary double, years_of_service double", [(1, 26000.0, 5.5), (2, 26000.0, 5.6), (3, 26000.0, 4.9), (4, None, 9.0), (5, 100.0, None)])
    concepts = df(spark, "query_id int, name string", [(i, c) for i in range(1, 6) for c in ("gratuity", "notice period")])
    shown = df(spark, "query_id int, section_id string", [(i, s) for i in range(1, 6) for s in (calculators.GRATUITY_SECTION, calculators.NOTICE_SECTION)])
    got = {(r.query_id, r.ord): r.amount for r in calculators.compute_available(facts, concepts, shown).collect()}
    assert got[1, 0] == 75000.0 and got[2, 0] == 90000.0 and got[3, 0] is None  # half a year doesn't round up; under five years there is none
    assert got[1, 1] == 26000.0 and got[1, 3] is None and (4, 0) not in got and set(k for q, k in got if q == 5) == {1}


def test_confidence_and_status(spark):
    s = "query_id int, n_extracted int, n_ungrounded int, n_grounded int, seed double, sufficient boolean, n_retrieved int, n_cited int, n_verified int, has_conflict boolean"
    got = {r.query_id: r for r in answers.confidence(df(spark, s, [(1, 0, 0, 1, 1.0, True, 3, 2, 2, False), (2, 2, 1, 1, 0.6, False, 3, 0, 0, False), (3, 0, 0, 1, 1.0, True, 3, 2, 2, True), (4, 0, 0, 0, None, None, 0, 0, 0, False)])).collect()}
    assert got[1].confidence == 1.0 and got[3].confidence == 0.5 and got[2].citation_validity == 0.0
    assert abs(got[2].confidence - (0.35 * 0.5 + 0.25 * 0.6 + 0.2 * 0.5)) < 1e-9 and got[4].status == "insufficient_evidence"
    status = lambda *a: spark.range(1).select(answers.resolve_status(*[F.lit(x) for x in a]).alias("x")).first().x
    assert status("boom", "bad", False, "ok") == "error" and status(None, "evasion", False, "ok") == "rejected" and status(None, "None.", False, "ok") == "out_of_domain" and status("", "n/a", True, "insufficient_evidence") == "insufficient_evidence"


def test_answers_hold_their_invariants_and_seeded_faults_are_found(spark):
    sections = df(spark, "section_id string, section_number string, act_name string, section_title string, section_text string", [("A_S1", "1", "Act A", "t", "within thirty days"), ("B_S1", "1", "Act B", "t", "x")])
    acts = df(spark, "act_id string, status string, jurisdiction string", [("A", "in_force", "Central"), ("B", "repealed", "Goa")])
    states = df(spark, "query_id int, draft_answer string, persona string, error string, safety_flag string, in_domain boolean, guardrail_status string, confidence double, sufficient boolean, missing string", [(1, "Pay within 30 days [A_S1, X_S9].", "judge", None, None, True, "ok", 0.9, True, None), (2, "Pay within 45 days [A_S1].", "user", None, None, True, "insufficient_evidence", 0.3, False, "more"), (3, "x", "user", "boom", None, True, "ok", 0.9, True, None)])
    cited = answers.parse_citations(states)
    shown = df(spark, "query_id int, section_id string", [(1, "A_S1"), (1, "X_S9"), (2, "A_S1")])
    verified, warnings = answers.verify_citations(cited, shown, sections)
    assert rows(verified, "query_id", "section_id") == [(1, "A_S1"), (2, "A_S1")] and warnings.count() == 1
    none = lambda s: df(spark, s, [])
    lines = answers.answer_lines(answers.display_names(verified, sections), none("query_id int, ord int, label string, amount double, note string"), none("query_id int, act_id string, act_name string, since string, predecessor string"), none("query_id int, act_name string, since string, n int"), none("query_id int, act_id string, repeal_note string, replacement_note string"))
    made = answers.assemble_answers(states, lines, "scope")
    by = {r.query_id: r for r in made.collect()}
    assert "Pay within 30 days [A_S1]." in by[1].final_answer and by[3].verified_section_ids == [] and by[3].confidence == 0.0
    assert "Section 1 of the Act A" in by[2].final_answer and "[A_S1]" not in by[2].final_answer
    cases = made.select("query_id", F.lit(None).cast("string").alias("jurisdiction_hint"))
    assert evaluation.check_invariants(made, shown, sections, acts, cases).count() == 0
    q = df(spark, "query_id int, raw_query string", [(1, ""), (2, "")])
    assert rows(evaluation.unsourced_numbers(made, sections, q), "query_id", "amount", "unit") == [(2, "45", "day")]
    bad = df(spark, "query_id int, status string, final_answer string, confidence double, verified_section_ids array<string>, persona string", [(1, "ok", "raw [Q_S1]", 0.9, ["B_S1", "Z_S1"], "citizen"), (2, "error", " ", 0.0, ["A_S1"], "lawyer")])
    hints = df(spark, "query_id int, jurisdiction_hint string", [(1, "Kerala"), (2, None)])
    got = evaluation.check_invariants(bad, shown, sections, acts, hints)
    assert set(r.rule for r in got.collect()) == {"unknown citation", "not retrieved", "repealed law", "other state", "unverified marker", "markers shown to a citizen", "citations without content", "no disclaimer", "empty answer"}
    m = evaluation.integrity_metrics(bad, got, q.where("false"), sections, acts).first()
    assert (m.passed, m.answers, m.citations, m.hallucinated, m.repealed_cited) == (0, 2, 3, 1, 1)
    want = df(spark, "id int, expect_status string, expect_concepts array<string>, must_retrieve array<string>, must_cite array<string>, must_cite_any_of array<string>, forbid_cite array<string>, forbid_acts array<string>, expect_text array<string>, forbid_text array<string>, min_confidence double", [(1, "rejected", ["pay"], ["Q"], ["Q"], ["Q"], ["B_S1"], ["B"], ["zzz"], ["RAW"], 0.95)])
    found = evaluation.check_expectations(bad, want, df(spark, "query_id int, name string", []), shown)
    assert found.count() == 10


def test_reads(spark):
    concepts = concepts_of(spark)
    ap = df(spark, "section_id string, concept_id string, relevance string", [("A_S10", "c0", "primary"), ("A_S2", "c0", "primary"), ("A_S1", "c0", "supporting")])
    sections = df(spark, "section_id string, act_id string, section_number string", [("A_S10", "A", "10"), ("A_S2", "A", "2"), ("A_S1", "A", "1")])
    exact = graph_reads.sections_for_exact_concept(df(spark, "query_id int, concept string", [(1, "RETRENCHMENT")]), concepts, ap, sections)
    assert [r.section_id for r in exact.orderBy(*graph_reads.anchor_order()).collect()] == ["A_S10", "A_S2", "A_S1"]  # numbers sort as text
    loose = graph_reads.sections_for_concept(df(spark, "query_id int, concept string", [(1, "retrench"), (2, "")]), concepts, ap, sections)
    assert rows(loose.groupBy("query_id").count(), "query_id", "count") == [(1, 3), (2, 3)]


def test_contained_phrases_meet_like_all_pairs(spark):
    said = ["", "a", "ab", "abc", "abab", "xaby", "topic 12", "the topic 1 and topic 12", "ß€ß", None, "abc", "zzzz" * 200]
    terms = ["", "a", "b", "ab", "abc", "topic 1", "topic 12", "€ß", None, "zzz", "nowhere", "ab"]
    texts = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    needles = spark.createDataFrame(list(enumerate(terms)), "j int, needle string")
    found = sorted((r.i, r.j) for r in graph_reads.join_contained(texts, "text", needles, "needle").collect())
    assert found == sorted((i, j) for i, s in enumerate(said) for j, t in enumerate(terms) if s is not None and t is not None and t in s)
    assert graph_reads.join_contained(texts, "text", needles.where("false"), "needle").count() == 0
    assert graph_reads.join_contained(texts.where("false"), "text", needles, "needle").count() == 0


def test_section_map_extras(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"mappings": {"A_S1": [["c1", "primary"]]}, "extra_aliases": {"_note": ["x"], "c1": ["one", "two"], "c2": ["three"]}, "state_only_concepts": ["c2"]}')
    aliases, state_only = readers.read_section_map_extras(spark, str(path))
    assert [(r.concept_id, r.alias) for r in aliases.orderBy("ord").collect()] == [("c1", "one"), ("c1", "two"), ("c2", "three")]
    assert [r.concept_id for r in state_only.collect()] == ["c2"]


def test_warnings_come_with_the_answer(spark):
    states = spark.sql("SELECT id AS query_id, 'Draft' AS draft_answer, 'user' AS persona, CASE WHEN id = 1 THEN 'failed' END AS error, cast(null AS string) AS safety_flag, true AS in_domain, 'ok' AS guardrail_status, 0.9D AS confidence, true AS sufficient, '' AS missing FROM range(3)")
    lines = spark.sql("SELECT 0L AS query_id, array('A_S1') AS ids, array('Section 1') AS names, array('') AS amounts, array('') AS conflicts, array('') AS since, array('') AS repealed, array('') AS replaced")
    warnings = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (2, 0, "only")], "query_id long, ord int, warning string")
    got = {r.query_id: r.warnings for r in answers.assemble_answers(states, lines, "", warnings).collect()}
    assert got == {0: [], 1: ["first", "second"], 2: ["only"]}
    assert all(r.warnings == [] for r in answers.assemble_answers(states, lines).collect())


def test_rows_of_pieces_are_never_broadcast(spark, monkeypatch):
    plans = []
    keep = graph_reads.cut
    monkeypatch.setattr(graph_reads, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(graph_reads, "cut", lambda df: plans.append(df) or keep(df))
    texts, needles = spark.createDataFrame([(0, "topic 123 and more"), (1, "topic 12")], "i int, text string"), spark.createDataFrame([(0, "topic 12"), (1, "topic 123")], "j int, needle string")
    out = graph_reads.join_contained(texts, "text", needles, "needle")
    assert sorted((r.i, r.j) for r in out.collect()) == [(0, 0), (0, 1), (1, 0)]
    # tiny files say nothing of what they hold, so only counted rows may be broadcast
    assert not [p for p in [*plans, out] if "Broadcast" in p._jdf.queryExecution().sparkPlan().toString()]


@pytest.mark.parametrize(("rows_few", "words"), [(200_000, 4), (8, 4), (8, 1), (0, 4)])
def test_pieces_are_dealt_by_their_number(spark, monkeypatch, rows_few, words):
    rng = random.Random(3)
    said = ["".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "abababababab" * 30]
    terms = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(60)} | {"abababab", "abababababab"})
    texts, needles = spark.createDataFrame(list(enumerate(said)), "i int, text string"), spark.createDataFrame(list(enumerate(terms)), "j int, needle string")
    for name, value in {"BROADCAST_ROWS": rows_few, "BIT_WORDS": words, "TASK_PIECES": 100}.items():
        monkeypatch.setattr(graph_reads, name, value)
    out = graph_reads.join_contained(texts, "text", needles, "needle")
    assert sorted((r.i, r.j) for r in out.collect()) == sorted((i, j) for i, s in enumerate(said) for j, t in enumerate(terms) if t in s)
    # a row becomes many in as many tasks as its pieces need, however few rows and files there are
    dealt = re.search(r"RoundRobinPartitioning\((\d+)\)", out._jdf.queryExecution().sparkPlan().toString())
    assert int(dealt[1]) >= sum(map(len, set(said))) // 100


def test_equal_phrases_are_grounded_once(spark, monkeypatch):
    asked, keep = [], grounding.ground_substring
    monkeypatch.setattr(grounding, "ground_substring", lambda phrases, terms: asked.append(phrases.count()) or keep(phrases, terms))
    concepts = df(spark, "name string, ord int, aliases array<string>", [("gratuity", 0, ["parting pay"]), ("notice pay", 1, [])])
    phrases = df(spark, "phrase_id int, phrase string", [(1, "Gratuity  due"), (2, "gratuity due"), (3, " gratuity due"), (4, "notise pay"), (5, "Notise pay"), (6, "")])
    assert rows(grounding.ground(phrases, concepts), "phrase_id", "name", "ord") == [(1, "gratuity", 1), (2, "gratuity", 1), (3, "gratuity", 1), (4, "notice pay", 1), (5, "notice pay", 1)]
    assert asked == [2]


def test_walks_end_when_their_cap_is_full(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"s{i}" for i in range(60)]
    nodes = df(spark, "section_id string, act_id string, jurisdiction string, in_force_status string, section_number string", [(s, f"A{i % 4}", ("Central", "Goa")[i % 2], "repealed" if i % 9 == 8 else "in_force", str(i)) for i, s in enumerate(names)])
    cites = df(spark, "source_section_id string, target_section_id string", [(rng.choice(names[:50]), rng.choice(names[:50])) for _ in range(70)])
    asked_rows = [(q, c, s, ("primary", "supporting")[i % 3 == 2], place) for q, c, place in ((1, "c", None), (2, "c", "Goa"), (3, "d", "Asia"), (4, "e", None)) for i, s in enumerate({"c": names[:4], "d": names[20:29], "e": names[55:57]}[c])]
    asked = df(spark, "query_id int, concept string, section_id string, relevance string, query_jurisdiction string", asked_rows).join(nodes, "section_id")
    every = traversal.traverse(asked, cites, nodes, 2, 5)
    short = traversal.traverse(asked, cites, nodes, 2, 5, whole=False)
    for k, cols in {"sections": ("query_id", "section_id", "hop", "part"), "edges": ("query_id", "source_section_id", "target_section_id"), "confidence": ("query_id", "confidence")}.items():
        assert rows(short[k], *cols) == rows(every[k], *cols), k
    assert rows(traversal.depths(asked, cites, nodes, 2), "query_id", "hops_taken") == rows(every["hops"], "query_id", "hops_taken")
    assert rows(traversal.depths(asked, cites, nodes, 1), "query_id", "hops_taken") == [(q, 1) for q, _ in rows(every["hops"], "query_id", "hops_taken")]
    # anchors alone fill a cap of one, so no edge is looked at
    monkeypatch.setattr(traversal, "_ways", lambda *a: 1 / 0)
    assert traversal.traverse(asked, cites, nodes, 2, 1, whole=False)["sections"].count() == 4


def test_overlap_with_common_words_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = ["large", "small", "ring", "bolt", "plate", "topic", "economy", "cold", "brass", "wage"]
    concept_rows = [(f"c{i}", f"{rng.choice(words)} {rng.choice(words)} topic {100 + i}" if i % 7 else rng.choice(words) + "x" * (i % 3), [f"topic {100 + i}", f"{rng.choice(words)} {rng.choice(words)}"], i) for i in range(80)]
    concepts = df(spark, "concept_id string, name string, aliases array<string>, ord int", [r for i, r in enumerate(concept_rows) if r[1] not in {x[1] for x in concept_rows[:i]}])
    phrases = df(spark, "phrase_id int, phrase string", [(i, " ".join(rng.choice([*words, str(100 + rng.randrange(90)), "unheard"]) for _ in range(1 + i % 6))) for i in range(120)])
    exploded, names, freq = grounding.build_vocabulary(concepts)
    own = [(r.phrase_id, r.t) for r in phrases.select("phrase_id", grounding.T.content_tokens(F.col("phrase")).alias("t")).collect() if r.t]
    terms, freq, whole = {}, {r.token: r.df for r in freq.collect()}, {r.name: r.name_tokens for r in names.collect()}
    for r in exploded.collect():
        terms.setdefault((r.name, r.ord, r.term_ord), set()).add(r.token)
    want = []
    for pid, said in own:
        scores = {}
        for (name, ord_, _), toks in terms.items():
            both = toks & set(said)
            if both and max(map(len, both)) >= 4 and (len(both) > 1 or whole[name] == list(both) or min(freq[t] for t in both) <= grounding.MAX_DF):
                share = max(len(both) / len(said), len(both) / len(toks))
                if share >= grounding.MIN_SHARE:
                    scores[name, ord_] = max(share, scores.get((name, ord_), 0))
        want += [(pid, name, n) for n, ((name, _), _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0][1]))[: grounding.MAX_OVERLAP], 1)]
    for common in (0, 3, 1000):
        monkeypatch.setattr(grounding, "COMMON_TERMS", common)
        assert rows(grounding.ground_overlap(phrases, concepts), "phrase_id", "name", "n") == sorted(want), common


def test_close_texts_meet_by_several_letters(spark):
    keys = spark.createDataFrame([(["a1", "b1", "c1", "d1"], 1), (["a1", "b1", "c1", "d1"], 2), (["a1", "b1", "c1", "d1"], 3), (["a1", "b1"], 2)], "items array<string>, n int")
    sizes = [len(r[0]) for r in keys.select(grounding._choices(F.col("items"), F.col("n"))).collect()]
    assert sizes == [4, 6, 4, 1]  # all choices of one, two and three of four letters; of two of two
    found = grounding.close_pairs(spark.createDataFrame([("tpic 1234",)], "gram string"), spark.createDataFrame([(f"topic {i}",) for i in range(1000, 1300)], "term string"))
    assert "topic 1234" in {r.term for r in found.collect()}


def test_relevance_is_dealt_by_query(spark, monkeypatch):
    monkeypatch.setattr(graph_reads, "TASK_ROWS", 4)
    names = df(spark, "concept_id string, name string", [("c0", "hot"), ("c1", "own")])
    ap = df(spark, "section_id string, concept_id string, relevance string", [("S1", "c0", "primary"), ("S2", "c0", "primary"), ("S2", "c1", "primary")])
    asked = df(spark, "query_id int, name string", [(i, "own") for i in range(12)])
    hot = df(spark, "query_id int, name string", [(i, "hot") for i in range(12)])
    found = grounding.relevance_for(asked, hot, names, ap)
    assert found.rdd.getNumPartitions() == 9  # 36 rows before they are grouped
    assert rows(found.where("query_id = 3"), "section_id", "relevance") == [("S1", "supporting"), ("S2", "primary")]


def test_commencement_is_dealt_by_query(spark, monkeypatch):
    monkeypatch.setattr(graph_reads, "TASK_ROWS", 4)
    qa = df(spark, "query_id int, act_id string, event_date string", [(i, "A", "1999") for i in range(10)] * 2)
    acts = df(spark, "act_id string, act_name string, in_force_from string, repealed_by string, ord int", [("A", "Code", "2000-01-01", "", 0)])
    found = temporal.commencement_conflicts(qa, acts)
    assert found.rdd.getNumPartitions() == 5  # 20 rows before equal ones are brought together
    assert found.count() == 10


def test_expectations_meet_their_cases_once(spark):
    made = df(spark, "query_id int, status string, final_answer string, confidence double, verified_section_ids array<string>", [(i, "ok", "text", 0.5, ["A_S1"]) for i in range(4)])
    want = df(spark, "id int, expect_status string, expect_concepts array<string>, must_retrieve array<string>, must_cite array<string>, must_cite_any_of array<string>, forbid_cite array<string>, forbid_acts array<string>, expect_text array<string>, forbid_text array<string>, min_confidence double",
              [(0, None, None, None, None, None, None, None, None, None, None), (1, "ok", ["Pay", None], ["A_S1", "B"], ["A_S1"], ["B", "A_S1"], ["B"], ["B"], ["TEXT"], ["no"], 0.5), (2, "no", ["pay"], [], ["B"], [], ["A_S1"], ["A"], ["z"], ["T"], 0.6)])
    grounded, shown = df(spark, "query_id int, name string", [(1, "PAY")]), df(spark, "query_id int, section_id string", [(1, "A_S1")])
    found = evaluation.check_expectations(made, want, grounded, shown)
    assert sorted((r.query_id, r.rule, r.detail or "") for r in found.collect()) == sorted([
        (1, "concept not grounded", ""), (1, "not retrieved", "B"), (2, "status", "ok"), (2, "concept not grounded", "pay"), (2, "not cited", "B"),
        (2, "forbidden citation", "A_S1"), (2, "forbidden act", "A"), (2, "text missing", "z"), (2, "forbidden text", "T"), (2, "confidence", "0.5"),
    ])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_neighbors_read_edges_once(spark):
    edges = df(spark, "src string, dst string, rel_type string", [("a", "b", "CITES"), ("a", "b", "CITES"), ("b", "b", "CITES"), ("x", "a", "HAS_SECTION")])
    found = graph_reads.neighbors(df(spark, "section_id string", [("a",), ("b",), ("a",)]), edges)
    assert rows(found, "section_id", "neighbor_id", "rel_type", "direction") == [
        ("a", "b", "CITES", "outgoing"), ("a", "x", "HAS_SECTION", "incoming"), ("b", "a", "CITES", "incoming"), ("b", "b", "CITES", "incoming"), ("b", "b", "CITES", "outgoing"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_short_documents_are_walked_in_a_row(spark, monkeypatch):
    rng = random.Random(3)
    lines = [(f"d{i}", pos, str(rng.randrange(5))) for i in range(30) for pos in range(rng.randrange(1, 16))]
    expected = df(spark, "doc_id string, ord int, number string", [(f"d{i}", k, str(k)) for i in range(30) for k in range(4)])
    found = lambda: rows(segmentation.opened_lines(df(spark, "doc_id string, pos int, number string", lines), expected), "doc_id", "pos", "number", "ord")
    in_rows = found()
    monkeypatch.setattr(segmentation, "FOLDED", 0)
    assert in_rows == found() != []
    monkeypatch.setattr(segmentation, "FOLDED", 8)
    assert in_rows == found()
    monkeypatch.undo()
    monkeypatch.setattr(segmentation, "_chained", None)  # short ones do without
    assert in_rows == found()


def test_usual_documents_are_cut_in_a_row(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["{}. Head{}—text"] * 6 + ["[{}. In brackets]] ", "3[ran on-", "CHAPTER V", "12", "Subs. by Act 3", "State amendment", "local words", "  blank \u2003 ends\xa0", "", "x ] ]", "\r", "ſections", "{}A. Other", "{} no dot", "THE FIRST SCHEDULE"]
    line = lambda: rng.choice(pool).format(rng.randint(1, 4), rng.choice([".", " ", ". ", ".-", ""]))
    texts = [("ACT\n" + "\n".join(f"{i}. T" for i in range(1, rng.randint(2, 7))) + "\nACT\n" if i % 2 else "BEGIN\u2028") + rng.choice(["\n", "\x0c", "\r\n"]).join(line() for _ in range(rng.randint(0, 60))) + rng.choice(["", "\nThe  End\n2. no"]) for i in range(40)]
    about = [("A", "Act", 2000, "Central", "A", "f", "arrangement_based" if i % 2 else "body_only", "ACT" if i % 2 else "begin", None, ["ANNEX", "THE END"], [] if i % 2 else ["1", "2", "2", "3"][: i % 5]) for i in range(40)]
    cfg = "doc_id int, act_id string, act_name string, year int, jurisdiction string, short_name string, source_file string, parser_mode string, start_marker string, fallback_start_marker string, stop_markers array<string>, expected_sections array<string>"
    docs, configs = df(spark, "doc_id int, text string", [*enumerate(texts), (99, None)]), df(spark, cfg, [(i, f"A{i}", *x[1:]) for i, x in enumerate(about)] + [(99, "N", *about[0][1:-1], ["1"])])
    found = lambda: [rows(x, *x.columns) for x in segmentation.parse_documents(docs, configs)]
    in_rows = found()
    assert len(in_rows[0]) > 40 and in_rows[1]
    assert found() == [rows(x, *x.columns) for x in segmentation.parse_documents(docs.join(configs, "doc_id"))] == in_rows
    assert _exchanges(segmentation.parse_documents(docs, configs)[0]) == (0, 0)
    bare = lambda: rows(segmentation.missing_numbers(docs, configs), "doc_id", "number")
    missing = bare()
    borne = {(f"A{i}" if i < 99 else "N", n) for i, x in [*enumerate(about), (99, (["1"],))] for n in x[-1]} - {(r[0], r[6]) for r in in_rows[0]}
    assert {x for x in missing if not x[0] % 2 or x[0] == 99} == {(int(a[1:] or 99), n) for a, n in borne}
    assert _exchanges(segmentation.missing_numbers(docs, configs)) == (0, 0)
    monkeypatch.setattr(segmentation, "FOLDED_LINES", 8)
    assert in_rows == found() and missing == bare()


def _exchanges(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def test_companion_budget_is_windows_of_one_query(spark):
    q = df(spark, "query_id int, raw_query string, jurisdiction string", [(1, "pay the late wage", None), (2, "wage", "Goa"), (3, "none", None)])
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["wage", "pay", "late", "leave", "hours"]) for _ in range(6))
    made = [(k, f"s{i}", rng.choice(["primary", "supporting"]), rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 4), say(), say(), rng.random() < 0.4) for k in (1, 2, 3) for i in range(14)]
    c = df(spark, "query_id int, section_id string, relevance string, hop int, concept_hits int, act_priority int, title string, text string, via_remedy boolean", made).localCheckpoint()
    got = ranking.companion_budget(q, c, 5, 2)
    exchanges, joins = _exchanges(got)
    assert exchanges <= 2 and joins <= 1  # the query's words join; all else is windows
    # the two sides by themselves, then all
    base, remedy = c.where("not via_remedy"), c.where("via_remedy")
    many = {k: remedy.where(F.col("query_id") == k).count() for k in (1, 2, 3)}
    want = set()
    for k in (1, 2, 3):
        mine = [r.section_id for r in ranking.rank_and_cap(q, base.where(F.col("query_id") == k), 5 - min(2, many[k])).collect()]
        extra = [r.section_id for r in ranking.rank(q, remedy.where(F.col("query_id") == k)).orderBy("rank").collect()][: 5 - len(mine)]
        want |= {(k, s) for s in mine + extra}
    every = {(r.query_id, r.section_id): (r.score, r["rank"]) for r in ranking.rank(q, c).collect()}
    assert {(r.query_id, r.section_id): (r.score, r["rank"]) for r in got.collect()} == {k: every[k] for k in want}


def test_budget_without_scores(spark):
    q = df(spark, "query_id int, raw_query string, jurisdiction string", [(1, "pay the late wage", None), (2, "wage", "Goa"), (3, "none", None)])
    rng = random.Random(6)
    say = lambda: " ".join(rng.choice(["wage", "pay", "late", "leave", "hours"]) for _ in range(6))
    made = [(k, f"s{i}", rng.choice(["primary", "supporting"]), rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 4), say(), say(), rng.random() < 0.4) for k in (1, 2, 3) for i in range(14)]
    c = df(spark, "query_id int, section_id string, relevance string, hop int, concept_hits int, act_priority int, title string, text string, via_remedy boolean", made).localCheckpoint()
    whole, bare = ranking.companion_budget(q, c, 5, 2), ranking.within_budget(q, c, 5, 2)
    assert rows(bare, "query_id", "section_id") == rows(whole, "query_id", "section_id") != []
    windows = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(bare) < windows(whole)


def test_edges_are_dealt_once(spark):
    pairs = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("b", "d")]
    cites = df(spark, "source_section_id string, target_section_id string", pairs).localCheckpoint()
    nodes = df(spark, "section_id string, jurisdiction string, in_force_status string", [(x, "Central", "in_force") for x in "abcd"]).localCheckpoint()
    ways = traversal._ways(cites, nodes.hint("merge"))
    assert _exchanges(ways) == (2, 1)  # edges and sections, each once
    assert rows(ways, "src", "dst") == sorted({x for a, b in pairs if a != b for x in ((a, b), (b, a))})
    kept = df(spark, "query_id int, concept string, section_id string", [(1, "C", "a"), (1, "C", "b"), (2, "C", "b"), (2, "D", "d")]).localCheckpoint()
    found = traversal.filter_edges(kept, cites.hint("merge"))
    assert rows(found, "query_id", "concept", "source_section_id", "target_section_id") == [(1, "C", "a", "b"), (1, "C", "b", "a")]


def test_who_asks_for_citations_ranks_queries_with_citations(spark, tmp_path):
    from tessera.plans import queries as plans

    for t in ("region", "nation", "part", "lineitem", "customer"):
        given = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (given.where("l_orderkey % 20 = 0") if t == "lineitem" else given).write.parquet(f"{tmp_path}/{t}.parquet")
    every, edged = (plans._retrieved(spark, str(tmp_path), **x) for x in ({}, {"edged": True}))
    cols = ["query_id", "section_id", "relevance", "hop", "concept_hits", "via_remedy"]
    mine, whole = rows(edged["cands"], *cols), rows(every["cands"], *cols)
    asked = {r.query_id for r in every["edges"].select("query_id").distinct().collect()}
    assert mine == [x for x in whole if x[0] in asked]
    assert 0 < len(mine) < len(whole)


def test_words_once_are_words_of_each_ranking(spark):
    q = df(spark, "query_id int, raw_query string", [(1, "wage wage pay"), (2, "other")])
    c = df(spark, "query_id int, section_id string, title string, text string", [(1, "a", "pay", "wage wage"), (1, "b", None, "leave"), (1, "c", "wage", None), (2, "a", "pay", "wage wage"), (9, "a", "pay", "pay")])
    cols = ("query_id", "section_id", "lexical")
    once = ranking.with_words(q, ranking.spoken(c).drop("title", "text"))
    assert rows(ranking.bm25(q, once), *cols) == rows(ranking.bm25(q, c), *cols)
    assert rows(ranking.bm25(q, c).where("lexical = 0"), "query_id", "section_id") == [(1, "b"), (2, "a"), (9, "a")]


def test_walks_shared_before_their_sections(spark):
    rng = random.Random(6)
    names = [f"s{i}" for i in range(60)]
    nodes = df(spark, "section_id string, act_id string, jurisdiction string, in_force_status string, section_number string", [(s, f"A{i % 4}", ("Central", "Goa", "Asia", "Central")[i % 4], "repealed" if i % 9 == 8 else "in_force", str(i)) for i, s in enumerate(names)]).localCheckpoint()
    cites = df(spark, "source_section_id string, target_section_id string", [(rng.choice(names), rng.choice(names)) for _ in range(80)]).localCheckpoint()
    queries = df(spark, "query_id int, concept string, query_jurisdiction string", [(1, "c", None), (2, "c", None), (3, "c", "Goa"), (4, "d", "Goa"), (4, "c", None), (5, "e", None)])
    about = df(spark, "concept string, section_id string, relevance string", [(c, s, ("primary", "supporting")[i % 2]) for c, at in (("c", 0), ("d", 20)) for i, s in enumerate(names[at : at + 4])])
    found_of = lambda asked: asked.join(about, "concept").join(nodes, "section_id")
    every = traversal.traverse(found_of(queries), cites, nodes, 2, 9)
    walks, members = traversal.shared_walks(queries)
    shared = traversal.traverse(found_of(walks), cites, nodes, 2, 9, whole=False, members=members)
    for k, cols in {"sections": ("section_id", "hop"), "edges": ("source_section_id", "target_section_id"), "confidence": ("confidence",)}.items():
        cols = ("query_id", "concept", *cols)
        assert rows(shared[k], *cols) == rows(every[k], *cols)
    assert rows(every["edges"], "source_section_id")
    assert rows(traversal.depths(found_of(walks), cites, nodes, 2, members), "query_id", "concept", "hops_taken") == rows(every["hops"], "query_id", "concept", "hops_taken")
    seeds = traversal.find_anchors(found_of(walks))[0].where("relevance = 'primary'").select("query_id", "concept", "section_id", "query_jurisdiction")
    cols = ("query_id", "concept", "section_id", "hop")
    own, _ = traversal.expand(seeds, cites, nodes, 2)
    dealt, _ = traversal.expand(seeds, cites, nodes, 2, whole=False, members=members)
    assert rows(dealt, *cols) == rows(traversal.by_query(own, members), *cols) != []


def test_amounts_are_marked_once(spark):
    sums = df(spark, "query_id int, ord int, label string, section_id string", [(1, 1, "a", "s1"), (1, 2, "b", "s2"), (1, 3, "c", "s9"), (2, 1, "d", "s1"), (3, 1, "e", None), (4, 1, "f", "s2"), (4, 1, "g", "s2"), (4, 1, "h", "s1")])
    shown = df(spark, "query_id int, section_id string", [(1, "s1"), (1, "s1"), (1, "s9"), (4, "s2")])
    ok, lost = answers.verify_calculations(sums, shown, df(spark, "section_id string", [("s1",), ("s2",), ("s2",)]))
    assert rows(ok, "query_id", "ord", "label") == [(1, 1, "a"), (4, 1, "f"), (4, 1, "g")]
    assert rows(lost, "query_id", "ord", "warning") == [(1, 2, "Dropped calculation b."), (1, 3, "Dropped calculation c."), (2, 1, "Dropped calculation d."), (3, 1, "Dropped calculation e.")]
    assert _exchanges(ok)[1] == 0  # checked before, not again by whoever reads it
