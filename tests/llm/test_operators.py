import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, debruijn, decontaminate, kneser_ney, mixing, pii, quality_rules, secrets, sharding, simhash, substring_sa, textblock
from tessera.llm.suffix_array import suffix_array
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["a", "bb", "ccc", "dé", "eeeee", "ff", "g", "h", "The", "jj", "of", "kk"]


def passages(seed, n=90, base_words=60):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(base_words)] for _ in range(5)]
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 50)
            words += rng.choice(base)[at : at + rng.randint(3, 60)] + [rng.choice(WORDS) for _ in range(rng.randint(0, 9))]
        out.append(" ".join(words))
    return [*out, None, "", "x " * 200, "x " * 90, out[0], out[0], out[5], "a b " * 40, "y" * 500, "\n\t "]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ("en", "fr", None)[i % 3], ("s1", "s2", "s2", "é", None)[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_suffix_array_orders_suffixes():
    import numpy as np

    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 5, 30])
        a = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.3:
            a = a[: rng.randint(1, 6)] * 8
        assert suffix_array(np.array(a, dtype=np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


@pytest.mark.parametrize(("width", "k", "max_runs"), [(40, 30, 4000), (40, 20, 2), (33, 33, 4000)])
def test_op1_against_brute_force(spark, width, k, max_runs):
    texts = passages(3)
    got = substring_sa.remove_repeats(frame(spark, texts), width, k, max_runs).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.op1(texts, width)


@pytest.mark.parametrize(("width", "k"), [(8, 3), (6, 1), (5, 5)])
def test_op9_against_brute_force(spark, width, k):
    texts = passages(5)
    ids = [i * 7 % len(texts) if len(texts) % 7 else i for i in range(len(texts))]
    got = debruijn.remove_later(frame(spark, texts, ids), width, k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.op9(list(zip(ids, texts)), width)


def test_repeated_rows_get_equal_answers(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 3
    df = frame(spark, [text, text, text], [4, 4, 9])
    got = sorted((r.doc_id, r.n_removed) for r in debruijn.remove_later(df, 8, 3).collect())
    assert got[0] == got[1] and got[2] == (9, 36)
    assert [r.n_removed for r in substring_sa.remove_repeats(df, 40, 20).collect()] == [len(text)] * 3


@pytest.mark.parametrize(("width", "k"), [(8, 3), (20, 6)])
def test_op9_twins_and_triples_against_brute_force(spark, width, k):
    rng = random.Random(width)
    loop = "one two three four five six seven eight nine ten eleven twelve " * 3
    tail = " ".join(f"t{i}" for i in range(200))
    line = " ".join(f"l{i}" for i in range(30))
    texts = [loop, loop + tail, line + " " + loop + line, "x y " * 40, " ".join(rng.choice(WORDS) for _ in range(80)) + " " + line + " " + tail]
    rows = []
    for i, t in enumerate(texts):
        rows += [(i, t)] * (1 + i % 3) + [(None, t)] * (i % 2 * 2) + [(i + 10, t + " " + t)] * 2
    rows += [(3, texts[0]), (2, texts[1]), (None, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_later(df, width, k).collect()))
    assert got == sorted((d is not None, d or 0, *x) for (d, _), x in zip(rows, brute.op9_rows(rows, width)))


def test_op2_quotas_and_limits(spark):
    texts = [("w " * (1 + i % 37)) for i in range(200)] + [None, ""]
    df = frame(spark, texts)
    got = mixing.mixing_report(df).toPandas()
    again = mixing.mixing_report(df.repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    src = df.toPandas().set_index("doc_id").source
    got["source"] = got.doc_id.map(src).fillna("~null")
    per = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.source_size).all() and (abs(per.taken - per.target) <= 0.5).all()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    # weights 1, 2, 3, 1 in code point order with null last; limits of three times the size
    order = ["s1", "s2", "é", "~null"]
    weight, cap = dict(zip(order, (1, 2, 3, 1))), {s: 3 * per.source_size[s] for s in order}
    left, open_, target = per.source_size.sum(), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    assert all(abs(per.target[s] - target[s]) < 1e-6 for s in order)


def test_op2_caps_reshare(spark):
    texts = ["w " * 10] + ["w " * 1000, "w " * 800]
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate(zip(texts, ("c", "a", "b")))]
    got = {r.doc_id: r for r in mixing.mixing_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].target == 30 and got[0].taken == 30  # weight 3 would give more than three times its size
    assert abs(got[1].target - 1780 / 3) < 1e-9 and abs(got[2].target - 2 * 1780 / 3) < 1e-9


def test_op2_shards_get_what_the_tree_deals(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", ("a", "b", "c")[i % 50 // 24], 1) for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = mixing.sized(df)
    targets, words = mixing.source_targets(sizes), sizes.agg(F.sum("__size")).first()[0]
    block = -(-words // (mixing.N_SHARDS * mixing.BLOCKS_PER_SHARD))
    quota, want = {r["__src"]: r["__quota"] for r in targets.collect()}, {}
    assert any(r.target > 2 * r.source_size for r in targets.collect())
    for r in mixing.shard_tree(targets, mixing.N_SHARDS, block).collect():
        key = ("abc"[r["__src"] - 1], r["__shard"])
        want[key] = want.get(key, 0) + min(block, quota[r["__src"]] - r["__block"] * block)
    got = mixing.mixing_report(df)
    assert all(sum(p.words for p in r.pieces) == r.taken and (not r.pieces or r.shard == r.pieces[0].shard) for r in got.collect())
    flat = got.join(df.select("doc_id", "source"), "doc_id").select("source", F.explode("pieces").alias("p")).groupBy("source", "p.shard").agg(F.sum("p.words").alias("n"))
    assert {(r.source, r.shard): r.n for r in flat.collect()} == want
    copies = mixing.mix(df).where("source = 'c'").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("mix_shard").alias("k")).collect()
    assert max(r.n for r in copies) == 3 and max(r.k for r in copies) > 1


def test_op2_copies_are_whole(spark):
    df = frame(spark, [("w " * (1 + i % 37)) for i in range(60)])
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_copy", "mix_shard"]
    assert out.select("doc_id", "text").distinct().join(df, ["doc_id", "text"]).count() == out.select("doc_id").distinct().count()
    assert out.where("mix_shard is null").count() == 0


def test_op3_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["token = ", "PASSWORD:", "api_key='", "AKIA", "ABCDEFGH12345678", "deadbeef00112233", "x", " ", "é", "=", '"', "secret: ", "tok", "ſecret=", "apikey"]
    texts = [None, "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]]
    got = secrets.find_secrets(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got] == [brute.op3_base(t) for t in texts]


def test_op3_entropy_and_allow_list():
    spans = lambda t: secrets.scan(t)[4]
    assert spans("key Zq8vT1xP0mK7wN3rB5yL9cH2 end") == "entropy:4:28"
    assert spans("key EXAMPLEZq8vT1xP0mK7wN3rB5yL9c end") == ""
    assert spans("averyveryverylongordinarywordwithoutdigits") == ""
    import math
    from collections import Counter

    s = "Zq8vT1xP0mK7wN3rB5yL9cH2aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    h = lambda w: -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
    marked = {i for a, b in secrets.entropy_windows(s, 3.7) for i in range(a, b)}
    assert marked == {j for i in range(len(s) - 19) if h(s[i : i + 20]) >= 3.7 - 1e-9 for j in range(i, i + 20)}


def test_op3_class_and_allow_list_are_of_the_window():
    rng = random.Random(5)
    found = lambda t: list(secrets.entropy_spans(t))
    for n in (32, 40, 64):
        for _ in range(200):
            key = "".join(rng.choice("0123456789ABCDEF") for _ in range(n))
            alone = found(key)
            inside = found("KEY=" + key)
            assert all(any(a <= s + 4 and e + 4 <= b for a, b in inside) for s, e in alone)
    assert found("a=907182645309182736459071826453") == []  # a long number is still no key
    rest = "Zq8vT1xP0mK7wN3rB5yL9cH2"
    long = (rest + "/") * 4
    assert found(long + "AAAAAAAA" + rest) == [(0, 100), (108, 132)]
    assert found(long + "sample/" + long) == [(0, 80), (126, 207)]
    assert found("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []


def test_op3_redact(spark):
    out = secrets.redact(frame(spark, ["my token = abcdefghijklmnop.", None])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["my <secret>", None]
    clash = frame(spark, ["my token = abcdefghijklmnop."]).withColumns({"spans": F.lit(1), "n_hex": F.lit(2)})
    assert secrets.redact(clash).columns == clash.columns and secrets.redact(clash).first().spans == 1


@pytest.mark.parametrize("texts", [[f"text {i} " * (1 + i % 50) for i in range(400)], ["same text here"] * 300 + ["other", None, ""]])
def test_op4_shards(spark, texts):
    got = sharding.sharding_report(frame(spark, texts)).toPandas()
    assert len(got) == len(texts) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    assert got.shard.between(0, 39).all()
    per = got.groupby("shard").agg(n=("slot", "count"), hi=("slot", "max"), u=("slot", "nunique"), b=("size", "sum"))
    assert (per.hi + 1 == per.n).all() and (per.u == per.n).all()
    assert per.b.max() - got["size"].sum() / 40 <= got["size"].max()
    import zlib

    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r["size"] == len((texts[r.doc_id] or "").encode()) + 16 for _, r in got.iterrows())


def test_op5_probabilities_and_both_ways(spark):
    rng = random.Random(4)
    good = ["the cat sat on the mat and the dog ran to the other cat " * rng.randint(2, 5) + str(i) for i in range(60)]
    junk = ["".join(rng.choice("#$%&*@!zxq") for _ in range(300)) for _ in range(8)]
    df = frame(spark, [*good, *junk, None, "short"]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(61, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality_scores(df, labels).toPandas().set_index("doc_id").sort_index()
    assert len(got) == 70 and got.kept[:60].mean() > 0.9 and not got.kept[60:68].any() and got.kept[68] and got.kept[69]
    other = kneser_ney.quality_scores(df, labels, broadcast_grams=0).toPandas().set_index("doc_id").sort_index()
    assert (abs(other.perplexity - got.perplexity).fillna(0) < 1e-6).all() and (other.kept == got.kept).all()
    rows = kneser_ney.with_trust(df, labels)
    table = kneser_ney.probabilities(kneser_ney.gram_counts(rows, 3), 3)
    sums = table.groupBy("lang", F.shiftright("g", 8).alias("ctx")).agg(F.sum(F.exp("logp")).alias("s")).toPandas()
    assert (sums.s <= 1 + 1e-9).all() and (table.where("logp > 0").count() == 0)


@pytest.mark.parametrize("options", [{}, {"broadcast_grams": 0}])
def test_op5_against_brute_force(spark, options):
    rng = random.Random(12)
    words = ["".join(rng.choice(["ta", "re", "nö", "li", "se"]) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    text = lambda n, odd: " ".join(rng.choice(["zqx", "Jkv!"]) if rng.random() < odd else rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([3, 30, 60]), (0, 0, 0, 0.1, 0.4)[i % 5]), ("en", "fr", None, "xx")[i * 7 % 4], "s", 0) for i in range(240)] + [(240, None, "en", "s", 0), (241, "", "fr", "s", 0), (242, "abcd", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 < 3), int(i % 5 == 4)) for i in range(0, 240) if i * 7 % 4 != 3], "doc_id long, quality int, toxic int")
    fold = {r.doc_id: r.fold for r in kneser_ney.with_trust(df, labels).collect()}
    got = {r.doc_id: r for r in kneser_ney.quality_scores(df, labels, **options).collect()}
    want = brute.op5_perplexities([(t, x or "", fold[i]) for i, t, x, _, _ in rows])
    assert {fold[i] for i in got} == {0, 1, 2, 3} and len(got) == len(rows)
    for i, (n, mean, worst) in want.items():
        assert got[i].n_grams == n
        for mine, other in ((got[i].perplexity, mean), (got[i].worst_perplexity, worst)):
            assert (mine is None) == (other is None) and (other is None or abs(mine - other) <= 1e-4 * other)
    order = sorted(got)
    kept = brute.op5_kept([(got[i].lang, fold[i], got[i].n_grams, got[i].perplexity, got[i].worst_perplexity) for i in order], kneser_ney.QUANTILES)
    assert [got[i].kept for i in order] == kept and 0 < sum(kept) < len(kept)


def test_op5_one_bad_word_in_a_long_text(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice(["ta", "re", "no", "li", "se"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    good = [text(rng.choice([60, 900])) for _ in range(160)]
    bad = [text(900) for _ in range(60)]
    for w in bad:
        w[rng.randrange(len(w))] = "zzyxquk"
    df = frame(spark, [" ".join(w) for w in good + bad]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(i, 1, 1) for i in range(160, 190)], "doc_id long, quality int, toxic int")
    for options in ({}, {"broadcast_grams": 0}):
        kept = kneser_ney.quality_scores(df, labels, **options).toPandas().set_index("doc_id").sort_index().kept
        assert not kept[190:].any() and kept[120:160].mean() > 0.9


def test_op6_against_brute_force(spark):
    rng = random.Random(6)
    words = ["Alpha", "beta", "gamma9", "Étude", "x"]
    item = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(i, item(rng.choice([1, 3, 9, 10, 11, 14, 25]) if i > 4 else 30)) for i in range(20)] + [(20, None), (21, ""), (3, "unseen words only here"), (None, "x x x x x x x x x x x x")]
    items = [x for x in items if x[1] is None or len(x[1].split()) != 1]
    docs = [None, "", *[item(rng.randint(0, 30)) for _ in range(60)], *[item(4) + " " + items[j % 5][1].upper() + " " + item(3) for j in range(12)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(frame(spark, docs), bench).collect()
    want = brute.op6(list(enumerate(docs)), items)
    mine = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got}
    assert mine == {d: (w[0], w[1], w[3], w[4]) for d, w in want.items()}
    assert {r.doc_id: r.n_items for r in got} == {d: w[2] for d, w in want.items()}


def test_op6_texts_that_repeat_themselves(spark):
    docs = ["x " * 20_000, "y x " * 9000 + "x " * 12, None, "x " * 9]
    bench = spark.createDataFrame([(1, "x " * 20_000), (2, "y x " * 7)], "item_id long, text string")
    got = decontaminate.contamination_report(frame(spark, docs), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [(20_000, 20_000, 1), (18_012, 18_012, 2), (0, 0, 0), (9, 0, 0)]


def test_op7_against_brute_force(spark):
    rng = random.Random(7)
    fixed = [None, "", "a@b.com@c.org", "a@b.com_x@d.org a@b.com-x@c.org", "1.2.3.4.5 300.1.1.1 001.002.003.255 0000000001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111 4111111111111112", "+1 (017) 555-7713 +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7", "é😀 a.b@c.de 10.0.0.1", "9" * 20000, "a" * 20000 + "@", "x@y.z " * 500]
    texts = fixed + ["".join(rng.choice("ab@.1 +-()2") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    got = pii.personal_data_report(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got] == [brute.op7(t) for t in texts]


def test_op7_redact_masks_the_spans_found(spark):
    texts = ["é pay 4111 1111 1111 1111 or a@b.com now", "no 300.1.1.1 but 10.0.0.1 and +1-2", None, "plain"]
    df = frame(spark, texts).withColumn("extra", F.lit(7))
    out = pii.redact(df).orderBy("doc_id")
    assert out.columns == df.columns
    assert [r.text for r in out.collect()] == ["é pay <private> or <private> now", "no 300.1.1.1 but <private> and +1-2", None, "plain"]


def test_op7_boosting_selects_sure_proposals(spark):
    cell = lambda kind, lead: {"kind": kind, "size": 2, "gaps": 3, "form": 0, "lead": lead, "near": 0}
    model = pii.boost([(cell(0, 1), 1000, 990), (cell(0, 0), 1000, 20), (cell(1, 0), 30, 0)])
    assert model.score_of(cell(0, 1)) >= model.thresholds[0] > model.score_of(cell(0, 0)) and 1 not in model.thresholds
    assert not pii.boost([]).thresholds


def test_op7_adds_what_lacks_the_confirming_sign(spark):
    rng = random.Random(15)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"wa ro +1 ({digits(3)}) 555-{digits(4)} ne so u{i}@mail{i % 7}.example.com, li" for i in range(60)]
    texts += [f"wa ro 1 ({digits(3)}) 555-{digits(4)} ne" for _ in range(3)] + ["wa u7 [at] mail3 [dot] example [dot] com, li", "a code 1234567 here and 7654321 there", "range 1999-2004 1.2.3.4.5.6.7", None, ""]
    df = frame(spark, texts)
    got = pii.personal_data_report(df).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got] == [brute.op7(t) for t in texts]
    assert [r.n_extra for r in got] == [0] * 60 + [1] * 4 + [0] * 4
    # the added spans by plain search
    import re

    for i in range(60, 64):
        m = re.search(r"1 \([0-9]{3}\) 555-[0-9]{4}" if i < 63 else r"u7 \[at\] mail3 \[dot\] example \[dot\] com", texts[i])
        assert got[i].spans == f"{'number' if i < 63 else 'mail'}:{m.start()}:{m.end()}"
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()][63] == "wa <private>, li"


def test_op7_running_values(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        df = spark.createDataFrame([([(i * 37) % 11 for i in range(n)],)], "v array<int>")
        r = df.select(pii.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), pii.running(F.col("v"), F.lit(-1), F.greatest).alias("m")).first()
        v = [(i * 37) % 11 for i in range(n)]
        assert r.s == [sum(v[:i]) for i in range(n)] and r.m == [max(v[:i], default=-1) for i in range(n)]


def test_op7_long_texts(spark):
    texts = ["x@y.zz " * 20_000, "9" * 40_000 + " 10.0.0.1", "+1 (017) 555-7713 " * 3000]
    got = pii.personal_data_report(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_phone) for r in got] == [(20_000, 0, 0), (0, 1, 0), (0, 0, 3000)]


def test_op8_against_brute_force(spark):
    rng = random.Random(8)
    texts = passages(8) + ["Line one here\nLine one here\n\n \nother", "# a | b & c <x> 50%\n" * 5, "one two three four five six seven eight nine ten"]
    got = quality_rules.quality_rules(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute.op8_base(t) for t in texts]
    assert all(not r.kept for r in got if r.base_failed) and rng


def test_op8_divergence():
    import math

    import numpy as np

    kl = lambda p, m: sum(a * math.log2(a / b) for a, b in zip(p, m) if a)
    js = lambda p, q: math.sqrt((kl(p, [(a + b) / 2 for a, b in zip(p, q)]) + kl(q, [(a + b) / 2 for a, b in zip(p, q)])) / 2)
    p, q = [[1.0, 0.0], [0.5, 0.5], [0.25, 0.75]], [0.25, 0.75]
    assert np.allclose(quality_rules.js_distance(np.array(p), np.array(q)), [js(x, q) for x in p])
    assert abs(quality_rules.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] - 1) < 1e-12


def test_op8_verdict_by_brute_force(spark):
    """kept, and both distances, from plain counts."""
    import re
    from collections import Counter

    rng = random.Random(12)
    common, rare = ["the", "of", "And", "to"], [f"w{i}x" for i in range(400)]
    good = [" ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(120)) for _ in range(20)]
    odd = [" ".join(f"q{rng.randint(0, 10**6)}" for _ in range(100)), "#%& " * 3 + " ".join("$%|<>" + str(rng.randint(0, 10**6)) for _ in range(100)), "too short", None]
    texts = good + odd
    df = spark.createDataFrame([(i, t, None if i == 2 else "zz", "s", 1, "x") for i, t in enumerate(texts)], DOCS + ", kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(3, 1, 1), (20, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(df, labels)
    assert sorted(out.columns) == sorted({*df.columns, *quality_rules._RESULTS})
    got = {r.doc_id: r for r in out.collect()}
    trusted = [i for i in range(15) if i not in (2, 3)]
    counts = Counter(w for i in trusted for w in texts[i].lower().split())
    words = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.N_COMMON]]

    def shares(t):
        own = t.lower().split()
        p = [own.count(w) / len(own) for w in words]
        groups = ["[a-z]", "[A-Z]", "[0-9]", r"\s", r"[.,;:!?'\"()-]", r"[^\w\s.,;:!?'\"()#*$%&|<>-]|_", r"[#*$%&|<>]", r"[\x00-\x08\x0e-\x1f]"]
        return p + [max(0, 1 - sum(p))], [len(re.findall(g, t)) / len(t) for g in groups]

    def js(p, q):
        import math

        half = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a)
        return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))

    refs = [[sum(shares(texts[i])[k][j] for i in trusted) / len(trusted) for j in range(len(shares(texts[0])[k]))] for k in (0, 1)]
    for i, t in enumerate(texts):
        if i in (2, 22, 23):  # another language, or too short
            assert i == 2 or (got[i].word_distance is None and got[i].class_distance is None)
            continue
        by_word, by_class = (js(x, r) for x, r in zip(shares(t), refs))
        assert abs(got[i].word_distance - by_word) < 1e-9 and abs(got[i].class_distance - by_class) < 1e-9
        assert got[i].kept == (not got[i].base_failed and by_word <= quality_rules.MAX_WORD_DISTANCE and by_class <= quality_rules.MAX_CLASS_DISTANCE)
    assert not got[20].kept and not got[21].kept and all(got[i].kept for i in range(20) if not got[i].base_failed)


def colliding_words():
    """Two words whose polynomial hashes modulo a power of two are equal, whatever the base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_equal_only_if_their_bytes_are(spark):
    import numpy as np

    x, y = colliding_words()
    left, right = [f"w{i}" for i in range(15)], [f"v{i}" for i in range(15)]
    df = frame(spark, [" ".join([*left, w, *right]) for w in (x, y)])
    assert [r.n_removed for r in debruijn.remove_later(df).collect()] == [0, 0]
    longer = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*left, w, *longer])) for i, w in enumerate((x, y))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_later(frame(spark, [t for _, t in rows])).collect()}
    assert got == brute.op9(rows, 20) and got[1][1] == 60
    text = f"{x} a b c d {y} a b c d"
    assert [r.n_repeat_words for r in quality_rules.quality_rules(frame(spark, [text, f"{x} a b c d " * 2])).orderBy("doc_id").collect()] == [0, 10]
    buf = np.frombuffer(f"{x} {y} {x}".encode(), dtype=np.uint8)
    ids = textblock.word_ids(buf, np.array([0, 2049, 4098]), np.array([2048, 4097, 6146]))
    assert ids[0] == ids[2] != ids[1]


def test_op1_at_its_own_width_against_brute_force(spark):
    rng = random.Random(13)
    line = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    shared = [line(700) for _ in range(6)]
    texts = [line(rng.randint(0, 500)) + "".join(rng.choice(shared)[rng.randint(0, 300) :] + line(rng.randint(0, 60)) for _ in range(rng.randint(0, 3))) for _ in range(40)]
    texts += [shared[0][:399], shared[0][:400], "ab" * 700, None, "", texts[3], colliding_words()[0], colliding_words()[1]]
    for options in ({}, {"max_runs": 2}):
        got = substring_sa.remove_repeats(frame(spark, texts), **options).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute.op1(texts, 400)


def test_op2_slots_are_a_local_shuffle(spark):
    df = frame(spark, [("w " * (1 + i % 37)) for i in range(300)])
    got = mixing.mixed_pieces(df).toPandas()
    want = mixing.mixing_report(df).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*").toPandas()
    assert got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(1, len(s) + 1))).all() and len(got) == len(want)
    both = got.merge(want, on=["doc_id", "start", "words", "shard"])
    for _, part in both.groupby("shard"):
        order = sorted(part.itertuples(), key=lambda r: (r.hash % 2**64, r.start, r.doc_id))
        assert [r.slot for r in sorted(order, key=lambda r: r.slot)] == list(range(1, len(order) + 1))


def test_op4_small_groups_stay_together_beside_a_hot_one(spark):
    texts = ["hot text " * 30] * 3000 + [f"small group {i} " * 20 for i in range(300)] * 2
    got = sharding.sharding_report(frame(spark, texts)).toPandas()
    pairs = got[got.doc_id >= 3000].assign(g=lambda d: (d.doc_id - 3000) % 300).groupby("g").shard.agg(["min", "max"])
    assert (pairs["min"] != pairs["max"]).sum() <= 39 and (pairs["max"] - pairs["min"] <= 1).all()
    per = got.groupby("shard")["size"].sum()
    assert per.max() - got["size"].sum() / 40 <= got["size"].max()


def near_copies(seed):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(200)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    return [*texts, None, "", " ", "one", "one two", "One  TWO", "one two three", texts[0]]


def test_op10_against_brute_force(spark):
    texts = near_copies(10)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute.op10(list(enumerate(texts)))


def test_op10_links_span_in_both_ways(spark):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")

    def groups(edges):
        parent = {v: v for v in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        return {v: root(v) for v in signed}

    want = groups([(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    for options in ({}, {"max_key": 3}, {"max_key": 0}):
        found = [(r.a, r.b) for r in simhash.links(fps, **options).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)
        assert groups(found) == want
    roots = {r.node: r.root for r in components.connected_components(simhash.links(fps)).collect()}
    assert all(want[v] == roots.get(v, v) for v in signed)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: i - i % 50 for i in range(200)}
    assert components.connected_components(edges.where("false")).count() == 0


CALLS = {
    "op1": lambda d, b, lab: substring_sa.remove_repeats(d),
    "op2": lambda d, b, lab: mixing.mixing_report(d),
    "op2_mix": lambda d, b, lab: mixing.mix(d),
    "op3": lambda d, b, lab: secrets.find_secrets(d),
    "op4": lambda d, b, lab: sharding.sharding_report(d),
    "op5": lambda d, b, lab: kneser_ney.quality_scores(d, lab),
    "op6": lambda d, b, lab: decontaminate.contamination_report(d, b),
    "op7": lambda d, b, lab: pii.personal_data_report(d),
    "op8": lambda d, b, lab: quality_rules.quality_rules(d),
    "op9": lambda d, b, lab: debruijn.remove_later(d),
    "op10": lambda d, b, lab: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", list(CALLS))
def test_edges(spark, name):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    none = bench.where("false"), labels.where("false")
    assert CALLS[name](empty(spark), *none).count() == 0
    rows = [(1, None, None, None, None), (None, None, None, None, None), (None, "some words here", "en", "s", 1), (2, "", "xx", "", 0), (3, "b" * 300_000, "en", "s", 1), (4, "tie tie tie", "en", "s", 1), (4, "tie tie tie", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "shard", "kind", "fp", "spans", "kept", "n_words", "items", "hit_spans", "component_id")})
    out = CALLS[name](df, bench, labels)
    assert out.count() == 7 or name == "op2_mix"
    assert CALLS[name](df, *none).count() == 7 or name == "op2_mix"
