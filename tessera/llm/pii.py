"""Personal data: strict formats, and boosted trees over what looks alike; DataFrame functions alone.

Base spans are matches of four formats that pass their own checks.  Generators of
high recall propose further spans, which may overlap: numbers grouped like phones with or without the plus, numbers
as long as cards with or without a right check digit, mail addresses with the at sign written out or not, identifiers in three
groups.  Each is described by a few categories of format and context.

What confirms a proposal is hidden from these categories: the plus before a phone, the check digit of a card, the at sign of
an address, the word that names an identifier.  So the trees learn which formats and contexts are mostly
confirmed, from every document and without hand-made labels, and a proposal that lacks the confirming sign can be as sure as those that have it.

Rows with equal categories are one cell; the cells, at most the product of the categories' sizes,
are counted by Spark, and the driver boosts trees of depth two on these
counts.  The score becomes a column expression.  For each generator scores are calibrated to the share of confirmed proposals per
score, pooled until it rises with the score, and its threshold is the lowest score with MIN_PRECISION.
Selected proposals that touch no base span are added; ``redact`` masks all spans.

Match positions come from splitting at the pattern: pieces and matches alternate, and running sums of their
lengths give code points.  Running values are made in chunks of CHUNK, so no array grows element by element over a whole text.

Cases: null and empty texts have no spans; very long texts are searched whole (the
patterns are possessive, so time stays linear and the stack flat); repeated rows get equal answers; an empty
table trains nothing and gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import aside, back, cut
from tessera.llm.textblock import whole_text

_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base formats, written so that no attempt is made twice within a run of equal characters.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

_AT = r"(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)"
_DOT = r"(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)"
#: Generators of proposals, and a cheap test that a text has any.
PROPOSALS = {
    "number": (r"[(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}+(?![0-9])", r"[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]"),
    "long": (r"[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "mail": (rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_AT}[A-Za-z0-9-]{{1,64}}+(?:{_DOT}[A-Za-z0-9-]{{2,32}}+){{1,4}}+", r"@|[\[(](?:at|AT)[\])]"),
    "ident": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
}
CHUNK = 64
MIN_PRECISION = 0.9
MIN_SUPPORT = 20
CONTEXT = 24
ROUNDS, RATE = 30, 0.3
_SPAN = "array<struct<s:int,e:int,m:string,c:string>>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, join) -> Column:
    """For each value what ``join``, an associative function, makes of all before it; ``zero`` where none are.

    Chunks are joined first, so the cost is that of the array, its chunks squared in the last resort.
    """
    empty = F.transform(F.slice(F.array(zero), 1, 0), lambda x: x)
    grow = lambda start: lambda xs: F.aggregate(xs, F.struct(start.alias("at"), empty.alias("out")), lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))
    totals = lambda cs: F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, b: join(a, b)))
    whole = lambda v: _let(chunks(v), lambda cs: _let(grow(zero)(totals(cs)), lambda firsts: F.flatten(F.zip_with(cs, firsts, lambda c, first: grow(first)(c)))))
    return _let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(empty))


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """Matches of a pattern: start and end in code points, the match, and what stands before it."""
    pairs = lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.lower(F.substring(p, -CONTEXT, CONTEXT)).alias("c"), m.alias("m")))
    ends = lambda ps: running(F.transform(ps, lambda x: x["gap"] + F.length(x["m"])), F.lit(0), lambda a, b: a + b)
    placed = lambda ps: F.zip_with(ps, ends(ps), lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["c"].alias("c")))
    found = _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda f: F.when(F.size(f) > 0, _let(pairs(f), placed)).otherwise(F.array().cast(_SPAN)))
    return F.when(guard, found).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def base_spans(text: Column) -> dict[str, Column]:
    bare = lambda part: F.ltrim(part, F.lit("0"))
    small = lambda part: (F.length(bare(part)) <= 3) & (F.coalesce(F.substring(bare(part), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    n = lambda m: F.length(_digits(m))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"))), lambda x: F.forall(F.split(x["m"], r"\."), small)),
        "card": F.filter(spans(text, CARD, F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))), lambda x: n(x["m"]).between(12, 19) & _luhn(_digits(x["m"]))),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda x: n(x["m"]).between(9, 15)),
    }


#: Categories of a proposal: name, number of values, column of the span.  The sign that confirms it isn't among them.
def _categories(kind: int, x: Column) -> dict[str, Column]:
    m, c = x["m"], F.regexp_replace(x["c"], r"\+$", "")
    n = F.length(_digits(m))
    seps = F.length(m) - n
    hosts = F.size(F.split(m, r"\.|[dD][oO][tT]")) - 1
    word = lambda *ws: F.rlike(c, F.lit("(?:" + "|".join(ws) + ")"))
    mail = kind == list(PROPOSALS).index("mail")
    return {
        "kind": F.lit(kind),
        "size": F.lit(0) if mail else F.when(n < 9, 1).when(n < 12, 2).when(n < 15, 3).when(n == 16, 4).otherwise(5),
        "gaps": F.least(hosts, F.lit(4)) if mail else F.least(seps, F.lit(4)),
        "form": F.lit(0) if mail else F.when(F.contains(m, F.lit("(")), 1).when(F.contains(m, F.lit(".")), 2).when(F.contains(m, F.lit("-")), 3).otherwise(0),
        "lead": F.when(F.rlike(c, F.lit(r"[0-9.,-]$")), 2).when(F.rlike(c, F.lit(r"[\p{L}#=/_]$")), 3).when(c == "", 1).otherwise(0),
        "near": F.lit(0) if kind == list(PROPOSALS).index("ident") else F.when(word("phone", "tel", "call", "mobil", "fax"), 1).when(word("card", "visa", "konto", "account", "iban", "tarjeta", "carte"), 2).when(word("mail", "contact", "write"), 3).otherwise(0),
    }


def _confirmed(kind: str, x: Column) -> Column:
    """The hidden sign: a plus before, a right check digit, an at sign, a word that names identifiers."""
    return {
        "number": x["c"].endswith("+"),
        "long": _luhn(_digits(x["m"])),
        "mail": F.contains(x["m"], F.lit("@")),
        "ident": F.rlike(x["c"], F.lit(r"\b(?:ssn|social|passport|id|identity|insurance)\b")),
    }[kind]


CATEGORIES = {"kind": len(PROPOSALS), "size": 6, "gaps": 5, "form": 4, "lead": 4, "near": 4}


@dataclass
class Boosted:
    """Trees of depth two: (test, test where it fails, test where it holds, four values); a test is (category, value)."""

    prior: float
    trees: list
    thresholds: dict[int, float]  # by kind

    def score_of(self, cell: dict) -> float:
        total = self.prior
        for root, no, yes, values in self.trees:
            side = cell[root[0]] == root[1]
            test = yes if side else no
            total += values[2 * side + (cell[test[0]] == test[1])]
        return total

    def column(self, cell: Column) -> Column:
        total = F.lit(self.prior)
        holds = lambda test: cell[test[0]] == test[1]
        for root, no, yes, v in self.trees:
            total = total + F.when(holds(root), F.when(holds(yes), v[3]).otherwise(v[2])).otherwise(F.when(holds(no), v[1]).otherwise(v[0]))
        return total


def boost(cells: list[tuple[dict, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> Boosted:
    """Gradient boosting with logistic loss on counted cells (categories, examples, positives)."""
    n, pos = sum(x[1] for x in cells), sum(x[2] for x in cells)
    prior = math.log((pos + 1) / (n - pos + 1))
    model = Boosted(prior, [], {})
    score = [prior] * len(cells)
    tests = [(name, value) for name, size in CATEGORIES.items() for value in range(size)]

    def best(rows: list[int], grad: list[float], hess: list[float]) -> tuple[float, tuple]:
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        top = (-1.0, tests[0])
        sums: dict[tuple, list[float]] = {}
        for i in rows:
            for name in CATEGORIES:
                s = sums.setdefault((name, cells[i][0][name]), [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
        for test in tests:
            a, b = sums.get(test, (0.0, 0.0))
            gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
            if gain > top[0] + 1e-12:
                top = (gain, test)
        return top

    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [x[2] - x[1] * q for x, q in zip(cells, p, strict=True)]
        hess = [x[1] * q * (1 - q) for x, q in zip(cells, p, strict=True)]
        holds = lambda i, test: cells[i][0][test[0]] == test[1]
        root = best(list(range(len(cells))), grad, hess)[1]
        sides = [[i for i in range(len(cells)) if holds(i, root) == side] for side in (False, True)]
        leaves, values = [], []
        for rows in sides:
            test = best(rows, grad, hess)[1]
            leaves.append(test)
            for side in (False, True):
                own = [i for i in rows if holds(i, test) == side]
                values.append(rate * sum(grad[i] for i in own) / (sum(hess[i] for i in own) + 1))
        model.trees.append((root, leaves[0], leaves[1], values))
        score = [model.score_of(x[0]) for x in cells]
    # calibration, by kind: equal scores are pooled, then neighbours until the share confirmed falls with the score
    for kind in sorted({x[0]["kind"] for x in cells}):
        pools: list[list[float]] = []  # lowest score, examples, positives
        own = [(s, k, good) for s, (cell, k, good) in zip(score, cells, strict=True) if cell["kind"] == kind]
        for s, k, good in sorted(own, key=lambda x: -x[0]):
            pools.append([s, k, good])
            while len(pools) > 1 and (pools[-2][0] - pools[-1][0] < 1e-9 or pools[-2][2] * pools[-1][1] <= pools[-1][2] * pools[-2][1]):
                low, k1, good1 = pools.pop()
                pools[-1] = [low, pools[-1][1] + k1, pools[-1][2] + good1]
        if sure := [s for s, k, good in pools if k >= MIN_SUPPORT and good >= MIN_PRECISION * k]:
            model.thresholds[kind] = min(sure) - 1e-9
    return model


def _proposed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, the base spans of each kind, and all proposals with their categories."""
    text = whole_text()
    found = docs.select("doc_id", *carry, *[x.alias(k) for k, x in base_spans(text).items()], *[spans(text, p, F.rlike(text, F.lit(g))).alias(f"p_{k}") for k, (p, g) in PROPOSALS.items()])
    slim = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    cell = lambda i, kind: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _confirmed(kind, x).alias("sure"), *[v.cast("int").alias(k) for k, v in _categories(i, x).items()])
    cands = F.concat(*[F.transform(f"p_{k}", cell(i, k)) for i, k in enumerate(PROPOSALS)])
    return found.select("doc_id", *carry, *[slim(k).alias(k) for k in BASE_KINDS], cands.alias("cands"))


def apart(spans_of: Column, base: Column) -> Column:
    """Those of the spans that overlap none of ``base``: in the order of starts, none before reaches over, and none after begins too soon."""
    row = lambda x, own: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), (x["kind"] if own else F.lit(-1)).alias("kind"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: row(b, False)), F.transform(spans_of, lambda x: row(x, True))))
    far = F.lit(2**31 - 1)
    reach = lambda ev: running(F.transform(ev, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["e"])), F.lit(-1), F.greatest)
    next_ = lambda ev: F.reverse(running(F.transform(F.reverse(ev), lambda x: F.when(x["own"], far).otherwise(x["s"])), far, F.least))
    marked = lambda ev: F.zip_with(F.zip_with(ev, reach(ev), lambda x, r: F.struct(x.alias("x"), r.alias("r"))), next_(ev), lambda y, n: F.struct(y["x"].alias("x"), ((y["r"] <= y["x"]["s"]) & (n >= y["x"]["e"])).alias("free")))
    free = F.filter(_let(events, marked), lambda y: y["x"]["own"] & y["free"])
    bare = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))
    return F.when(F.size(spans_of) == 0, F.array().cast(_EXTRA)).otherwise(F.transform(free, lambda y: bare(y["x"])))


_EXTRA = "array<struct<s:int,e:int,kind:int>>"


def find_personal_data(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``carry``, the spans of each base kind, and ``extra``: selected proposals that touch none of them."""
    found = cut(_proposed(docs, carry))
    counts = found.select(F.explode("cands").alias("x")).groupBy(*[F.col(f"x.{k}").alias(k) for k in CATEGORIES]).agg(F.count("*").alias("n"), F.count_if("x.sure").alias("pos")).collect()  # bounded by CATEGORIES
    cells = sorted((tuple(r[k] for k in CATEGORIES), r.n, r.pos) for r in counts)
    model = boost([(dict(zip(CATEGORIES, c, strict=True)), n, pos) for c, n, pos in cells])
    extra = F.array().cast(_EXTRA)
    if model.thresholds:
        limit = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(v)) for k, v in model.thresholds.items()], F.lit(math.inf))
        chosen = F.filter("cands", lambda x: ~x["sure"] & (model.column(x) >= limit(x)))
        extra = apart(F.array_distinct(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))), F.concat(*BASE_KINDS))
    return found.select("doc_id", *carry, *BASE_KINDS, extra.alias("extra"))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra."""
    found = find_personal_data(docs)
    names = F.array(*[F.lit(k) for k in (*BASE_KINDS, *PROPOSALS)])
    as_rows = lambda c, i: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))
    base = F.concat(*[as_rows(k, i) for i, k in enumerate(BASE_KINDS)])
    extra = F.transform("extra", lambda x: F.struct(x["s"].alias("s"), (x["kind"] + len(BASE_KINDS)).alias("k"), x["e"].alias("e")))
    say = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(say(base), 256).alias("base_sha256"), say(F.concat(base, extra)).alias("spans"), F.size("extra").cast("bigint").alias("n_extra")
    )


def redact(docs: DataFrame, mask: str = "<private>") -> DataFrame:
    """The documents with exactly the spans of find_personal_data masked, extra ones included; spans that overlap get one mask."""
    hidden = aside(docs, "doc_id", "text")
    carry = tuple(c for c in hidden.columns if c != "doc_id")
    found = find_personal_data(hidden, carry)
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    every = F.array_sort(F.concat(*[bare(k) for k in (*BASE_KINDS, "extra")]))
    text = F.col("text")
    before = lambda acc, x: F.when(x["s"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], before(acc, x)).alias("out"))
    masked = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    i = docs.columns.index("text")
    return back(found.withColumn(f"__d{i}", F.when(text.isNotNull(), masked)), docs)
