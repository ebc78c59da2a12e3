"""Plain versions of the contracts, slow and direct."""

import hashlib
import re
from collections import defaultdict

import xxhash


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def op1(texts, width):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] += 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, sha(bytes(x for x, g in zip(t, gone) if not g))))
    return out


def op9(rows, width):
    first, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = {}
    for d, w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone[i : i + width] = b"\1" * width
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def op3_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    names = ("assign", "access", "hex")
    return tuple(sum(k == i for _, k, _ in out) for i in range(3)) + (sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))),)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def op7(text):
    text, out, counts = text or "", [], []
    names = ("email", "ip", "card", "phone")
    for i, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        n = 0
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, i == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[i]:
                out.append((m.start(), i, m.end()))
                n += 1
        counts.append(n)
    return (*counts, sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))))


def op6(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(len(w), width)
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w = low(t)
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    ids |= found
        out[d] = (len(w), len(hit), len(ids), sha(",".join(sorted(str(i) for i in ids if i is not None))), bool(hit))
    return out


def op8_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeat = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(words) < 10 or 100 * len(repeat) > 20 * len(words)


def op10(rows):
    prints = {}
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (f"{prints[d]:016x}", root(d)) for d in ids}


def op11(rows):
    import zlib

    counts = defaultdict(int)
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return a in shorter(b) if len(a) < len(b) else b in shorter(a)

    by = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(by[w]), None if form[w] is None else n[form[w]]) for w in n}


def op12(rows, k=16, rounds=3, dims=64):
    import math

    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    cents = [v for _, v in sorted((sha(f"1:{'' if i is None else i}"), v) for i, v in kept)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [near(v) for _, v in kept]
    per = defaultdict(int)
    for d, j in last:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), sha(",".join(map(str, cents[j])))) for (i, _), (d, j) in zip(kept, last)]


def op13(rows):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), d if not sets[i] else least.get(root(i))) for i, (d, _) in enumerate(rows)]


def op9_rows(rows, width):
    """A list, in the order of the rows, also where ids repeat; a null id comes before all others."""
    order = lambda d: (d is not None, d or 0)
    first, split = {}, [(order(d), (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = bytearray(len(w))
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone[i : i + width] = b"\1" * width
        out.append((len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def op5_perplexities(rows, order=5, width=6):
    """{row number: (n-grams, perplexity, worst perplexity)} of rows (text, lang, fold), by the textbook's formulas."""
    import math

    raw = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode() for t, _, _ in rows]
    cut_up = lambda b: [b[i : i + order] for i in range(len(b) - order + 1)]
    out = {}
    for lang in {x for _, x, _ in rows}:
        counts = defaultdict(int)
        for b, (_, x, fold) in zip(raw, rows):
            for g in cut_up(b) if (x, fold) == (lang, 0) else ():
                counts[g] += 1
        tables = {order: dict(counts)}
        for n in range(order - 1, 0, -1):
            left = defaultdict(int)
            for g in tables[n + 1]:
                left[g[1:]] += 1
            tables[n] = dict(left)
        ds, sums = {}, {}
        for n, t in tables.items():
            m = [sum(c == k for c in t.values()) for k in range(5)]
            y = m[1] / max(m[1] + 2 * m[2], 1)
            ds[n] = [0, *[min(max(k - (k + 1) * y * m[k + 1] / max(m[k], 1), 0.1), k - 0.05) for k in (1, 2, 3)]]
            sums[n] = defaultdict(lambda: [0, 0, 0, 0])
            for g, c in t.items():
                s = sums[n][g[:-1]]
                s[0] += c
                s[min(c, 3)] += 1
        known = {}

        def p(g):
            if not g:
                return 1 / 256
            if g not in known:
                n, lower = len(g), p(g[1:])
                if (s := sums[n].get(g[:-1])) is None:
                    known[g] = lower
                else:
                    c = tables[n].get(g, 0)
                    known[g] = (c - ds[n][min(c, 3)]) / s[0] * (c > 0) + sum(d * k for d, k in zip(ds[n][1:], s[1:])) / s[0] * lower
            return known[g]

        for i, (b, (_, x, _)) in enumerate(zip(raw, rows)):
            if x == lang:
                logs = [math.log(p(g)) for g in cut_up(b)] if counts else None
                n = max(0, len(b) - order + 1)
                mean = math.exp(-sum(logs) / n) if counts and n else None
                out[i] = (n, mean, math.exp(-min(sum(logs[j : j + width]) for j in range(n - width + 1)) / width) if counts and n >= width else None)
    return out


def op5_kept(scored, quantiles, least=100, last=0.99):
    """[kept] of rows (lang, fold, n-grams, perplexity, worst): limits are the pair of quantiles that parts best."""
    import math

    limits = {}
    at = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    for lang in {r[0] for r in scored}:
        good, bad = ([r[3:] for r in scored if r[0] == lang and r[1] == f and r[2] >= least and r[3] is not None] for f in (1, 3))
        if good:
            means, worsts = ([at([g[k] for g in good], q) for q in quantiles] for k in (0, 1))
            inside = lambda rows, a, b: sum(x <= means[a] and y <= worsts[b] for x, y in rows)
            best = [(round(inside(good, a, b) / len(good) + 1 - inside(bad, a, b) / len(bad), 9), inside(good, a, b), a, b) for a in range(len(quantiles)) for b in range(len(quantiles))] if bad else []
            limits[lang] = (means[max(best)[2]], worsts[max(best)[3]]) if best else (at([g[0] for g in good], last), at([g[1] for g in good], last))
    return [not (n >= least and lang in limits and m is not None and (m > limits[lang][0] or w > limits[lang][1])) for lang, _, n, m, w in scored]
