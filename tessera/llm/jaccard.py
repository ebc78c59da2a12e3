"""N-gram Jaccard join: sets of shingles that overlap by THRESHOLD percent, found in prefix trees.

A document's set is sorted in one global order of its shingles (that of their hashes), and equal sets are one set.
Two sets of a and b shingles that link differ in at most d = 15 * (a + b) / 185 of them.  So if the global order is
cut into d + 1 + s stretches, at least 1 + s stretches hold the same shingles in both: whole paths of the prefix
tree.  Each set names its stretches by a hash, all but the s shortest; the longest shared one is always among them.
Sets are compared within classes of sizes (a ratio of CLASS_RATIO each) and, where they are small enough, with the class below, so d follows
the size.  Sets that name a stretch alike, and those tied to them, form a bunch; few other sets ever do, however frequent a
shingle is.

Each bunch is joined by a trie of its own: sequences sorted by the bunch's own frequencies share their beginnings;
a set goes down the trie with the overlap of each shared beginning counted once, and a subtree is left as soon as what remains on
both sides can't reach the threshold any more, or all in it are tied to the set already.  Overlaps are exact.

A bunch with more than BUNCH_CELLS shingles is dealt in chunks.  In a first round each chunk meets some of the first one.
Sets that the links so found tie to the bunch's largest component need no more comparing with each other; only the others
meet all chunks, in batches.  So a group of near copies costs what its size is, and no link between different texts is lost.

Cases: null and empty texts have empty sets, which link with nothing; texts of fewer than four words are one shingle; very long texts
are hashed whole; repeated rows and equal sets are one component; a null doc_id never names a component unless all its members are
null; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.repeats import bit_table
from tessera.llm.shared import cut, release
from tessera.llm.textblock import LOWER, NOT_SPACE, blocks, lists, mix, signed, whole_text, word_bounds, word_ids

SHINGLE, THRESHOLD = 4, 85
#: A set leaves so many stretches unnamed, its shortest ones, and one more for each SHARE of differences: short ones are shared by chance.
SPARE, SHARE = 2, 4
#: Largest over least size of a class: wider ones need fewer names a set, but shorter stretches.
CLASS_RATIO = 1.35
#: Shingles of a chunk.
BUNCH_CELLS = 1 << 16
#: One in so many sets of the first chunk meets all other chunks in the first round.
LEADERS = 4
#: Row ids that a task remembers at a time.
SENT = 1 << 18
BLOCK = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds.

    A shingle's hash mixes digests of its words, so equal hashes count as equal shingles.
    """
    low = LOWER[buf]
    starts, ends, at = word_bounds(low, off, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(off), dtype=np.int64)
    ids = word_ids(low, starts, ends)
    first = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    raw = low.tobytes()
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    value = np.frombuffer(digests, dtype=np.uint64)[ids]
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    n, width = len(value), np.minimum(count, SHINGLE)[text]  # short texts are one shingle
    place = np.arange(n) - at[:-1][text]
    begins = np.flatnonzero(place + width <= count[text])
    h = np.zeros(len(begins), dtype=np.uint64)
    for j in range(SHINGLE):
        there = j < width[begins]
        h[there] += mix(value[begins[there] + j] ^ _FACTORS[j]) * (_FACTORS[j + 1] | np.uint64(1))
    h = mix(h + width[begins].astype(np.uint64))
    text = text[begins]
    bits = np.uint64(int(len(count)).bit_length())
    head = (text.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(head)
    h, text = h[order], text[order]
    if ((h[1:] < h[:-1]) & (text[1:] == text[:-1])).any():  # alike in the bits that the sort saw
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def class_starts(largest: int) -> np.ndarray:
    """The least size of each class; a set links with sets of its own class and the ones beside only."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] * 100 // THRESHOLD, int(out[-1] * CLASS_RATIO)) + 1)
    return np.array(out)


def stretch_keys(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, whether the set is of the lower class there): the stretches that each set names."""
    size = np.diff(bounds)
    starts = class_starts(int(size.max(initial=0)))
    own = np.searchsorted(starts, size, side="right") - 1
    out = []
    for back in (0, 1):  # as a set of the level's own class, and as one of the class above
        level = own - back
        top = starts[np.clip(level + 1, 0, len(starts) - 1)] - 1  # the largest of the level's own class
        many = np.flatnonzero((level >= 0) & (size > 0) & (size <= top * 100 // THRESHOLD))
        top = top[many]
        differ = (100 - THRESHOLD) * (top + top * 100 // THRESHOLD) // (100 + THRESHOLD)
        many, differ = many[differ > 0], differ[differ > 0]  # else only equal sets link
        spare = SPARE + differ // SHARE
        pieces = differ + 1 + spare
        first = np.cumsum(pieces) - pieces
        who = np.repeat(np.arange(len(many)), size[many])
        inside = np.arange(len(who)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])
        token = h[bounds[many][who] + inside]
        piece = first[who] + ((token >> np.uint64(32)) * pieces[who].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(pieces.sum())
        length = np.bincount(piece, minlength=total)
        key = np.zeros(total, dtype=np.uint64)
        if len(piece):
            begin = np.flatnonzero(np.diff(piece, prepend=-1))
            key[piece[begin]] = np.add.reduceat(mix(token ^ _FACTORS[5]), begin)
        of = np.repeat(np.arange(len(many)), pieces)
        number = np.arange(total) - first[of]
        order = np.argsort((of << 42) | (np.minimum(length, (1 << 18) - 1) << 24) | number)
        named = order[np.arange(total) - first[of] >= spare[of]]  # the shortest ones are left out
        level = level[many][of[named]].astype(np.uint64)
        key = mix(mix(key[named] + number[named].astype(np.uint64) * _FACTORS[0]) + level * _FACTORS[1])
        out.append((many[of[named]], key, np.full(len(named), back == 0)))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def set_names(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits of each set; null for an empty one."""
    return [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _short(names: list[bytes | None]) -> np.ndarray:
    return np.frombuffer(b"".join([x or b"\0" * 16 for x in names]), dtype=np.int64)[::2]


class Trie:
    """Sorted sequences as edges: each hangs at the depth where it leaves the one that shares most with it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))  # frequent ones first: more is shared
        self.tokens, self.rank = tokens, rank
        cuts = np.cumsum([0, *[len(x) for x in sets]])
        path = [np.sort(rank[inverse[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.order = sorted(range(len(sets)), key=lambda i: path[i].astype(">u4").tobytes())
        self.size = np.array([len(sets[i]) for i in self.order])
        n, stack, before = len(sets), [], np.zeros(0, dtype=np.int64)
        self.depth, self.offset, self.last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
        parent, edges = np.full(n, -1, dtype=np.int64), []
        for e, i in enumerate(self.order):
            own = path[i]
            m = min(len(own), len(before))
            unlike = np.flatnonzero(own[:m] != before[:m])
            shared = int(unlike[0]) if len(unlike) else m
            while stack and self.depth[stack[-1]] >= shared:
                stack.pop()
            self.depth[e] = shared
            if stack:
                parent[e], self.offset[e] = stack[-1], shared - self.depth[stack[-1]]
            stack.append(e)
            edges.append(own[shared:])
            before = own
        self.longest, self.shortest = self.size.copy(), self.size.copy()
        for e in range(n - 1, -1, -1):  # subtrees are runs of edges
            if (p := parent[e]) >= 0:
                self.last[p] = max(self.last[p], self.last[e])
                self.longest[p], self.shortest[p] = max(self.longest[p], self.longest[e]), min(self.shortest[p], self.shortest[e])
        self.start = np.cumsum([0, *[len(x) for x in edges]])
        self.edge = np.concatenate(edges)
        by = np.argsort(parent, kind="stable")
        self.children, self.first = by, np.searchsorted(parent[by], np.arange(-1, n + 1))

    def near(self, tokens: np.ndarray, after: int, tied: np.ndarray) -> np.ndarray:
        """Numbers (in ``order``) greater than ``after`` of sets that link with the tokens, and aren't tied to them."""
        at = np.searchsorted(self.tokens, tokens)
        inside = at < len(self.tokens)
        at = at[inside]
        at = at[self.tokens[at] == tokens[inside]]
        member = np.zeros(len(self.tokens), dtype=np.int64)
        member[self.rank[at]] = 1
        free = np.zeros(len(tied) + 1, dtype=np.int64)
        np.cumsum(~tied, out=free[1:])
        n, out = len(tokens), []
        alive = self.children[self.first[0] : self.first[1]]
        base = np.zeros(len(alive), dtype=np.int64)
        while len(alive):
            # at most so much more can be shared below
            most = base + np.minimum(self.longest[alive] - self.depth[alive], n - base)
            least = np.maximum(self.shortest[alive], most)  # a linking set isn't smaller than the overlap
            keep = ((100 + THRESHOLD) * most >= THRESHOLD * (n + least)) & (self.last[alive] > after) & (free[self.last[alive] + 1] > free[alive])
            alive, base = alive[keep], base[keep]
            if not len(alive):
                break
            begin, length = self.start[alive], self.start[alive + 1] - self.start[alive]
            local = np.cumsum(length) - length
            hits = np.zeros(int(length.sum()) + 1, dtype=np.int64)
            np.cumsum(member[self.edge[np.repeat(begin - local, length) + np.arange(length.sum())]], out=hits[1:])
            overlap = base + hits[local + length] - hits[local]
            good = ((100 + THRESHOLD) * overlap >= THRESHOLD * (n + self.size[alive])) & (alive > after) & ~tied[alive]
            out.append(alive[good])
            lo, hi = self.first[alive + 1], self.first[alive + 2]
            count = hi - lo
            child = self.children[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            up = np.repeat(np.arange(len(alive)), count)
            base = base[up] + hits[local[up] + self.offset[child]] - hits[local[up]]
            alive = child
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def spanning_links(sets: list[np.ndarray], probes: list[np.ndarray] | None = None, label: list | None = None, probe_label: list | None = None) -> list[tuple[int, int]]:
    """(set, probe) links that join components, all that are needed for the links there are.

    Without probes the sets meet each other.  Labels tell what is tied already.
    """
    trie = Trie(sets)
    number: dict = {}
    label = list(range(len(sets))) if label is None else label
    comp = np.array([number.setdefault(label[i], len(number)) for i in trie.order])
    out = []
    if probes is None:
        queue = [(sets[i], e, i, None) for e, i in enumerate(trie.order)]
    else:
        queue = [(p, -1, j, number.setdefault(probe_label[j], len(number))) for j, p in enumerate(probes)]
    merged = np.arange(len(number))
    for tokens, e, j, own in queue:
        own = merged[own] if own is not None else comp[e]
        tied = comp == own
        if tied[e + 1 :].all():
            continue
        for found in trie.near(tokens, e, tied).tolist():
            if comp[found] != own:
                out.append((trie.order[found], j))
                old = comp[found]
                merged[merged == old] = own
                comp[comp == old] = own
    return out


def _links(groups: DataFrame) -> DataFrame:
    """(a, b) from rows (tree, probes): lists of (name, tokens, label); with no probes the tree's sets meet each other."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
                tree, probes = ([x for x in row["sets"] if x["probe"] is kind] for kind in (False, True))
                if not tree or len(tree) + len(probes) < 2:
                    continue
                sets = [np.frombuffer(x["tokens"], dtype=np.uint64) for x in tree]
                others = [np.frombuffer(x["tokens"], dtype=np.uint64) for x in probes] or None
                found = spanning_links(sets, others, [x["label"] or x["name"] for x in tree], [x["label"] or x["name"] for x in probes])
                right = probes or tree
                yield pa.RecordBatch.from_arrays([pa.array([tree[i]["name"] for i, _ in found], pa.binary()), pa.array([right[j]["name"] for _, j in found], pa.binary())], names=["a", "b"])

    packed = groups.groupBy("bunch", "i", "j").agg(F.collect_set(F.struct("name", "tokens", "label", "probe")).alias("sets"))
    return packed.select("sets").mapInArrow(meet, "a binary, b binary")


def named_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n, name, s, own, above) of each row: the set's size and name, half of it, and the stretches it names in its own class and as one of the class above."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in blocks(batch.column(2), BLOCK):
                h, bounds = shingle_sets(buf, off)
                names = set_names(h, bounds)
                who, key, lower = stretch_keys(h, bounds)
                listed = [lists(signed(key[lower == kind]), np.bincount(who[lower == kind], minlength=hi - lo)) for kind in (True, False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(np.diff(bounds)), pa.array(names, pa.binary()), pa.array(_short(names)), *listed], names=["doc_id", "rid", "n", "name", "s", "own", "above"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", whole_text()).alias("rid"), whole_text().alias("text"))
    return rows.mapInArrow(name, f"doc_id {kind}, rid bigint, n bigint, name binary, s bigint, own array<bigint>, above array<bigint>")


def _bunches(rows: DataFrame) -> DataFrame:
    """(node, root): short names of sets that share a named stretch, and their bunch."""
    each = rows.select("s", F.explode("own").alias("key"), F.lit(True).alias("lower")).unionByName(rows.select("s", F.explode("above").alias("key"), F.lit(False).alias("lower")))
    shared = each.groupBy("key").agg(F.min("s").alias("m"), F.max("s").alias("x"), F.max("lower").alias("lower")).where("m != x and lower")
    shared = cut(shared.select("key", "m"))
    seen = rows.sparkSession.sparkContext.broadcast(bit_table(shared, "key", shared.count()))

    def again(batches: Iterator[pa.RecordBatch], seen=seen) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0).to_numpy()
            for c in (1, 2):
                key = batch.column(c).flatten().to_numpy()
                hit = np.flatnonzero(seen.value.has(key.view(np.uint64)))
                of = np.repeat(s, np.diff(batch.column(c).offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(of[hit])], names=["key", "s"])

    again_named = rows.select("s", "own", "above").mapInArrow(again, "key bigint, s bigint")
    ties = cut(again_named.join(shared, "key").where("s != m").select(F.col("m").alias("a"), F.col("s").alias("b")).distinct())
    release(shared)
    out = cut(connected_components(ties))
    release(ties)
    return out


def _with_tokens(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (rid, name, bunch, chunk, chunks, leader) with the sets' tokens, made from the texts again.

    The texts travel to their places rather than the tokens: these take twice the room and don't compress.
    """
    inside = docs.sparkSession.sparkContext.broadcast(bit_table(placed, "rid", placed.count()))

    def wanted(batches: Iterator[pa.RecordBatch], inside=inside) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            once = []
            for k in np.flatnonzero(inside.value.has(rid.view(np.uint64))).tolist():
                if (r := int(rid[k])) not in sent:  # a row that occurs again is sent once
                    sent.add(r)
                    once.append(k)
            if len(sent) > SENT:
                sent.clear()
            if once:
                yield batch.take(pa.array(once))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column("name").to_pylist()
            for lo, hi, buf, off in blocks(batch.column("text"), BLOCK):
                h, bounds = shingle_sets(buf, off)
                same = [i for i, n in enumerate(set_names(h, bounds)) if n == expected[lo + i]]  # ids of rows are short, so two texts may share one
                made = pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in same], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi].take(pa.array(same, pa.int64())) for c in kept], made], names=[*kept, "tokens"])

    texts = docs.select(F.xxhash64("doc_id", whole_text()).alias("rid"), whole_text().alias("text"))
    kept = [c for c in placed.columns if c != "rid"]
    texts = cut(texts.mapInArrow(wanted, "rid bigint, text string"))  # a stage of its own, so that no task needs two Python workers
    out = cut(texts.join(placed, "rid").drop("rid").mapInArrow(tokens, ", ".join([*[f"{c} {placed.schema[c].dataType.simpleString()}" for c in kept], "tokens binary"])))
    release(texts)
    return out


def linked_sets(docs: DataFrame, rows: DataFrame, cells: int = BUNCH_CELLS) -> DataFrame:
    """(node, root): names of sets that link with others, and the least name of their component."""
    bunches = _bunches(rows)
    sets = rows.select("rid", "n", "name", "s").join(bunches, F.col("s") == F.col("node")).groupBy("name").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("root").alias("bunch"))
    sets = cut(sets)
    release(bunches)
    sizes = sets.groupBy("bunch").agg(F.ceil(F.sum("n") / cells).cast("int").alias("chunks"))
    hashed = F.pmod(F.xxhash64("name"), LEADERS * F.col("chunks"))
    placed = cut(sets.join(sizes, "bunch").select("rid", "name", "n", "bunch", "chunks", (hashed / LEADERS).cast("int").alias("chunk"), (hashed == 0).alias("leader")))
    release(sets)
    placed_sets = _with_tokens(docs, placed)
    columns = ["bunch", "i", "j", "name", "tokens", "label", "probe"]
    none, zero = F.lit(None).cast("binary"), F.lit(0)
    # each chunk with the leaders of the first one
    everywhere = F.col("leader") & (F.col("chunks") > 1)
    first = placed_sets.withColumns({"i": F.explode(F.when(everywhere, F.sequence(zero, F.col("chunks") - 1)).otherwise(F.array("chunk"))), "j": zero, "label": none, "probe": F.lit(False)})
    links = cut(_links(first.select(*columns)))
    large = placed.where("chunks > 1")
    if not large.isEmpty():
        comps = connected_components(links).select(F.col("node").alias("name"), F.col("root").alias("label"))
        large = cut(large.join(comps, "name", "left").withColumn("label", F.coalesce("label", "name")))
        most = large.groupBy("bunch", "label").agg(F.count("*").alias("k")).groupBy("bunch").agg(F.max(F.struct("k", "label"))["label"].alias("main"))
        large = large.join(most, "bunch")
        batches = large.where("label != main").groupBy("bunch").agg(F.ceil(F.sum("n") / cells).cast("int").alias("batches"))
        large = cut(large.join(batches, "bunch").select("name", "label", "main", "batches"))
        again = placed_sets.where("chunks > 1").join(large, "name")
        trees = again.withColumns({"i": F.col("chunk"), "j": F.explode(F.sequence(zero, F.col("batches") - 1)), "probe": F.lit(False)})
        probes = again.where("label != main").withColumns({"i": F.explode(F.sequence(zero, F.col("chunks") - 1)), "j": F.pmod(F.xxhash64("name", F.lit(7)), F.col("batches")).cast("int"), "probe": F.lit(True)})
        links = cut(links.unionByName(_links(trees.select(*columns).unionByName(probes.select(*columns)))))
    release(placed_sets, placed)
    return cut(connected_components(links))


def jaccard_components(docs: DataFrame, cells: int = BUNCH_CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id)."""
    rows = cut(named_rows(docs))
    roots = linked_sets(docs, rows, cells)
    whole = rows.where("name is not null").select("doc_id", "n", "name").join(roots, F.col("name") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "name").alias("c"))
    whole = cut(whole)
    least = whole.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    out = whole.join(least, "c").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("name is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
