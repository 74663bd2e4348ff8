"""N-gram Jaccard join by PartEnum signatures.

Sets whose similarity is at least num / den differ in at most k = (|a| + |b|) (den - num) / (den + num) elements. Sizes are cut into
bands such that similar sets are in the same or in neighbouring bands; each set signs for its own band and for the next.

Signatures. A band partitions the domain of element hashes into n1 first-level partitions, each of them into n2 second-level
ones. Of n1 partitions of two similar sets at most k / (k2 + 1) differ in more than k2 elements; in any other at least n2 - k2 of
the second-level partitions are the same. A set therefore signs, for each first-level partition, every subset of n2 - k2 of its
second-level partitions, by the elements that these hold. ``Scheme.shape`` gives n1, k2 and n2 of a band. Subsets without any
element don't sign, because all sets would meet there; a set whose elements lie so that this might lose its last shared signature
signs each single element besides. Two similar sets share a signature, always.

Steps.

* Equal texts are joined beforehand; one of them stands for all.
* ``missing``: a set of which more than (den - num) / den of the elements are in no other set has no partner. A first pass looks
  at a fixed share of the element domain only (that many missing there are enough to tell), a second one, for the sets that are left, at
  all elements. This only spares signatures; no link comes from it.
* ``leads``, ``verify_leads``: at the signatures of a few first-level partitions each set finds a set to be compared with. These
  links give first components; they only spare work.
* ``mixed_groups``: all sets that share a signature are in one group, that of its smallest node, so (pivot, member) rows say all, and
  pairs are never emitted. A signature whose sets are of one component needs none.
* ``verify_groups``: the pairs between components of a group are compared, inside a task, and only links that join two components
  come out. A group is cut into blocks of BLOCK elements, and a task holds two blocks; blocks of one component aren't compared
  with each other.

Every comparison is exact: it counts the common 64-bit element hashes of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import BLANKS, ascii_lower, attach, cut, give_back, hidden, pick, salt, salts, spread, with_least
from pitchlake.llm.components import components

#: Up to this k a band has one first-level partition and subsets of two second-level ones; beyond, k2 = 1 and n2 = 3.
FEW = 5
#: The share of the element domain that the first pass looks at is this many times the share of elements that may be missing.
LOOK = 1.6
#: Elements of a block of a group: a task holds two blocks (8 bytes an element, and their index).
BLOCK = 1 << 20
#: First-level partitions of a band whose signatures look for a lead.
LEADS = 6
#: Words whose hashes a worker keeps; emptied when full.
CACHE = 150_000
#: Elements or signatures that a worker holds before it hands them on.
FLUSH = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingles:
    """Texts to their sorted distinct shingle hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words = _Words()
        self.factors = [np.uint64(pow(_GOLD, i + 1, 1 << 64)) for i in range(width)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles of ``width`` words; with fewer words the whole sequence as one; none without words."""
        words = (text or b"").translate(_LOWER).split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if len(self.words) > CACHE:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        k = min(n, self.width)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out += h[i : n - k + 1 + i] * self.factors[i]
        return np.unique(_scramble(out))


@dataclass(frozen=True)
class Scheme:
    """Bands, bounds and signatures for similarity num / den."""

    num: int
    den: int

    def differ(self, a: int, b: int) -> int:
        """The most elements in which similar sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def missing(self, size: int) -> int:
        """The most elements of a set that a similar set may lack."""
        return size * (self.den - self.num) // self.den

    def shape(self, top: int) -> tuple[int, int, int]:
        """n1, k2, n2 of the band whose largest size is ``top``: n1 first-level partitions, subsets of n2 - k2 of the n2 in each."""
        k = self.differ(top, top)
        return (1, k, k + 2) if k <= FEW else (k // 2 + 2, 1, 3)

    def sign(self, x: np.ndarray, few: int | None = None) -> np.ndarray:
        """The signatures of a sorted set for its own band and the next; with ``few`` only those of so many first-level partitions."""
        s = len(x)
        if not s:
            return np.zeros(0, np.uint64)
        lows, tops = _bands(self)
        band = int(np.searchsorted(tops, s))
        most = s * self.den // self.num
        out = []
        for t in (band, band + 1):
            top = int(tops[t])
            if t > band and most < int(lows[t]):
                continue
            n1, k2, n2 = self.shape(top)
            sig, sound = _subsets(x, t, n1, k2, n2, few)
            out.append(sig)
            if few is None and sound <= self.differ(s, min(top, most)) // (k2 + 1):
                out.append(_scramble(x * _M2 + np.uint64(t + 1 << 32)))
        return np.concatenate(out)


@lru_cache(maxsize=16)
def _bands(scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest size of each band: the largest is the largest size that can be similar to the smallest."""
    lows, tops = [1], []
    while True:
        tops.append(lows[-1] * scheme.den // scheme.num)
        if tops[-1] >= 1 << 31:
            return np.array(lows), np.array(tops)
        lows.append(tops[-1] + 1)


@lru_cache(maxsize=64)
def _names(t: int, n1: int, k2: int, n2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each (first-level partition, subset) of a band, the subsets, and a factor for each second-level partition."""
    subsets = np.array(list(combinations(range(n2), n2 - k2)))
    at = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(n1, -1)
    return _scramble(at + np.uint64(t << 48)), subsets, np.array([pow(_GOLD, 2 * i + 1, 1 << 64) for i in range(n2)], np.uint64)


def _subsets(x: np.ndarray, t: int, n1: int, k2: int, n2: int, few: int | None = None) -> tuple[np.ndarray, int]:
    """A sorted set's signatures in band t, and in how many first-level partitions none of the subsets is without elements."""
    names, subsets, factors = _names(t, n1, k2, n2)
    n = n1 * n2
    where = ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    at = where[starts].astype(np.int64)
    held = np.zeros(n, np.uint64)
    held[at] = np.add.reduceat(x, starts)
    full = np.zeros(n, bool)
    full[at] = True
    held, full, names = held.reshape(n1, n2)[:few] * factors, full.reshape(n1, n2)[:few], names[:few]
    sig = _scramble(held[:, subsets].sum(axis=2, dtype=np.uint64) * _M2 + names)
    return sig[full[:, subsets].any(axis=2)], int((full.sum(axis=1) > k2).sum())


def _binary(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists of 64-bit numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)


def missing(rows: DataFrame, width: int, share: float = 1.0) -> DataFrame:
    """node, size and missing: how many elements of the set, in the first ``share`` of the domain, are in no other set; of rows (node, _text).

    Elements that several sets of one batch have are told there and then: they leave a mark only, so that the rows of a very
    common element are one per batch. The others meet sorted by element, where neighbours tell whether an element is alone.
    """
    last = np.uint64(min(share * 2.0**64, 2.0**64 - 1)) if share < 1 else None

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            ids, sizes, parts, held = [], [], [], 0
            nodes = batch.column(0).to_pylist()
            for k, (node, text) in enumerate(zip(nodes, _binary(batch, 1), strict=True)):
                x = shingles(text)
                ids.append(node)
                sizes.append(len(x))
                parts.append(x if last is None else x[: np.searchsorted(x, last)])
                held += len(parts[-1])
                if held >= FLUSH or k == len(nodes) - 1:
                    yield told(np.array(ids, np.int64), np.array(sizes, np.int64), parts)
                    ids, sizes, parts, held = [], [], [], 0
        shingles.words.clear()
        give_back()

    def told(ids: np.ndarray, sizes: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(parts)
        who = np.repeat(np.arange(len(ids)), [len(p) for p in parts])
        order = np.argsort(e, kind="stable")
        e, who = e[order], who[order]
        same = e[1:] == e[:-1]
        again = np.concatenate([[False], same])[: len(e)]
        met = again | np.concatenate([same, [False]])[: len(e)]
        marks, alone = e[met & ~again], ~met
        left = np.bincount(who[alone], minlength=len(ids))
        keys = np.concatenate([e[alone], marks, _scramble(ids.view(np.uint64) + np.uint64(_GOLD))])
        node = np.concatenate([ids[who[alone]], np.zeros(len(marks), np.int64), ids])
        info = np.concatenate([np.zeros(len(node) - len(marks) - len(ids), np.int64), np.full(len(marks), -1), (sizes + 1) << 31 | left])
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node), pa.array(info)], names=["e", "node", "info"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, before = [np.zeros(0, np.int64)] * 3, None  # the last row waits for the next
        for batch in batches_and_end(batches):
            rows = waiting if batch is None else [np.concatenate([w, c.to_numpy()]) for w, c in zip(waiting, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            e, node, info = rows
            same = np.concatenate([[before is not None and e[0] == before], e[1:] == e[:-1]])
            ready = len(e) if batch is None else len(e) - 1
            common = (same | np.concatenate([same[1:], [False]]))[:ready]
            keep = (info[:ready] > 0) | (common & (info[:ready] == 0))
            yield pa.RecordBatch.from_arrays([pa.array(node[:ready][keep]), pa.array((info[:ready][keep] == 0).astype(np.int64)), pa.array(info[:ready][keep])], names=["node", "found", "info"])
            before, waiting = (e[ready - 1] if ready else before), [c[ready:] for c in rows]

    def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
        yield from batches
        yield None

    met = rows.select("node", "_text").mapInArrow(elements, "e bigint, node bigint, info bigint").repartition("e").sortWithinPartitions("e")
    seen = met.mapInArrow(neighbours, "node bigint, found bigint, info bigint").groupBy("node").agg(F.sum("found").alias("found"), F.max("info").alias("info"))
    left = F.greatest(F.col("info").bitwiseAND((1 << 31) - 1) - F.col("found"), F.lit(0))
    return seen.select("node", (F.shiftright("info", 31) - 1).alias("size"), left.alias("missing"))


def element_sets(rows: DataFrame, width: int) -> DataFrame:
    """node, x (sorted element hashes) of rows (node, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            nodes, texts = batch.column(0), _binary(batch, 1)
            for i in range(0, len(texts), 256):
                parts = [shingles(t).view(np.int64) for t in texts[i : i + 256]]
                x = pa.LargeListArray.from_arrays(np.cumsum([0, *map(len, parts)]), np.concatenate(parts)).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes.slice(i, 256), x], names=["node", "x"])

    return rows.select("node", "_text").mapInArrow(run, "node bigint, x array<bigint>")


def signed(sets: DataFrame, scheme: Scheme, also: str, few: int | None = None) -> DataFrame:
    """sig, node, and the column ``also`` of each signature of the sets (node, x, also)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, x = _lists(batch.column(2))
            out: list[tuple[np.ndarray, int, int]] = []
            held = 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for k, (node, more) in enumerate(rows):
                out.append((scheme.sign(x[offsets[k] : offsets[k + 1]], few), node, more))
                held += len(out[-1][0])
                if held >= FLUSH or k == len(rows) - 1:
                    n = [len(sig) for sig, _, _ in out]
                    data = [np.concatenate([o[0] for o in out]).view(np.int64), *[np.repeat(np.array([o[c] for o in out], np.int64), n) for c in (1, 2)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in data], names=["sig", "node", also])
                    out, held = [], 0

    return sets.select("node", also, "x").mapInArrow(run, f"sig bigint, node bigint, {also} bigint")


def leads(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """node, lead: of the sets (node, common, x) that with most common elements at a signature of the node; where these differ, at most signatures."""
    rows = signed(sets, scheme, "common", LEADS).withColumn("lead", F.max(F.struct("common", "node")).over(Window.partitionBy("sig"))["node"])
    rows = rows.where(F.col("lead") != F.col("node")).groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("node").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))


def mixed_groups(sets: DataFrame, scheme: Scheme) -> DataFrame:
    """pivot, node: for each signature of sets (node, component, x) of several components, its smallest node and all its nodes, itself included.

    The sets of a signature are counted and compared with the smallest by a window that spills; a large group of near copies shares its
    signatures, but these are hundreds, in as many tasks.
    """
    of_sig = Window.partitionBy("sig")
    rows = signed(sets, scheme, "component").select("node", "component", F.min("node").over(of_sig).alias("pivot"), F.min("component").over(of_sig).alias("low"), F.max("component").over(of_sig).alias("high"))
    return rows.where("low < high").select("pivot", "node").distinct()


def _enough(x: np.ndarray, y: np.ndarray, scheme: Scheme) -> bool:
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return scheme.den * both >= scheme.num * (len(x) + len(y) - both)


def verify_leads(leads: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: the pairs of (pivot, node) whose sets are similar. The rows of a pivot are spread over salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, lead = None, np.zeros(0, np.uint64)
        for batch in batches:
            offsets, x = _lists(batch.column(3))
            a, b = [], []
            for k, (p, member, node) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)):
                own = x[offsets[k] : offsets[k + 1]]
                if not member:
                    pivot, lead = p, own.copy()
                elif p == pivot and _enough(lead, own, scheme):
                    a.append(p), b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = leads.select("pivot", salt(salts(leads), F.col("node")).alias("_s"), F.lit(True).alias("member"), "node")
    firsts = members.select("pivot", "_s").distinct().select("pivot", "_s", F.lit(False).alias("member"), F.col("pivot").alias("node"))
    dealt = members.union(firsts).join(sets.select("node", "x"), "node").repartition("pivot", "_s").sortWithinPartitions("pivot", "_s", "member", "node")
    return dealt.select("pivot", "member", "node", "x").mapInArrow(run, "a bigint, b bigint")


def joining_links(sizes: np.ndarray, commons: np.ndarray, blocks: np.ndarray, labels: np.ndarray, parts: list[np.ndarray], scheme: Scheme) -> list[tuple[int, int]]:
    """Links (i, j) between sets of different labels such that all links between labels follow from them; of two blocks, or inside one.

    Common elements are counted by an inverted index: one row of counts at a time, against all sets.
    """
    m = len(parts)
    labels = np.unique(labels, return_inverse=True)[1]
    e = np.concatenate(parts) if m else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(m), [len(p) for p in parts])
    _, at = np.unique(e, return_inverse=True)
    order = np.argsort(at, kind="stable")
    index, ends = who[order], np.concatenate([[0], np.cumsum(np.bincount(at))])
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    two = blocks.min(initial=0) != blocks.max(initial=0)
    rows = np.flatnonzero(blocks == blocks.min()) if two else np.flatnonzero(labels != np.bincount(labels).argmax()) if m else np.zeros(0, int)
    found = []
    for i in rows:
        least = np.minimum(commons[i], commons)
        other = (labels != labels[i]) & (scheme.den * least >= scheme.num * (sizes[i] + sizes - least))
        if two:
            other &= blocks != blocks[i]
        if not other.any():
            continue
        own = at[bounds[i] : bounds[i + 1]]
        first, n = ends[own], ends[own + 1] - ends[own]
        take = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(index[take], minlength=m)
        for j in np.flatnonzero(other & (scheme.den * both >= scheme.num * (sizes[i] + sizes - both))):
            if labels[i] != labels[j]:
                found.append((int(i), int(j)))
                labels[labels == labels[j]] = labels[i]
    return found


def verify_groups(rows: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """a, b: links between components inside groups, of rows (pivot, node, size, common, component, tried); tried: compared with the pivot before.

    Blocks 0 to small - 1 of a group hold its small components; each component of more than BLOCK elements has blocks of its own.
    """
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    draw = lambda k: F.pmod(F.xxhash64(F.lit("block"), "node"), F.greatest(k, F.lit(1))).cast("int")
    rows = cut(rows.withColumn("_s", salt(salts(rows), F.col("node"))))
    weights = rows.groupBy("pivot", "component").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("m"), F.min("tried").alias("tried"))
    large = F.col("w") > BLOCK
    plan = weights.groupBy("pivot").agg(
        F.greatest(F.lit(1), blocks(F.coalesce(F.sum(F.when(~large, F.col("w"))), F.lit(0)))).alias("small"),
        F.sort_array(F.collect_list(F.when(large, F.struct("component", blocks(F.col("w")).alias("k"))))).alias("large"),
        F.count(F.lit(1)).alias("parts"),
        F.sum("m").alias("m"),
        F.min("tried").alias("tried"),
    )
    plan = plan.where((F.col("parts") > 1) & ((F.col("m") > 2) | ~F.col("tried"))).select("pivot", "small", "large")
    start = F.struct(F.col("small").alias("end"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("k"))

    def place(s: Column, x: Column) -> Column:
        own = x["component"] == F.col("component")
        return F.struct((s["end"] + x["k"]).alias("end"), F.when(own, s["end"]).otherwise(s["first"]).alias("first"), F.when(own, x["k"]).otherwise(s["k"]).alias("k"))

    placed = rows.join(spread(rows, plan, ["pivot"]), ["pivot", "_s"]).withColumn("at", F.aggregate("large", start, place))
    first, k = F.col("at.first"), F.col("at.k")
    placed = placed.withColumn("own", F.coalesce(first + draw(k), draw(F.col("small"))))
    others = F.filter(F.sequence(F.lit(0), F.col("at.end") - 1), lambda b: first.isNull() | (b < first) | (b >= first + k))
    placed = placed.withColumn("other", F.explode(others)).select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            offsets, x = _lists(batch.column(7))
            for k, (*now, own, node, component, common) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True)):
                if now != key:
                    yield links(group)
                    key, group = now, []
                group.append((own, node, component, common, x[offsets[k] : offsets[k + 1]].copy()))
        yield links(group)

    def links(group: list[tuple]) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        if len(group) > 1:
            own, node, component, common, parts = zip(*group, strict=True)
            sizes = np.array([len(p) for p in parts])
            found = [(node[i], node[j]) for i, j in joining_links(sizes, np.array(common), np.array(own), np.array(component), list(parts), scheme)]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    dealt = placed.join(sets.select("node", "x"), "node").repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high", "own", "node")
    return dealt.select("pivot", "low", "high", "own", "node", "component", "common", "x").mapInArrow(run, "a bigint, b bigint")


def similar(texts: DataFrame, width: int, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(node, size) of all rows (node, _text), and the links (a, b) that make the components of similar sets."""
    share = min(1.0, LOOK * (scheme.den - scheme.num) / scheme.den)
    may = F.col("missing") <= F.floor(F.col("size") * F.lit(scheme.den - scheme.num) / F.lit(scheme.den))
    sizes = cut(missing(texts, width, share))
    left = sizes.where(may & (F.col("size") > 0))
    if share < 1.0:
        left = missing(pick(texts, left.select("node"), ["node"], "left_semi"), width).where(may)
    known = cut(left.select("node", "size", (F.col("size") - F.col("missing")).alias("common")))
    sets = element_sets(pick(texts, known.select("node"), ["node"], "left_semi"), width)
    sets = cut(attach(sets, known.select("node", "common"), "node"))
    lead = cut(leads(sets, scheme))
    links = cut(verify_leads(lead.select(F.col("lead").alias("pivot"), "node"), sets, scheme).distinct())
    so_far = cut(components(links))
    labelled = attach(sets, so_far, "node").select("node", "x", F.coalesce("component", "node").alias("component"))
    rows = mixed_groups(labelled, scheme).join(known, "node").join(lead, "node", "left").join(so_far, "node", "left")
    tried = (F.col("pivot") == F.col("node")) | F.col("pivot").eqNullSafe(F.col("lead"))
    rows = rows.select("pivot", "node", "size", "common", F.coalesce("component", "node").alias("component"), tried.alias("tried"))
    more = cut(verify_groups(rows, sets, scheme).distinct())
    return sizes.select("node", "size"), links.union(more)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 3, den: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, n_copies. Similar: J >= num / den on shingles of ``width`` words.

    component_id is the smallest id reachable by links, itself included; n_copies counts the rows with an equal text
    (A-Z lower-cased). Null, empty and blank texts have an empty set and are linked with nothing, not even each other.
    Rows with a null id are linked with nothing and have a null component. Rows that share an id count as one document that
    has the links of each of them. Ids must be of an integer type (others raise TypeError). Tables may be empty; extra columns are
    ignored.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be of an integer type")
    scheme = Scheme(num, den)
    slim = hidden(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    lowered = ascii_lower(F.col("_text"))
    blank = F.length(F.btrim(F.coalesce("_text", F.lit("")), F.lit(BLANKS))) == 0
    slim = slim.withColumn("_h1", F.xxhash64(F.lit(1), lowered)).withColumn("_h2", F.xxhash64(F.lit(2), lowered))
    base = cut(slim.select("_id", "_h1", "_h2", salt(salts(docs), F.col("_id")).alias("_s"), blank.alias("_blank")))
    # an id with several texts has a node for each of them, any other is its own node
    several = cut(base.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.min(F.struct("_h1", "_h2")).alias("x"), F.max(F.struct("_h1", "_h2")).alias("y")).where("x != y").select("_id"))
    mixed = not several.isEmpty()

    def with_node(rows: DataFrame) -> DataFrame:
        if not mixed:
            return rows.withColumn("node", F.col("_id"))
        marked = attach(rows, several.withColumn("_several", F.lit(True)), "_id")
        return marked.withColumn("node", F.when(F.col("_several"), F.xxhash64(F.lit("node"), "_id", "_h1", "_h2")).otherwise(F.col("_id"))).drop("_several")

    per = with_node(base).groupBy("_h1", "_h2", "_blank", "_s").agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "node"))).alias("m"), F.count(F.lit(1)).alias("n"))
    of_text = Window.partitionBy("_h1", "_h2")
    groups = per.select("_h1", "_h2", "_s", "_blank", F.min("m").over(of_text).alias("m"), F.sum("n").over(of_text).alias("n_copies"))
    groups = cut(groups.select("_h1", "_h2", "_s", "_blank", F.col("m._id").alias("first_id"), F.col("m.node").alias("node"), "n_copies"))
    rows = cut(base.drop("_blank").join(groups, ["_h1", "_h2", "_s"]).select("_id", "_h1", "_h2", "_s", "_blank", "node", "first_id", "n_copies"))
    copies = with_node(rows.withColumnRenamed("node", "first")).where(~F.col("_blank") & (F.col("node") != F.col("first"))).select("node")
    texts = pick(with_node(slim.where(F.col("_id").isNotNull() & ~blank)).select("node", "_text"), cut(copies.distinct()), ["node"], "left_anti")

    sizes, links = similar(texts, width, scheme)
    if mixed:
        ends = rows.where(F.col("_id").isNotNull() & ~F.col("_blank")).join(several, "_id", "left_semi").select("_id", "node").distinct()
        links = links.union(ends.withColumn("hub", F.min("node").over(Window.partitionBy("_id"))).select(F.col("hub").alias("a"), F.col("node").alias("b")))
    found = components(links)
    if mixed:  # a component's name is its smallest id, not its smallest node
        firsts = found.join(groups.select("node", "first_id").distinct(), "node")
        found = with_least(firsts, "component", "first_id", "least").select("node", F.col("least").alias("component"))
    known = sizes.join(found, "node", "left")
    known = groups.select("_h1", "_h2", "_s", "node", "first_id").join(known, "node", "left").select("_h1", "_h2", "_s", "size", F.coalesce("component", "first_id").alias("component"))
    out = rows.join(known, ["_h1", "_h2", "_s"])
    component = F.when(F.col("_id").isNull(), None).when(F.col("_blank"), F.col("_id")).otherwise(F.col("component"))
    n_shingles = F.when(F.col("_blank"), 0).otherwise(F.coalesce("size", F.lit(0))).cast("long")
    if mixed:  # all rows of an id are in one component
        out = out.select("_id", n_shingles.alias("n"), component.alias("c"), "n_copies")
        return out.withColumn("c", F.when(F.col("_id").isNotNull(), F.min("c").over(Window.partitionBy("_id")))).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), "n_copies")
    return out.select(F.col("_id").alias(id_col), n_shingles.alias("n_shingles"), component.alias("component_id"), "n_copies")
