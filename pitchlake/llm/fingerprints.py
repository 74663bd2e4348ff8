"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold P[i] = sum of (c_j + 1) * B**j for j < i, modulo the prime 2**31 - 1, for two bases B. The hash of
any span follows from two entries, so equality of spans is answered at once and longest common extensions are found by
binary search. A fingerprint keeps what two texts need to be compared without the texts:

* the number of code points and the hash of the whole text;
* hashes of prefixes and of suffixes at GRID steps of a power of two, so that texts of like lengths share positions: a binary
  search over these tells how far the texts agree from either end;
* the SKETCH smallest hashes of spans of WIDTH code points, for texts that agree elsewhere.

Likeness is the larger of two shares: of the longer text that the common ends cover, and the resemblance of the sketches.

Texts meet their successor by ascending id without a second shuffle of texts: ids alone give the boundaries of blocks, each
block of texts goes to one task in order, and the first text of a block also goes to the block before. There are at most BLOCKS
boundaries, whatever the number of rows. Rows that share an id follow each other by a hash of their text, and where one id (or the null
id) has rows for several blocks, ranges of that hash are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import hidden

PRIME = (1 << 31) - 1
BASES = (1_000_003, 754_974_721 % PRIME)
GRID = 16
SKETCH = 32
WIDTH = 16
#: Code points of a text that are hashed at a time; bounds a worker's memory beside the text and its prefix arrays.
CHUNK = 1 << 16
#: Ids per block, about, and the most blocks; with more ids blocks are larger, and a task sorts (and spills) one.
BLOCK_ROWS, BLOCKS = 4096, 16384

_P = np.uint64(PRIME)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64) for _ in BASES]


def _powers(k: int, n: int) -> np.ndarray:
    """B**0 to B**(n-1), kept and doubled when more are needed."""
    have = _POWERS[k]
    while len(have) < n:
        step = pow(BASES[k], len(have), PRIME)
        have = np.concatenate([have, have * np.uint64(step) % _P])
    _POWERS[k] = have
    return have[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Prefixes:
    """The prefix arrays of a text, given as code points."""

    def __init__(self, c: np.ndarray, shared: Prefixes | None = None, n_shared: int = 0) -> None:
        """``shared``: prefix arrays of another text that agrees in its first ``n_shared`` code points."""
        self.n = len(c)
        self.sums = []
        for k in range(len(BASES)):
            sums = np.zeros(self.n + 1, np.uint64)
            if shared is not None:
                sums[: n_shared + 1] = shared.sums[k][: n_shared + 1]
            w = _powers(k, self.n)
            for a in range(n_shared, self.n, CHUNK):
                b = min(a + CHUNK, self.n)
                part = np.cumsum((c[a:b].astype(np.uint64) + np.uint64(1)) * w[a:b] % _P)
                sums[a + 1 : b + 1] = (part + sums[a]) % _P
            self.sums.append(sums)

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of code points i to j - 1, the same wherever the span stands."""
        return tuple(int((int(s[j]) - int(s[i])) % PRIME * pow(BASES[k], -i, PRIME) % PRIME) for k, s in enumerate(self.sums))

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of the width, 62 bits."""
        m = self.n - width + 1
        if m < 1:
            return np.zeros(0, np.uint64)
        out = None
        for k, s in enumerate(self.sums):
            h = (s[width:] + _P - s[:m]) % _P * _powers(k, m)[::-1] % _P
            h = h * np.uint64(pow(BASES[k], -(m - 1), PRIME)) % _P
            out = h if out is None else out << np.uint64(31) | h
        return out


def equal_spans(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether a[i:i+length] equals b[j:j+length], but for a chance of about 2**-62."""
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The length of the longest span that starts at i in a and at j in b, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if equal_spans(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _step(n: int) -> int:
    """The grid step of a text: the smallest power of two that covers it in GRID steps."""
    return 1 << max(0, (max(n, 1) - 1).bit_length() - (GRID.bit_length() - 1))


def _fold(h: tuple[int, ...]) -> int:
    return (h[0] << 31 | h[1]) * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF


def fingerprint(p: Prefixes) -> str:
    """n, whole hash, prefix and suffix hashes along the grid, sketch: hexadecimal, joined by colons."""
    step, n = _step(p.n), p.n
    whole = p.span(0, n)
    ends = range(step, n + 1, step)
    heads = "".join(f"{_fold(p.span(0, e)):08x}" for e in ends)
    tails = "".join(f"{_fold(p.span(n - e, n)):08x}" for e in ends)
    h = p.spans(WIDTH)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    if len(h) > 8 * SKETCH:
        # the smallest distinct values are among the smallest values; repeats may need more of them
        k = 8 * SKETCH
        small = np.unique(np.partition(h, k)[: k + 1])
        h = small if len(small) >= SKETCH else np.unique(h)
    else:
        h = np.unique(h)
    sketch = "".join(f"{x:08x}" for x in h[:SKETCH].tolist())
    return f"{n:x}:{whole[0]:08x}{whole[1]:08x}:{heads}:{tails}:{sketch}"


def _eights(s: str) -> list[str]:
    return [s[i : i + 8] for i in range(0, len(s), 8)]


def likeness(x: str, y: str) -> float:
    """From 0 to 1, by the fingerprints alone. Equal texts: 1. An empty text is like no other."""
    (nx, wx, hx, tx, sx), (ny, wy, hy, ty, sy) = x.split(":"), y.split(":")
    if (nx, wx) == (ny, wy):
        return 1.0
    n, m = int(nx, 16), int(ny, 16)
    if not n or not m:
        return 0.0
    a, b = _step(n), _step(m)
    step = max(a, b)

    def agree(p: str, q: str) -> int:
        p_, q_ = _eights(p)[step // a - 1 :: step // a], _eights(q)[step // b - 1 :: step // b]
        low, high = 0, min(len(p_), len(q_))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if p_[mid - 1] == q_[mid - 1] else (low, mid - 1)
        return low * step

    ends = min(agree(hx, hy) + agree(tx, ty), min(n, m)) / max(n, m)
    u, v = set(_eights(sx)), set(_eights(sy))
    least = sorted(u | v)[:SKETCH]
    alike = sum(z in u and z in v for z in least) / len(least) if least else 0.0
    return min(1.0, max(ends, alike))


class Blocks:
    """Ranges of (id, hash): each bound ends a block, and a bound that stands several times has as many blocks of its own."""

    def __init__(self, bounds: Sequence[int]) -> None:
        self.bounds, times = np.unique(np.array(bounds, dtype=np.int64), return_counts=True)
        self.own = np.where(times > 1, times, 0)
        self.start = np.concatenate([[0], np.cumsum(1 + self.own)])

    def __call__(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.bounds, key, side="left")
        own = np.append(self.own, 0)[i] * (np.append(self.bounds, 0)[i] == key)
        share = (h.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 1e-9)
        return (self.start[i] + np.where(own > 0, 1 + (share * own).astype(np.int64), 0)).astype(np.int32)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """_block, _guest, _id, _text: blocks of consecutive ids; each block's first text is also the guest of the block before (of the last block, for the first)."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(2**63))).alias("_key")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = hidden(docs, [id_col, text_col]).select(key, F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h"))
    ids = hidden(docs, [id_col]).select(key)
    n = ids.count()
    k = max(1, min(BLOCKS, -(-n // block_rows)))
    cuts = ids.agg(F.percentile_approx("_key", [i / k for i in range(1, k)], 10 * k).alias("c")).first().c if k > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast(Blocks(cuts or []))

    @F.pandas_udf("int")
    def block_of(key: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shared.value(key.to_numpy(), h.to_numpy()))

    # at most two rows for each bound come to the driver
    first = slim.groupBy(block_of("_key", "_h").alias("_block")).agg(F.min(F.struct("_key", "_h")).alias("f")).select("_block", "f._key", "f._h").toArrow()
    order = sorted(zip(*[first.column(c).to_pylist() for c in range(3)], strict=True))
    heads = sorted((key, h, order[i - 1][0]) for i, (_, key, h) in enumerate(order))  # the first's guest goes to the last
    at, hashes, befores = (np.array(c, dtype=np.int64) for c in zip(*heads, strict=True)) if heads else (np.zeros(0, np.int64),) * 3
    guests = docs.sparkSession.sparkContext.broadcast((pd.MultiIndex.from_arrays([at, hashes]), befores.astype(np.int32)))

    @F.pandas_udf("int")
    def guest_of(key: pd.Series, h: pd.Series) -> pd.Series:
        heads, before = guests.value
        i = heads.get_indexer(pd.MultiIndex.from_arrays([key, h])) if len(heads) else np.full(len(key), -1)
        return pd.Series(np.append(before, 0)[i], dtype="Int32").where(i >= 0, None)

    own = F.struct(block_of("_key", "_h").alias("_block"), F.lit(False).alias("_guest"))
    other = F.struct(guest_of("_key", "_h").alias("_block"), F.lit(True).alias("_guest"))
    dealt = slim.withColumn("_own", own).withColumn("_other", other)
    dealt = dealt.select("_key", "_h", "_id", "_text", F.explode(F.when(F.col("_other._block").isNull(), F.array("_own")).otherwise(F.array("_own", "_other"))).alias("_to"))
    dealt = dealt.select(F.col("_to._block").alias("_block"), F.col("_to._guest").alias("_guest"), "_key", "_h", "_id", "_text")
    return dealt.repartition("_block").sortWithinPartitions("_block", "_guest", "_key", "_h", "_text").select("_block", "_guest", "_id", "_text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = 0.25, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix.

    The edited text: the last floor(n_chars * tail) code points replaced by the first as many (or all) of the next document by
    ascending id, after the last the first. ``common_prefix`` is the longest common prefix with the next document.

    Null texts count as empty; their fingerprints equal each other and are like no other text's. Null ids come first.
    Rows that share an id follow each other by a hash of the text; a table of one row is its own successor. Ids must be of an integer
    type (others raise TypeError). An empty table gives an empty result. Extra columns are ignored.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be of an integer type")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list[tuple] = []
        block, waiting = None, None

        def prepare(text: str) -> tuple:
            p = Prefixes(points(text))
            return text, p, fingerprint(p)

        def compare(now: tuple, after: tuple) -> tuple:
            (text, p, own), (text2, p2, next_) = now, after
            k = int(p.n * tail)
            stay = p.n - k
            edited = text[:stay] + text2[:k]
            changed = own if edited == text else fingerprint(Prefixes(points(edited), p, stay))
            return p.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_), common_extension(p, 0, p2, 0)

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[id_col, *names])

        for batch in batches:
            id_type = batch.column(2).type
            for b, guest, doc, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if b != block:
                    block, waiting, met = b, None, False
                if guest and met:  # only the first guest in order is the successor
                    continue
                met = guest
                ready = prepare(text)
                if waiting is not None:
                    ids.append(waiting[0])
                    rows.append(compare(waiting[1], ready))
                waiting = (doc, ready)
                if len(rows) >= 1024:
                    yield table()
                    ids, rows = [], []
        if rows:
            yield table()

    return in_blocks(docs, id_col, text_col, block_rows).mapInArrow(run, schema)
