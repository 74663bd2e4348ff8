"""Toxicity by maximum-scoring segments of token log-odds.

Learning. Words of all labelled documents are counted per class; a word's log-odds between the classes is taken with an
informative Dirichlet prior, whose pseudo-counts are proportional to the word's frequency in the whole corpus. A document
counts a word once, so that repetition within one document teaches nothing. Words that are too rare in toxic documents, or
whose likelihood ratio between the classes is not significant among all candidates (``min_ratio`` plus twice the logarithm
of their number), share one score, the log-ratio of the mass that the other words leave. The rate bound ``min_rate`` limits
the number of words with scores of their own to (mean distinct words of a toxic document) / ``min_rate``, whatever the size
of the corpus.

Scoring. Because scores are log-odds of the two classes' word distributions, the sum over a stretch of clean text drifts down
and the scale parameter of the extreme-value law of its best segment is 1. A linear scan (Ruzzo and Tompa) lists all
maximal segments. A segment of score S among n words has the normalised score S - ln n, and by the Gumbel law with location and
scale fitted to the clean documents' best segments a p-value; segments with p < ``alpha`` are the significant passages.
The document's evidence is -ln p of its r best segments together, for the best r (``evidence``); it becomes a probability by
monotone calibration on labelled documents, each scored by words that were learnt without it.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, hidden

EULER = 0.5772156649015329
#: Distinct words that a worker counts before it hands them on, which bounds its memory.
FLUSH = 200_000
#: Up to so many labelled ids are broadcast to pick the labelled texts (12 bytes each); beyond, texts are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Steps of evidence in the calibration table, and the evidence from which on all is one step.
STEPS, MOST = 400, 60.0

#: A-Z become a-z; a-z and all bytes of non-ASCII characters stay; every other ASCII character separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def _binary(batch: pa.RecordBatch, i: int) -> list[bytes | None]:
    return batch.column(i).cast(pa.binary()).to_pylist()


def count_words(docs: DataFrame, text_col: str, kind_col: str, kinds: int, only: frozenset[bytes] | None = None) -> DataFrame:
    """word (binary), n0, n1, ...: in how many documents of each kind it is. The empty word has the sums over all words, and in d0, d1, ... the numbers of documents."""
    names = [f"n{k}" for k in range(kinds)] + [f"d{k}" for k in range(kinds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[bytes]] = [Counter() for _ in range(kinds)]
        docs_of = [0] * kinds

        def flush() -> pa.RecordBatch:
            words = list(set().union(*seen))
            data = [pa.array(words, pa.binary()), *[pa.array([c[w] for w in words], pa.int64()) for c in seen], *[pa.array([0 if w else n for w in words], pa.int64()) for n in docs_of]]
            for c in seen:
                c.clear()
            docs_of[:] = [0] * kinds
            return pa.RecordBatch.from_arrays(data, names=["word", *names])

        for batch in batches:
            for text, kind in zip(_binary(batch, 0), batch.column(1).to_pylist(), strict=True):
                words = set(words_of(text))
                seen[kind][b""] += len(words)
                docs_of[kind] += 1
                seen[kind].update(words if only is None else words & only)
                if sum(map(len, seen)) > FLUSH:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{kind_col}`").cast("int").alias("k"))
    return rows.mapInArrow(count, "word binary, " + ", ".join(f"{n} bigint" for n in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def likelihood_ratio(k1: int, d1: int, k0: int, d0: int) -> float:
    """G squared of a word that is in k1 of d1 and k0 of d0 documents."""

    def part(k: int, d: int, p: float) -> float:
        return sum(x * math.log(x / (d * q)) for x, q in ((k, p), (d - k, 1 - p)) if x > 0)

    p = (k1 + k0) / (d1 + d0)
    return 2 * (part(k1, d1, p) + part(k0, d0, p)) if 0 < p < 1 else 0.0


#: Word scores and the score of all other words.
Model = tuple[dict[bytes, float], float]


def learn_scores(docs: DataFrame, labelled: DataFrame, text_col: str, flag_col: str, half_col: str, prior: float, min_ratio: float, min_rate: float) -> list[Model]:
    """The models learnt from all labelled rows (flag 0 or 1), from those of half 0 and from those of half 1; the prior is from all documents.

    A model is empty if its rows lack one of the two labels.
    """
    kinds = labelled.select(F.col(text_col), (2 * F.col(half_col) + F.col(flag_col)).alias("_kind"))
    counts = cut(count_words(kinds, text_col, "_kind", 4))
    total = counts.where(F.col("word") == F.lit(b"")).first()
    if total is None:
        return [({}, 0.0)] * 3
    parts = ((0, 1), (0,), (1,))
    sums = [[(sum(total[f"{c}{2 * h + flag}"] for h in part)) for c in "nd" for flag in (0, 1)] for part in parts]
    usable = [n0 > 0 and n1 > 0 for n0, n1, _, _ in sums]

    def of(part: Sequence[int], flag: int) -> Column:
        return sum((F.col(f"n{2 * h + flag}") for h in part), F.lit(0))

    def likely(part: Sequence[int], d0: int, d1: int) -> Column:
        return (of(part, 1) >= max(3.0, min_rate * d1)) & (of(part, 1) / d1 > of(part, 0) / d0)

    wanted = [likely(part, d0, d1) for part, (_, _, d0, d1), use in zip(parts, sums, usable, strict=True) if use]
    if not wanted:
        return [({}, 0.0)] * 3
    rows = counts.where((F.col("word") != F.lit(b"")) & functools.reduce(Column.__or__, wanted)).toArrow().to_pylist()
    found = []
    for part, (_, _, d0, d1), use in zip(parts, sums, usable, strict=True):
        own = [(r["word"], sum(r[f"n{2 * h}"] for h in part), sum(r[f"n{2 * h + 1}"] for h in part)) for r in rows] if use else []
        own = [x for x in own if x[2] >= max(3.0, min_rate * d1) and x[2] / d1 > x[1] / d0]
        least = min_ratio + 2 * math.log(max(1, len(own)))
        found.append([x for x in own if likelihood_ratio(x[2], d1, x[1], d0) >= least])
    only = frozenset(x[0] for own in found for x in own)
    spread = count_words(docs.select(F.col(f"`{text_col}`"), F.lit(0).alias("_kind")), text_col, "_kind", 1, only).toArrow()
    corpus = dict(zip(spread.column("word").to_pylist(), spread.column("n0").to_pylist(), strict=True))
    return [score_words(own, n0, n1, corpus, prior) for own, (n0, n1, _, _) in zip(found, sums, strict=True)]


def score_words(found: Sequence[tuple[bytes, int, int]], n0: int, n1: int, corpus: Mapping[bytes, int], prior: float) -> Model:
    """Log-odds with the prior of words (word, clean count, toxic count) where the classes have n0 and n1 words; only positive ones are kept."""
    everything = max(1, corpus.get(b"", 0))
    scores: dict[bytes, float] = {}
    left0 = left1 = 1.0
    for w, y0, y1 in found:
        a = prior * corpus[w] / everything
        odds = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        if odds > 0:
            scores[w] = odds
            left0 -= (y0 + a) / (n0 + prior)
            left1 -= (y1 + a) / (n1 + prior)
    other = math.log(max(left1, 1e-9) / max(left0, 1e-9)) if scores else 0.0
    return scores, min(other, -1e-4)


def segments(events: Sequence[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of n words, where ``events`` lists place and score of the words with scores of their own and every other word scores ``other`` < 0.

    Linear in the number of events: words between events only lower the running sum, and a run whose links were passed over once isn't
    looked at again. Where no earlier run began lower, all earlier ones are final.
    """
    runs: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, the last run before it that began lower
    total, at = 0.0, 0
    for place, score in events:
        total += other * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        left, right, first, last = before, total, place, place
        j = len(runs) - 1
        while True:
            while j >= 0 and runs[j][0] >= left:
                j = runs[j][4]
            if j < 0 or runs[j][1] >= right:
                runs.append((left, right, first, last, j))
                break
            left, _, first, _, link = runs[j]
            del runs[j:]
            j = link
    return [(first, last, right - left) for left, right, first, last, _ in runs]


def scan(docs: DataFrame, models: Sequence[Model], own: Sequence[str], text_col: str, model: Column) -> DataFrame:
    """The columns ``own``, n_words, best (score of the best segment, 0 without one), passages (first, last, score), by the model of the number ``model``."""
    shared = docs.sparkSession.sparkContext.broadcast(list(models))
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, bests, ends, lists = [], [], [0], []
            for text, k in zip(_binary(batch, 0), batch.column(1).to_pylist(), strict=True):
                known, other = shared.value[k]
                words = words_of(text)
                found = []
                if not known.keys().isdisjoint(words):
                    found = segments([(i, known[w]) for i, w in compress(enumerate(words), map(known.__contains__, words))], len(words), other)
                lengths.append(len(words))
                bests.append(max((s for _, _, s in found), default=0.0))
                lists += found
                ends.append(len(lists))
            parts = [pa.array([x[i] for x in lists], f.type) for i, f in enumerate(passage)]
            passages = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(passage)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(lengths, pa.int64()), pa.array(bests, pa.float64()), passages], names=[*own, "n_words", "best", "passages"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + ", n_words bigint, best double, passages array<struct<first:bigint,last:bigint,score:double>>"
    return docs.select(F.col(f"`{text_col}`").alias("_text"), model.alias("_model"), *[F.col(f"`{c}`") for c in own]).mapInArrow(run, schema)


def evidence(location: float, scale: float) -> Column:
    """-ln p of the passages of a document (n_words, best, passages), 0 without any: of the r best together, for the r that gives most.

    The best alone follows the Gumbel law. The sum t of the normalised scores of the r best has p = exp(-t) t^(r-1) / (r! (r-1)!), and each
    further one costs a factor of two for the choice of r. Only passages above the location count beyond the first.
    """
    normal = lambda x: (x - F.log("n_words") - location) / scale
    y = F.reverse(F.array_sort(F.filter(F.transform("passages", lambda x: normal(x["score"])), lambda x: x > 0)))
    first = F.greatest(normal(F.col("best")), F.lit(-700.0))
    alone = F.when(first > 27, first).otherwise(-F.log(-F.expm1(-F.exp(-first))))

    def add(s: Column, x: Column) -> Column:
        r, t = s["r"] + 1, s["t"] + x
        logs = s["logs"] + F.log(r) + F.log(F.greatest(s["r"], F.lit(1.0)))
        both = t - s["r"] * F.log(F.greatest(t, F.lit(1.0))) + logs - s["r"] * math.log(2)
        counts = (x > 0) & (t > r)
        most = F.when(s["r"] == 0, alone).when(counts, F.greatest(s["most"], both)).otherwise(s["most"])
        return F.struct(r.alias("r"), t.alias("t"), logs.alias("logs"), most.alias("most"))

    start = F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("t"), F.lit(0.0).alias("logs"), F.lit(0.0).alias("most"))
    found = F.aggregate(y, start, add, lambda s: s["most"])
    return F.when(F.size("passages") > 0, F.greatest(alone, found, F.lit(0.0))).otherwise(0.0)


def monotone(counts: Sequence[tuple[int, int, int]], steps: int) -> list[float]:
    """Probability per step from (step, n, n1): pooled so that it never falls as evidence rises, half a document of either class added."""
    pools: list[list[float]] = []  # first step, n, n1
    for step, n, n1 in sorted(counts):
        pools.append([step, n, n1])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n_, n1_ = pools.pop()
            pools[-1][1] += n_
            pools[-1][2] += n1_
    out = [0.0] * steps
    for (first, n, n1), nxt in zip(pools, [*[p[0] for p in pools[1:]], steps], strict=True):
        for i in range(int(first), int(nxt)):
            out[i] = (n1 + 0.5) / (n + 1)
    return out


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo folds, is the fold. A null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def half(id_col: Column) -> Column:
    """0 or 1, by a hash of the id that is independent of the folds."""
    return F.pmod(F.xxhash64(F.lit("half"), id_col.cast("string")), F.lit(2)).cast("int")


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    fold: int = 0,
    prior: float = 1000.0,
    min_ratio: float = 8.0,
    min_rate: float = 0.001,
    alpha: float = 0.01,
) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted, n_words, best, evidence, passages (first, last word, score, p_value).

    Labels other than 0 and 1, of held-out rows, or with a null id are not learnt from; a document with labels of both kinds
    counts as toxic. With too few labels to learn from every score is 0. Null and empty texts have no segment and get
    the score of documents without evidence. Repeated rows are scored each; an empty table gives an empty result.
    Extra columns are ignored.

    Law and calibration are fitted to labelled documents scored by the words of the other half of the labelled documents, so that no
    document calibrates words that were chosen on it. Where a half has too few labels to learn from, all are scored by the words of all.
    """
    slim = hidden(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    flags = hidden(labels, [id_col, label_col]).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_flag"))
    flags = flags.where(F.col("_id").isNotNull() & F.col("_flag").isin(0, 1) & ~held_out(F.col("_id"), folds, fold)).groupBy("_id").agg(F.max("_flag").alias("_flag"))
    flags = cut(flags.withColumn("_half", half(F.col("_id"))))
    labelled = slim.join(F.broadcast(flags) if flags.count() <= BROADCAST_LABELS else flags, "_id")
    models = learn_scores(slim, labelled, "_text", "_flag", "_half", prior, min_ratio, min_rate)
    crossed = all(known for known, _ in models)
    scanned = cut(scan(slim, models, ["_id"], "_text", F.lit(0)))
    if crossed:
        learnt = cut(scan(labelled, models, ["_flag"], "_text", 2 - F.col("_half")))
    else:
        learnt = scanned.join(flags, "_id").select("_flag", "n_words", "best", "passages")
    clean = learnt.where((F.col("_flag") == 0) & (F.col("best") > 0)).select((F.col("best") - F.log("n_words")).alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count("x").alias("n")).first()
    scale = max(1.0, (clean.s or 0.0) * math.sqrt(6) / math.pi) if clean.n >= 20 else 1.0
    location = clean.m - EULER * scale if clean.n >= 20 else 0.0
    e = evidence(location, scale)
    step = F.when(F.col("best") <= 0, 0).otherwise(F.least(1 + F.floor(F.col("evidence") / MOST * (STEPS - 1)), F.lit(STEPS - 1))).cast("int")
    learnt = learnt.withColumn("evidence", e)
    counts = [(r.k, r.n, r.n1) for r in learnt.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("_flag").alias("n1")).collect()]
    table = monotone(counts, STEPS) if counts and models[0][0] else [0.0] * STEPS
    scanned = scanned.withColumn("evidence", e)
    # inside a step of equal probability a document with more evidence still ranks higher
    raw = F.element_at(F.array(*[F.lit(p) for p in table]), step + 1)
    more = F.col("evidence") / (F.col("evidence") + MOST)
    score = raw + F.when(raw < 0.5, F.least(F.lit(0.499) - raw, F.lit(0.001))).otherwise(F.least(F.lit(1.0) - raw, F.lit(0.001))) * more
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    p_value = lambda s: -F.expm1(-F.exp(-(s - F.log("n_words") - location) / scale))
    passages = F.filter(F.transform("passages", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["score"].alias("score"), p_value(x["score"]).alias("p_value"))), lambda x: x["p_value"] < alpha)
    out = scanned.select(F.col("_id").alias(id_col), held_out(F.col("_id"), folds, fold).alias("held_out"), score.alias("score"), "n_words", "best", "evidence", passages.alias("passages"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
