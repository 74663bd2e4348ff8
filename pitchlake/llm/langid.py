"""Language ID with language-bitmask n-gram filters.

Learning: the document frequency of every letter n-gram (3 and 4 code points, a word's edges included) is counted per language
over all labelled documents. A language has an n-gram if its rate there is at least ``min_rate`` and at least ``relative`` of
its highest rate in any language; so noise such as quoted foreign lines doesn't fill the filters, and at most
(mean distinct n-grams of a document) / ``min_rate`` n-grams enter per language, whatever the size of the corpus. That bounds
what is sent to executors.

The filters of all languages share one bit-sliced array: slot i holds a mask with one bit per language. Looking up an n-gram
ands the masks of its HASHES slots, and the bits left are the languages that have it. A language's filter with a share f of
its bits set answers yes by mistake with probability f ** HASHES; popcounts are corrected for that, and the language with
the highest corrected count is the answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, give_back, hidden

SIZES = (3, 4)
HASHES = 3
#: Slots per n-gram of the array, rounded up to a power of two: few enough mistakes, and still small.
SLOTS_PER_GRAM = 16
#: Code points handled at a time, about, which bounds a worker's memory.
PART = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    if not _FOLD:
        table = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(table)
    return _FOLD[0]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all n-grams, the text that each is from, and for each text whether it has a letter.

    An n-gram has a word's edge at most at its ends.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _fold()[raw]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    owner = np.concatenate([owner[:1], owner])[: len(c)] if len(owner) < len(c) else owner
    edge = c == 0
    keep = ~edge
    keep[0] = True
    keep[1:] |= ~edge[:-1]
    c, owner, edge = c[keep].astype(np.uint64), owner[keep], edge[keep]
    letters = np.bincount(owner[~edge], minlength=len(texts)) > 0
    found, whose = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        last = len(c) - n + 1
        whole = np.ones(last, dtype=bool)
        for i in range(1, n - 1):
            whole &= ~edge[i : i + last]
        code = np.full(last, n, dtype=np.uint64)
        for i in range(n):
            code = code * np.uint64(0x100000001B3) + c[i : i + last]
        found.append(_scramble(code[whole]))
        whose.append(owner[1 : 1 + last][whole])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), letters
    return np.concatenate(found), np.concatenate(whose), letters


def _parts(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART code points; a longer text is alone."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PART:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """_lang, _gram (64-bit hash, of which 44 bits are kept), _df: in how many documents of the language the n-gram is. Row -1 counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        docs_of: dict[str, int] = {}

        def merge(lang: str) -> None:
            parts = waiting.pop(lang, []) + ([total[lang]] if lang in total else [])
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total[lang] = keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                docs_of[lang] = docs_of.get(lang, 0) + len(own)
                for a, b in _parts(own):
                    codes, whose, _ = grams(own[a:b])
                    seen = np.unique((codes >> np.uint64(20) << np.uint64(20)) | whose.astype(np.uint64))
                    keys, n = np.unique(seen >> np.uint64(20), return_counts=True)
                    waiting.setdefault(lang, []).append((keys.astype(np.int64), n.astype(np.int64)))
                    if len(waiting[lang]) >= 16:
                        merge(lang)
        for lang in sorted(docs_of):
            if lang in waiting:
                merge(lang)
            keys, n = total.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            keys, n = np.append(keys, -1), np.append(n, docs_of[lang])
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[i : i + 100_000])], names=["_lang", "_gram", "_df"])
        total.clear()
        waiting.clear()
        give_back()

    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    return rows.mapInArrow(count, "_lang string, _gram bigint, _df bigint").groupBy("_lang", "_gram").agg(F.sum("_df").alias("_df"))


@dataclass
class Filters:
    """The languages in order, their documents, the slots, and each language's rate of mistakes."""

    languages: list[str]
    documents: list[int]
    slots: np.ndarray
    mistakes: np.ndarray


def _slots(gram: np.ndarray, size: int) -> list[np.ndarray]:
    """HASHES slots of each n-gram by double hashing."""
    a = _scramble(gram * np.uint64(0xD6E8FEB86659FD93))
    b = _scramble(a + _MIX) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(20)).astype(np.int64) & (size - 1) for i in range(HASHES)]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_rate: float = 0.001, relative: float = 0.25) -> Filters:
    """Count n-grams over all documents with a language and build the filters. Rows with a null text or language are left out."""
    counts = cut(count_grams(docs, text_col, lang_col))
    known = {r._lang: r._df for r in counts.where(F.col("_gram") == -1).collect()}
    languages = sorted(known)
    if not languages:
        return Filters([], [], np.zeros((1, 1), np.uint64), np.zeros(0))
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    total = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(float(known[lang])))])
    rated = counts.where(F.col("_gram") != -1).select("_gram", number[F.col("_lang")].alias("i"), (F.col("_df") / total[F.col("_lang")]).alias("r")).where(F.col("r") >= min_rate)
    best = rated.groupBy("_gram").agg(F.max("r").alias("m"), F.collect_list(F.struct("i", "r")).alias("all"))
    chosen = best.select("_gram", F.explode(F.filter("all", lambda x: x["r"] >= relative * F.col("m"))["i"]).alias("i"))
    table = chosen.toArrow()
    gram, lang = table.column("_gram").to_numpy().astype(np.uint64), table.column("i").to_numpy().astype(np.int64)
    size = 1 << max(10, math.ceil(math.log2(max(1, len(np.unique(gram))) * SLOTS_PER_GRAM)))
    words = (len(languages) + 63) // 64
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
    slots = np.zeros((words, size), dtype=kind)
    fill = np.zeros(len(languages))
    for i in range(len(languages)):
        bits = np.zeros(size, dtype=bool)
        for at in _slots(gram[lang == i], size):
            bits[at] = True
        slots[i // 64][bits] |= kind(1 << (i % 64))
        fill[i] = bits.mean()
    return Filters(languages, [known[x] for x in languages], slots, fill**HASHES)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", own: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``own`` and lang_pred, score, of every document.

    ``score`` is the share of the answer's corrected count in the sum of the two highest. A text that is null or has no
    letter is ``und`` with score 0. A text whose n-grams are in no filter gets the language with most documents, score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    names = [f"_own{i}" for i in range(len(own))]
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)])
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(own, names, strict=True)) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        common = max(range(len(f.languages)), key=lambda i: (f.documents[i], -i), default=-1)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            answers: list[str] = []
            scores: list[float] = []
            for a, b in _parts(texts):
                codes, whose, letters = grams(texts[a:b])
                if not f.languages:
                    answers += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                gram, n = codes >> np.uint64(20), b - a
                at = _slots(gram, f.slots.shape[1])
                many = np.bincount(whose, minlength=n).astype(float)
                got = np.empty((len(f.languages), n))
                for w in range(f.slots.shape[0]):
                    mask = f.slots[w][at[0]]
                    for x in at[1:]:
                        mask = mask & f.slots[w][x]
                    for i in range(64 * w, min(64 * w + 64, len(f.languages))):
                        hits = np.bincount(whose[(mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1) > 0], minlength=n)
                        got[i] = np.maximum(0.0, (hits - many * f.mistakes[i]) / (1 - f.mistakes[i]))
                first = got.argmax(axis=0)
                ranked = np.sort(got, axis=0)
                top = ranked[-1]
                second = ranked[-2] if len(f.languages) > 1 else np.zeros(n)
                sure = np.where(top > 0, top / np.maximum(top + second, 1e-300), 0.0)
                for k in range(n):
                    answers.append(f.languages[first[k] if top[k] > 0 else common] if letters[k] else "und")
                    scores.append(float(sure[k]) if letters[k] else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(answers, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
        give_back()

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(own, names, strict=True)], "lang_pred", "score")


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo folds, is the fold. A null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, own: Sequence[str] | None = None) -> DataFrame:
    """Learn from the documents that aren't held out and have a language; predict for all: the columns ``own`` (the id), held_out, lang_pred, score.

    Null and letterless texts are ``und``. With no labelled documents every answer is ``und``. An empty table gives an
    empty result; repeated rows count each; null ids are learnt from. Extra columns are ignored unless named in ``own``;
    those called held_out, lang_pred or score are replaced.
    """
    slim = hidden(docs, list(dict.fromkeys([id_col, text_col, lang_col])))
    filters = learn(slim.where(~held_out(F.col(f"`{id_col}`"), folds, fold)), text_col, lang_col)
    own = [c for c in (own or [id_col]) if c not in ("held_out", "lang_pred", "score")]
    out = predict(docs, filters, text_col, [*own, *([] if id_col in own else [id_col])])
    return out.select(*[F.col(f"`{c}`") for c in own], held_out(F.col(f"`{id_col}`"), folds, fold).alias("held_out"), "lang_pred", "score")
