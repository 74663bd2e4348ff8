"""The corpus pipeline, stage by stage, against plain loops on small tables."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm.langid import identify_languages

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that operators add or use under these names.
CLASHES = ("n_lines", "size", "target", "copies", "taken", "score", "lang_pred", "_id", "_k1", "_gone", "node", "component_id", "_copy")


@pytest.fixture(scope="module")
def docs(spark):
    """All documents of the smallest table, and odd rows: nulls, empty texts, repeated rows, a very long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("doc_id = 5").first()
    odd = [(90001, "123 ...", "en", "src0", 7), (90002, None, None, None, None), (90003, "", "fr", None, 0), (None, one.text, one.lang, one.source, one.n_chars), (None, one.text, one.lang, one.source, one.n_chars)]
    odd += [(5, one.text, one.lang, one.source, one.n_chars), (None, "alone and with no id " * 3, None, None, 60), (None, "alone and with no id " * 3, "en", None, 60), (90004, "very long " * 30000, "en", "src1", 300000), (90005, " \n\t ", "de", "src2", 4)]
    odd += [(90006, "one text of an id of which this " * 2, None, "src0", 1), (90006, "another text of that same id, quite unlike it " * 2, None, "src0", 1)]
    table = docs.union(spark.createDataFrame(odd, docs.schema))
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).persist()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def rows_of(df):
    return sorted(map(repr, df.select("doc_id", "text", "lang", "source").collect()))


def test_language_stage(spark, docs):
    got = corpus_pipeline.keep_known_languages(spark, docs, SF)
    rows = [r.asDict() for r in identify_languages(docs.select("doc_id", "text", "lang", "source"), own=["doc_id", "text", "lang", "source"]).collect()]
    sure = {}
    for lang in {r["lang_pred"] for r in rows}:
        scores = sorted(int(r["score"] * 1000) for r in rows if r["lang"] == r["lang_pred"] == lang)
        if scores:
            sure[lang] = next(x for k, x in enumerate(scores) if k + 1 >= 0.01 * len(scores)) / 1000
    gone = [r for r in rows if r["lang_pred"] == "und" or (r["lang"] not in (None, r["lang_pred"]) and r["score"] >= sure.get(r["lang_pred"], 2))]
    assert {90001, 90002, 90003, 90005} <= {r["doc_id"] for r in gone}
    kept = [r for r in rows if r not in gone]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(r["doc_id"]), r["text"]) for r in kept)
    assert got.columns == docs.columns and got.where("score <> 'own score'").count() == 0


def test_line_stage(spark, docs):
    got = corpus_pipeline.drop_common_lines(spark, docs, SF)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    texts, seen = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()], {}
    for _, t in texts:
        for k in {key(x) for x in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    expected = [(str(i), "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)) for i, t in texts]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(expected)
    assert got.columns == docs.columns and got.where((F.col("n_lines") != "own n_lines") | (F.length("text") != F.col("n_chars"))).count() == 0


def test_near_duplicate_stage(spark, docs):
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    rows = docs.select("doc_id", "text").collect()
    # documents: an id with all its texts, or a text without an id; the latter come last
    keys = [(0, r.doc_id, "") if r.doc_id is not None else (1, 0, r.text) for r in rows]
    sets = {}
    for k, r in zip(keys, rows, strict=True):
        sets.setdefault(k, []).append(shingles(r.text))
    group = {k: k for k in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if any(x and y and 4 * len(x & y) >= 3 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                group[y] = x
    stay = [k for k in order if find(k) == k]
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text if r.doc_id is None else "") for r in got.collect())
    assert found == sorted((k[0] == 1, k[1], k[2]) for k in stay)
    assert 5 in [r.doc_id for r in got.collect()] and len(stay) < len(order)
    assert rows_of(got) == rows_of(corpus_pipeline.drop_near_duplicates(spark, docs.repartition(7), SF))


def test_mixing_stage(spark, docs):
    got = corpus_pipeline.mix(spark, docs, SF)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, largest = {}, {}, {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + words(r.text)
        largest[r.source] = max(largest.get(r.source, 0), words(r.text))
    for r in got.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(size.values())
    while len(target) < len(order):
        open_ = [s for s in order if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * size[s]]
        target |= {s: 2 * size[s] for s in full} if full else {s: weight[s] * level for s in open_}
    for s in order:
        assert abs(taken.get(s, 0) - target[s]) <= max(1, largest[s] / 2)
    times = {}
    for r in got.collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    rows = {}
    for r in docs.collect():
        rows[r.doc_id, r.text] = rows.get((r.doc_id, r.text), 0) + 1
    assert all(n <= 2 * rows[k] for k, n in times.items()) and got.columns == docs.columns


def test_packing_stage(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    few = docs.where("doc_id < 40 OR doc_id > 90000 OR doc_id IS NULL").select("doc_id", "text", "lang", "source")
    got = corpus_pipeline.pack(spark, few, SF).collect()
    expected = []
    for r in few.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        start = 0
        while start < len(ids):
            length = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            expected.append((str(r.doc_id), start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), 0))
            start += length
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got) == sorted(expected)
    assert len({r.sequence_id for r in got}) == len(got)


def test_empty(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_ties_and_repeats(spark, docs):
    """Many rows of one id and text, and many of one text without ids: one of each stays, and copies beyond the mix don't appear."""
    rng = random.Random(1)
    rows = [(1, "the same row again and again " * 4, "en", "a", 1)] * 30 + [(None, "no id but the same words " * 4, "en", "a", 1)] * 30
    rows += [(i, " ".join(rng.choice("bcdfgh") + str(rng.randrange(99)) for _ in range(30)), "en", "a", 1) for i in range(2, 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, table, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["None", *map(str, range(1, 30))])


def test_run(spark):
    """The stages one after the other: what each keeps is what the next one reads."""
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("length & (length - 1) != 0").count() == 0


def test_mislabelled_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = F.create_map(*[F.lit(x) for x in ("en", "fr", "fr", "en", "de", "es", "es", "de")])[F.col("lang")]
    wrong = docs.where("doc_id % 8 = 3 AND n_chars >= 200").select((F.col("doc_id") + 90000).alias("doc_id"), "text", other.alias("lang"), "source", "n_chars")
    left = corpus_pipeline.keep_known_languages(spark, docs.union(wrong), SF).select("doc_id").toPandas().doc_id
    assert wrong.count() >= 15 and (left > 90000).sum() == 0
    assert (left < 90000).sum() == docs.count()
