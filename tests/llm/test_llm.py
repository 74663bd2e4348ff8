"""Training-data operators against brute force, exact round trips and SQL."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import fingerprints as fp
from pitchlake.llm import jaccard_join, licenses, mixing, packing, queries, toxicity, warc
from pitchlake.llm.components import components
from pitchlake.llm.exact_dedup import exact_dedup
from pitchlake.llm.langid import identify_languages
from pitchlake.llm.line_dedup import line_dedup

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, extra=False):
    """Documents from (id, text) or (id, text, lang, source); with extra columns whose names clash with what operators add."""
    full = [(i, t, *(more or (None, None)), None if t is None else len(t)) for i, t, *more in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("keep_id", "size", "n_lines", "score", "node", "a", "sig", "word")}) if extra else df


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "Ab c"), (4, "Ab c"), (5, "aB C"), (None, "ab c"), (None, None), (6, "é ü\x00  \U0001f600"), (7, "word " * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD, extra=True).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).persist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(names)
    assert sorted(df.columns) == order
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in order) for r in found.fetchall())))


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup(odd, keep="max").collect()
    assert len(got) == len(ODD)
    by = {}
    for i, t in ODD:
        by.setdefault((t or "").translate(LOW), []).append(i)
    assert sorted((r.group_size, str(r.keep_id)) for r in got) == sorted((len(v), str(max((x for x in v if x is not None), default=None))) for v in by.values() for _ in v)
    weak = exact_dedup(odd, keep="max", content_hash=lambda c: F.lit("same"))
    assert sorted(map(repr, weak.collect())) == sorted(map(repr, got))
    assert exact_dedup(empty).count() == 0


def test_line_dedup(spark, odd, empty):
    assert line_dedup(odd).count() == len(ODD) and line_dedup(empty).count() == 0
    rng = random.Random(1)
    lines = ["A b", " a B\t", "", "x", "y z", "\x0bq"]
    texts = [None if rng.random() < 0.05 else "\n".join(rng.choice(lines) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(6))) for _ in range(80)]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = {}
    for t in texts:
        for k in {key(s) for s in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    got = {r.doc_id: r for r in line_dedup(table(spark, list(enumerate(texts))), min_docs=10).collect()}
    for i, t in enumerate(texts):
        kept = [s for s in (t or "").split("\n") if not (key(s) and seen[key(s)] >= 10)]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept))


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for m, (i, a) in enumerate(sets):
        for j, b in sets[m + 1 :]:
            if a and b and 4 * len(a & b) >= 3 * len(a | b) and find(i) != find(j):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize(("block", "flush"), [(1 << 20, 1 << 20), (400, 500)])
def test_jaccard_by_brute_force(spark, monkeypatch, block, flush):
    """Copies, near copies, a cloud about the threshold, and a passage that many share; blocks and buffers small and large."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FLUSH", flush)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 6, 9, 30, 60, 120, 300)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(90):
        w = list(rng.choice(bases)) if rng.random() < 0.75 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))] + passage
        for _ in range(rng.choice([0, 0, 1, 2, 3, len(w) // 20])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, (" " if rng.random() < 0.8 else "\t").join(w)))
    for i in range(90, 160):
        w = list(bases[5])
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(table(spark, rows)).collect()}
    expected = brute_components(rows)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < 100 and len({expected[i] for i in range(90, 160)}) > 3
    assert all(got[i].n_shingles == len(shingle_set(t)) for i, t in rows)


def test_jaccard_on_documents(spark):
    """All 1,000 documents of sf0.01 against brute force: no link is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: shingle_set(t) for i, t in rows}
    meet = {}
    for i, x in sets.items():
        for e in x:
            meet.setdefault(e, []).append(i)
    pairs = {(a, b) for v in meet.values() for k, a in enumerate(v) for b in v[k + 1 :]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: (find(i), len(sets[i])) for i in sets}


def test_jaccard_shared_ids(spark):
    """Rows that share an id have the links of each of their texts; the long one doesn't hide the short one's."""
    words = [f"w{i}" for i in range(1200)]
    rows = [(5, " ".join(words[:14])), (5, " ".join(words[100:1100])), (7, " ".join(words[:14]) + " z"), (9, " ".join(words[100:1098])), (8, " ".join(words[:14])), (3, "alone here"), (5, None), (None, " ".join(words[:14]))]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.n_copies) for r in jaccard_join.jaccard_components(table(spark, rows)).collect())
    assert got == [(0, 0, 10, 3), (3, 3, 1, 1), (5, 5, 0, 1), (5, 5, 10, 3), (5, 5, 996, 1), (7, 5, 11, 1), (8, 5, 10, 3), (9, 5, 994, 1)]
    with pytest.raises(TypeError):
        jaccard_join.jaccard_components(table(spark, rows).withColumn("doc_id", F.lit("x")))


def test_jaccard_odd(spark, odd, empty):
    got = jaccard_join.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[4] == {(1, 4)} and by[5] == {(1, 4)} and {c for _, c in by[None]} == {None}
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_signatures_meet():
    """Similar sets share at least one signature, whatever their sizes."""
    rng = np.random.default_rng(3)
    scheme, tried = jaccard_join.Scheme(3, 4), 0
    for _ in range(3000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.3 else int(rng.integers(1, 40))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        keep = x[rng.permutation(len(x))[: max(1, int(np.ceil(len(x) * rng.uniform(0.75, 1))))]]
        y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, len(x) // 8 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 4 * both >= 3 * (len(x) + len(y) - both):
            tried += 1
            assert len(np.intersect1d(scheme.sign(x), scheme.sign(y))) > 0
    assert tried > 1000


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_segments_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 40)
        special = {i: rng.uniform(-1, 3) for i in range(n) if rng.random() < 0.3}
        s = [special.get(i, -0.2) for i in range(n)]
        found = toxicity.segments(sorted(special.items()), n, -0.2)
        best = max((sum(s[a : b + 1]) for a in range(n) for b in range(a, n)), default=0)
        if best > 0:
            assert max(x[2] for x in found) == pytest.approx(best)
        for a, b, score in found:
            assert score == pytest.approx(sum(s[a : b + 1])) and score > 0
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_all_segments_in_linear_time():
    """Those that cutting out the best stretch again and again gives; and 10,000 words in drifting text without comparing all pairs."""

    def parts(s, a, b):
        score, first, last = max(((sum(s[i : j + 1]), i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
        return [] if score <= 0 else [*parts(s, a, first), (first, last), *parts(s, last + 1, b)]

    rng = random.Random(5)
    for _ in range(60):
        n, other = rng.randrange(1, 45), -rng.uniform(0.05, 1)
        special = {i: rng.uniform(-1, 3) for i in range(n) if rng.random() < 0.6}
        assert [x[:2] for x in toxicity.segments(sorted(special.items()), n, other)] == parts([special.get(i, other) for i in range(n)], 0, n)
    began = time.process_time()
    assert len(toxicity.segments([(5 * i, 0.5 + 0.001 * (i % 7)) for i in range(10_000)], 50_000, -0.5)) == 10_000
    assert time.process_time() - began < 2


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    clean = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(40)] = w[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) and 0 <= got[i].score <= 1 for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert toxicity.score_toxicity(odd, labels.limit(0)).where("score = 0").count() == len(ODD)
    assert toxicity.score_toxicity(empty, labels).count() == 0


def brute_toxicity(texts, labels, min_rate=0.001):
    """All of score_toxicity, by plain loops: scores, evidence and passages of each text; labels: text number to (flag, half)."""
    import math

    words = [re.findall("[a-z\\x80-\\U0010ffff]+", (t or "").translate(LOW)) for t in texts]

    def learn(rows):
        df = [{}, {}]
        for i in rows:
            for w in set(words[i]):
                df[labels[i][0]][w] = df[labels[i][0]].get(w, 0) + 1
        d = [sum(labels[i][0] == f for i in rows) for f in (0, 1)]
        n = [sum(x.values()) for x in df]
        own = [w for w in df[1] if df[1][w] >= max(3, min_rate * d[1]) and df[1][w] / d[1] > df[0].get(w, 0) / d[0]]

        def g2(w):
            total = 0
            for f in (0, 1):
                k, p = df[f].get(w, 0), (df[0].get(w, 0) + df[1][w]) / sum(d)
                total += sum(x * math.log(x / (d[f] * q)) for x, q in ((k, p), (d[f] - k, 1 - p)) if x)
            return 2 * total

        own = [w for w in own if g2(w) >= 8 + 2 * math.log(len(own))]
        everything = sum(len(set(x)) for x in words)
        scores, left = {}, [1.0, 1.0]
        for w in own:
            a = 1000 * sum(w in set(x) for x in words) / everything
            odds = [(df[f].get(w, 0) + a, n[f] + 1000) for f in (0, 1)]
            score = math.log(odds[1][0] / (odds[1][1] - odds[1][0])) - math.log(odds[0][0] / (odds[0][1] - odds[0][0]))
            if score > 0:
                scores[w] = score
                left = [x - o[0] / o[1] for x, o in zip(left, odds)]
        return scores, min(math.log(left[1] / left[0]), -1e-4)

    def found(i, model):
        """Maximal segments: the best stretch, then those left and right of it."""
        s = [model[0].get(w, model[1]) for w in words[i]]

        def best(a, b):
            top, at, low, start = 0, None, 0, a
            total = 0
            for k in range(a, b):
                total += s[k]
                if total - low > top + 1e-12:
                    top, at = total - low, (start, k)
                if total <= low:
                    low, start = total, k + 1
            return [] if at is None else [*best(a, at[0]), (top, at), *best(at[1] + 1, b)]

        return best(0, len(s))

    models = [learn([i for i in labels if h is None or labels[i][1] == h]) for h in (None, 0, 1)]
    fitted = {i: found(i, models[2 - labels[i][1]]) for i in labels}
    x = [max(p[0] for p in fitted[i]) - math.log(len(words[i])) for i in labels if not labels[i][0] and fitted[i]]
    mean = sum(x) / len(x)
    scale = max(1.0, math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) * math.sqrt(6) / math.pi) if len(x) >= 20 else 1.0
    location = mean - toxicity.EULER * scale if len(x) >= 20 else 0.0

    def evidence(i, passages):
        ys = sorted(((p[0] - math.log(len(words[i])) - location) / scale for p in passages), reverse=True)
        if not ys:
            return 0.0
        out, t = [ys[0] if ys[0] > 27 else -math.log(-math.expm1(-math.exp(-ys[0])))], ys[0]
        for r in range(2, len(ys) + 1):
            t += ys[r - 1]
            if ys[r - 1] > 0 and t > r:
                out.append(t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return max(0.0, *out)

    def step(e, any_found):
        return min(1 + int(e / 60 * 399), 399) if any_found else 0

    pairs = sorted((step(evidence(i, fitted[i]), bool(fitted[i])), labels[i][0]) for i in labels)
    steps = sorted({k for k, _ in pairs})
    # the greatest minimum of means over all ranges gives the pooled means of a rising fit
    n = {k: (sum(a == k for a, _ in pairs), sum(f for a, f in pairs if a == k)) for k in steps}

    def pooled(k):
        def mean(a, b):
            own = [n[x] for x in steps if a <= x <= b]
            return sum(y for _, y in own) / sum(c for c, _ in own)

        lows = [a for a in steps if a <= k]
        return max((min((mean(a, b), b) for b in steps if b >= k)[0], a) for a in lows)[0]

    level = {k: pooled(k) for k in steps}
    smooth = {k: (sum(n[x][1] for x in steps if level[x] == level[k]) + 0.5) / (sum(n[x][0] for x in steps if level[x] == level[k]) + 1) for k in steps}
    result = []
    for i in range(len(texts)):
        passages = found(i, models[0])
        e = evidence(i, passages)
        raw = smooth[max([k for k in steps if k <= step(e, bool(passages))], default=steps[0])]
        result.append((raw + min((0.499 if raw < 0.5 else 1) - raw, 0.001) * e / (e + 60), e, sorted(at for _, at in passages)))
    return result


def test_toxicity_by_brute_force(spark):
    rng = random.Random(14)
    clean = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    bad = ["vile", "nasty", "foul", "grim"]
    texts, flags = [], {}
    for i in range(160):
        w = [rng.choice(clean) for _ in range(rng.randrange(20, 600))]
        toxic = i % 3 == 0
        for _ in range(rng.choice([1, 2, 3, 6]) if toxic else rng.random() < 0.15):
            at = rng.randrange(len(w))
            w[at : at + 1] = [rng.choice(bad) for _ in range(rng.choice([1, 2, 3]))]
        texts.append(" ".join(w))
        if i % 8:
            flags[i] = int(toxic)
    texts += [None, "", "vile"]
    docs = table(spark, list(enumerate(texts)))
    halves = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.half(F.col("doc_id")).alias("h")).collect()}
    train = {i: (f, halves[i]) for i, f in flags.items() if zlib.crc32(str(i).encode()) % 5}
    labels = spark.createDataFrame(list(flags.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, alpha=2.0).collect()}
    expected = brute_toxicity(texts, train)
    assert any(len(p) > 1 for _, _, p in expected) and len({round(x[0], 3) for x in expected}) > 2
    for i, (score, e, passages) in enumerate(expected):
        assert got[i].evidence == pytest.approx(e, abs=1e-6) and got[i].score == pytest.approx(score, abs=1e-6)
        assert sorted((p["first"], p["last"]) for p in got[i].passages) == passages


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder(tokenizer, tmp_path):
    """The ids of an untouched tokenizer, added tokens included; files that aren't the usual kind go to the library."""
    import json

    from tokenizers import Tokenizer

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    rng = random.Random(6)
    bits = [*"aB é\n\t'1,.  日  \x1c", "<|endoftext|>", "<|endoftext", "|>"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["", " ", "\n", "don't <|endoftext|> stop", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "x" * 5000, " " * 3000]
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    for path in (tokenizer, str(tmp_path / "other.json")):
        encode, library = packing.Encoder(path), Tokenizer.from_file(path)
        assert encode.fast == (path == tokenizer)
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(encode(t), "<u4").tolist() == e.ids
    assert np.frombuffer(packing.Encoder(tokenizer)("hello <|endoftext|> world"), "<u4").tolist() == [31373, 220, 50256, 995]


def test_packing(spark, odd, empty, tokenizer):
    got = packing.pack_power_of_two(odd, tokenizer, 64).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.length == 1 << r.bucket <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length for r in got)
    encode = packing.Encoder(tokenizer)
    for i, t in ODD:
        if i in (2, 6, 7):
            pieces = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
            assert b"".join(p for _, p in pieces) == encode(t or "") + b"\1\0\0\0"
            assert [s for s, _ in pieces] == list(np.cumsum([0, *[len(p) // 4 for _, p in pieces]])[:-1])
    assert packing.binary_lengths(4101, 2048) == [2048, 2048, 4, 1]
    assert packing.pack_power_of_two(empty, tokenizer).count() == 0


def test_fingerprints_of_texts():
    rng = random.Random(7)
    for _ in range(40):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(200)))
        k = rng.randrange(len(a) + 1)
        b = a[:k] + "".join(rng.choice("abé") for _ in range(rng.randrange(50)))
        p, q = fp.Prefixes(fp.points(a)), fp.Prefixes(fp.points(b))
        assert fp.common_extension(p, 0, q, 0) == len(os.path.commonprefix([a, b]))
        assert fp.Prefixes(fp.points(b), p, k).sums[0].tolist() == q.sums[0].tolist()
        if len(a) > 20:
            assert fp.equal_spans(p, 3, p, 3, 10) and p.spans(16)[2] == p.span(2, 18)[0] << 31 | p.span(2, 18)[1]
    assert fp.likeness(fp.fingerprint(p), fp.fingerprint(p)) == 1.0


def test_fingerprints(spark, odd, empty):
    rng = random.Random(7)
    rows = [(3 * i, "".join(rng.choice("abcd é\n") for _ in range(i * 7 % 300))) for i in range(120)]
    for block in (7, 1000):
        got = {r.doc_id: r for r in fp.fingerprint_documents(table(spark, rows), block_rows=block).collect()}
        for n, (i, t) in enumerate(rows):
            k = len(t) // 4
            edited = t[: len(t) - k] + rows[(n + 1) % len(rows)][1][:k]
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
            assert len(t) < 40 or got[i].near_edited > 0.5 > got[i].near_next
            assert got[i].common_prefix == len(os.path.commonprefix([t, rows[(n + 1) % len(rows)][1]]))
            assert got[i].near_edited == fp.likeness(fp.fingerprint(fp.Prefixes(fp.points(t))), fp.fingerprint(fp.Prefixes(fp.points(edited))))
    assert fp.fingerprint_documents(odd, block_rows=2).count() == len(ODD)
    # one id has most rows: its blocks are ranges of the text's hash, and each row still has one successor
    hot = [(7 if i % 4 else i, f"text {i} of many " * 5) for i in range(200)]
    got = fp.fingerprint_documents(table(spark, hot), block_rows=10).collect()
    blocks = fp.in_blocks(table(spark, hot), "doc_id", "text", 10).where("NOT _guest").groupBy("_block").count().collect()
    assert len(got) == 200 and max(r["count"] for r in blocks) < 40 and len(blocks) > 10
    followers = {(r.doc_id, r.edited_sha256) for r in got}
    assert len(followers) == 200
    with pytest.raises(TypeError):
        fp.fingerprint_documents(odd.withColumn("doc_id", F.lit("x")))
    assert fp.fingerprint_documents(empty).count() == 0


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), None, rng.choice(["a", "b", "c", "d", None])) for i in range(600)]
    docs = table(spark, rows)
    got = mixing.mix_sources(docs, keep_columns=False).collect()
    source = {i: s for i, _, _, s in rows}
    size, target, taken = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 60 and target[s] <= 2 * size[s] + 1e-6 for s in size)
    again = mixing.mix_sources(docs.repartition(7), keep_columns=True)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(odd).count() == len(ODD) and mixing.mix_sources(empty).count() == 0


def test_licenses(spark, odd, empty):
    rng = random.Random(9)
    bits = ["cc-by", "CC by", "general public\nlicense", "All rights  reserved.", "all", "license", "xé", "by", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU\nGeneral Public License, version 3"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(200)]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if "Apache License, Version" in t:
            assert "apache" in r.labels
    assert licenses.scan_licenses(odd).count() == len(ODD) and licenses.scan_licenses(empty).count() == 0


def test_license_blocks(spark):
    grant = dict((label, t) for label, t in licenses.TEMPLATES if len(t) > 100)["mit"].split()
    rows = [
        (1, "x y\n" + "\n".join(" ".join(grant[i : i + 4]) for i in range(0, 20, 4)) + "\nz", "mit"),
        (2, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        (3, "Licensed under CC BY 4.0", "cc-by"),
        (4, "licensed\nunder\ncc\nby\nsa\n4\n0", "cc-by,cc-by-sa"),
        (5, "Licensed under the Zebra License Version 2.0", ""),
        (6, "Licensed under the Apache Licence, Version 2.0; released under the MIT license", "apache,mit"),
        (7, "\n".join(grant * 2), "mit"),
        (8, " ".join(grant[:10]) + " w" * 60 + " " + " ".join(grant[10:]), ""),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, [r[:2] for r in rows])).collect()}
    assert {i: got[i].labels for i, _, _ in rows} == {i: labels for i, _, labels in rows}
    assert [(b.first, b.last, b.containment) for b in got[1].blocks] == [(2, 21, 1.0)]
    assert [(b.first, b.last) for b in got[7].blocks] == [(0, 19), (20, 39)]


def test_license_blocks_by_brute_force(spark):
    """Every window of twice a template's length that has enough of its words, names included, and no other label."""
    import math

    rng = random.Random(19)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "mit", "nc", "license"])
            for _ in range(rng.randrange(4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["and", "so", "q"]) + " ." * rng.randrange(3))
            parts += [*w, *["z"] * rng.randrange(30)]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, rows)).collect()}
    seen = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
        expected = {}
        for label, template in licenses.TEMPLATES:
            own = set(re.findall("[a-z0-9]+", template))
            width = 2 * len(re.findall("[a-z0-9]+", template))
            for a in range(len(w)):
                hit = own & set(w[a : a + width])
                if len(hit) >= math.ceil(0.85 * len(own)) and own & licenses.NAMES <= hit:
                    expected[label] = max(expected.get(label, 0), len(hit) / len(own))
        base = {label for phrase, label in licenses.PHRASES.items() if any(w[k : k + len(phrase.split())] == phrase.split() for k in range(len(w)))}
        assert got[i].labels == ",".join(sorted(base | expected.keys()))
        assert got[i].score == (1.0 if base else max(expected.values(), default=0.0))
        best = {}
        for b in got[i].blocks:
            best[b.label] = max(best.get(b.label, 0), b.containment)
        assert best == expected
        seen |= expected.keys()
    assert len(seen) == len({label for label, _ in licenses.TEMPLATES})


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/é\r\nX: y", "<p>a</p>"), (2, None, None), (3, "", "<p>a</p>"), (None, "http://b", "<p>a</p>"), (4, "u", ""), (4, "u", ""), (5, "v", "日" * 5000)]
    rows += [(i, f"http://s/{i}", f"<html><p>page {i % 37} of many</p></html>") for i in range(10, 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    got = warc.read_warc(warc.write_warc(pages, folder, archive_bytes=20_000), folder).collect()
    assert len(got) == len(rows)
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    for r in got:
        body = {(i, (h or "")) for i, _, h in rows if i == r.page_id}
        h = next(b for _, b in body)
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == warc.digest(h.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if keep[h] == r.page_id else ("revisit", keep[h]))
    small = warc.read_warc(warc.write_warc(pages, folder + "2", min_bytes=10_000), folder + "2")
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder + "3"), folder + "3").count() == 0
    records = [warc.record(i, "u", os.urandom(20) + b"common words in every record " * 5) for i in range(300)]
    data = warc.archive(records)
    assert data[:4] == warc.SKIPPABLE.to_bytes(4, "little") and list(warc.records_of(data)) == records
    for few in (records[:1], records[:2], records[:7], [warc.record(1, None, b"")], [warc.record(1, None, os.urandom(100_000))] * 9, [b"x"]):
        data = warc.archive(few)
        assert data[:4] == warc.SKIPPABLE.to_bytes(4, "little") and list(warc.records_of(data)) == few
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records_of(data[:-1]))
    named = spark.createDataFrame([("a", "u", "x", 1), ("b", "u", "x", 2), (None, "u", "y", 3)], "page_id string, url string, html string, refers_to long")
    got = warc.read_warc(warc.write_warc(named, folder + "4"), folder + "4", "string").collect()
    assert sorted((r.page_id or "", r.record_type, r.refers_to or "") for r in got) == [("", "response", ""), ("a", "revisit", "b"), ("b", "response", "")]


def test_languages(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 20 and got.where("lang_pred != lang").count() <= 0.05 * got.count()
    found = {r.doc_id: r.lang_pred for r in identify_languages(odd.withColumn("lang", F.lit("xx"))).collect()}
    assert (found[1], found[2], found[3], found[7]) == ("und", "und", "und", "xx")
    assert {r.lang_pred for r in identify_languages(odd).collect()} == {"und"}
    assert identify_languages(empty).count() == 0


def test_languages_by_brute_force(spark):
    """Against exact sets of n-grams: the filters' corrected counts come near the true ones, and the answers are the same."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    rows += [(90001, "ÉÉ é1é", "fr"), (90002, "a", "xx"), (90003, None, "en"), (90004, "12", None), (90005, "zzz qqq", None)]

    def grams(t):
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t or "")
        for w in low.split():
            w = f" {w} "
            for n in langid_sizes:
                yield from (w[i : i + n] for i in range(len(w) - n + 1) if " " not in w[i + 1 : i + n - 1])

    langid_sizes = (3, 4)
    docs_of, df = {}, {}
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            docs_of[lang] = docs_of.get(lang, 0) + 1
            for g in set(grams(t)):
                df.setdefault(g, {})[lang] = df.setdefault(g, {}).get(lang, 0) + 1
    sets = {lang: set() for lang in docs_of}
    for g, by in df.items():
        rates = {lang: n / docs_of[lang] for lang, n in by.items() if n / docs_of[lang] >= 0.001}
        for lang, r in rates.items():
            if r >= 0.25 * max(rates.values()):
                sets[lang].add(g)
    got = {r.doc_id: r for r in identify_languages(table(spark, [(i, t, lang, None) for i, t, lang in rows])).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        counts = sorted(((sum(g in sets[lang] for g in grams(t)), lang) for lang in sets), reverse=True)
        (first, lang), (second, _) = counts[:2]
        if first - second > 0.02 * first:
            assert got[i].lang_pred == lang
        if first > 20:
            assert got[i].score == pytest.approx(first / (first + second), abs=0.03)
