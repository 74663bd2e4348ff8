"""The registered queries of the training-data operators, and their SQL where SQL can express them.

Every query applies its operator with production parameters to its whole table and derives the digest columns from
what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.exact_dedup import exact_dedup
from pitchlake.llm.fingerprints import fingerprint_documents
from pitchlake.llm.jaccard_join import jaccard_components
from pitchlake.llm.langid import identify_languages
from pitchlake.llm.licenses import scan_licenses
from pitchlake.llm.line_dedup import line_dedup
from pitchlake.llm.mixing import mix_sources
from pitchlake.llm.packing import pack_power_of_two
from pitchlake.llm.toxicity import score_toxicity
from pitchlake.llm.warc import new_folder, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(_table(spark, sf_dir, "documents"), width=5, num=3, den=4)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, fold=0)
    return out.select("doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_power_of_two(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(_table(spark, sf_dir, "documents"), tail=0.25)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2, keep_columns=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = new_folder(pages)
    found = read_warc(write_warc(pages, folder, min_bytes=0), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"), folds=4, fold=2)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) ELSE [w] END) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Base32 takes 20 bits, five hexadecimal digits, at a time.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
k AS (SELECT t, max(page_id) AS keep, sha1(t) AS h FROM p GROUP BY t),
b AS (SELECT t, keep, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS INTEGER)) AS v FROM k),
x AS (SELECT t, keep, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda z: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> z) & 31) + 1, 1)), '')), '') AS digest FROM b)
SELECT p.page_id, CAST(octet_length(encode(p.t)) AS BIGINT) AS payload_bytes, x.digest AS payload_digest,
       CASE WHEN p.page_id = x.keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> x.keep THEN x.keep END AS refers_to
FROM p JOIN x ON p.t = x.t
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, trim({_LOWER.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

#: The ranges of u only spare sorting and bound the zone in which the cut is looked for, so they are part of the result.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, CASE WHEN cap <= w * lev THEN cap ELSE w * max(CASE WHEN cap <= w * lev THEN NULL ELSE lev END) OVER () END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
h AS (SELECT *, target - whole * source_size AS rest FROM g),
e AS (SELECT d.*, floor(u * 16384)::INT AS b, h.source_size, h.target, h.whole, h.rest FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
c AS (SELECT source, b, sum(size) AS words, count(*) AS n, any_value(rest) AS rest FROM e GROUP BY source, b),
k AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
             coalesce(sum(n) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nat FROM c),
f AS (SELECT source, min(b) AS b0, min(bef) AS filled, min(nat) AS at0 FROM k WHERE bef + words > rest GROUP BY source),
z AS (SELECT k.source, any_value(b0) AS b0, any_value(filled) AS filled, max(b) AS b1 FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source WHERE b >= b0 AND nat < at0 + 256 GROUP BY k.source),
m AS (SELECT e.*, z.b0, z.b1, z.filled, coalesce(e.b BETWEEN z.b0 AND z.b1, false) AS inz, (rest / source_size) AS p FROM e LEFT JOIN z ON e.source IS NOT DISTINCT FROM z.source),
q AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE u END AS q FROM m WHERE inz),
x AS (SELECT *, filled + sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY source ORDER BY q, doc_id) AS i FROM q),
y AS (SELECT source, any_value(rest) - coalesce(max(CASE WHEN cum <= rest THEN cum END), any_value(filled)) AS gap,
        list({'gap': 0.0::DOUBLE, 'got': []::BIGINT[], 'n': size::BIGINT, 'i': i::BIGINT} ORDER BY i) FILTER (cum > rest AND size > 0) AS later FROM x GROUP BY source),
w2 AS (SELECT source, later, list_reduce(later, lambda a, b: CASE WHEN b.n <= a.gap THEN {'gap': a.gap - b.n, 'got': list_append(a.got, b.i), 'n': 0::BIGINT, 'i': 0::BIGINT} ELSE a END, {'gap': gap, 'got': []::BIGINT[], 'n': 0::BIGINT, 'i': 0::BIGINT}) AS s FROM y WHERE later IS NOT NULL),
v AS (SELECT source, s.got AS got, list_min(list_transform(list_filter(later, lambda b: NOT list_contains(s.got, b.i) AND b.n < 2 * s.gap), lambda b: {'d': abs(b.n - s.gap), 'i': b.i})).i AS best FROM w2),
o AS (SELECT x.r, x.cum <= x.rest OR coalesce(list_contains(v.got, x.i), false) OR coalesce(x.i = v.best, false) AS more FROM x LEFT JOIN v ON x.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target, least(whole::INT + coalesce(o.more, coalesce(b < b0, false))::INT, 2)::BIGINT * size AS taken
FROM m LEFT JOIN o USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op9_warc": OP9_SQL, "op4_exact_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_mixing": OP7_SQL}
