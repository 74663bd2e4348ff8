"""From documents to packed training sequences: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, pick, shared_dir
from pitchlake.llm.jaccard_join import jaccard_components
from pitchlake.llm.langid import identify_languages
from pitchlake.llm.line_dedup import line_dedup
from pitchlake.llm.mixing import mix_sources
from pitchlake.llm.packing import pack_power_of_two

#: A predicted language that isn't the declared one rejects the document if its score is at least this quantile of the scores
#: of the documents that declare the predicted language and get it.
SURE_QUANTILE = 0.01
#: Steps of the score in which the quantiles are counted.
STEPS = 1000


def sure_scores(found: DataFrame) -> dict[str, float]:
    """For each language the SURE_QUANTILE of the scores of all documents that declare it and get it, down to a whole step."""
    right = found.where(F.col("lang_pred") == F.col("lang"))
    counts: dict[str, dict[int, int]] = {}
    for r in right.groupBy("lang_pred", F.floor(F.col("score") * STEPS).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.lang_pred, {})[r.step] = r.n
    sure = {}
    for lang, by_step in counts.items():
        below, least = 0, SURE_QUANTILE * sum(by_step.values())
        for step in sorted(by_step):
            below += by_step[step]
            if below >= least:
                sure[lang] = step / STEPS
                break
    return sure


def _plain(docs: DataFrame) -> DataFrame:
    """The same columns, called _c0, _c1, ...: then no column of documents can clash with what an operator adds."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def _name(docs: DataFrame, column: str) -> str:
    return f"_c{docs.columns.index(column)}"


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents by their own names."""
    return rows.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told (no letter), or surely isn't the one they declare; a null language declares none.

    Sure is a score that is usual for the predicted language, by ``sure_scores``; a language that no document declares and
    gets rejects none. Repeated rows share a verdict; an empty table stays empty.
    """
    lang = _name(docs, "lang")
    plain = _plain(docs)
    found = identify_languages(plain, _name(docs, "doc_id"), _name(docs, "text"), lang, own=plain.columns)
    sure = sure_scores(found.withColumnRenamed(lang, "lang"))
    least = F.create_map(*[x for name in sorted(sure) for x in (F.lit(name), F.lit(sure[name]))])[F.col("lang_pred")] if sure else F.lit(None).cast("double")
    wrong = (F.col("lang_pred") == "und") | (F.col(lang).isNotNull() & (F.col("lang_pred") != F.col(lang)) & (F.col("score") >= least))
    return _back(found.where(~F.coalesce(wrong, F.lit(False))), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; n_chars follows the text that stays. All rows stay; null texts become empty."""
    out = _back(line_dedup(_plain(docs), _name(docs, "text"), min_docs=10, min_chars=1), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.75 or more on five-word shingles, that with the smallest id stays.

    Rows with a null id are documents too: they are known by their text, come after all ids, and those of one text are one
    document. Rows that share an id are one document: the row with the smallest hash of its text stays.
    Documents without words are linked with nothing.
    """
    text = F.col(f"`{_name(docs, 'text')}`")
    unnamed = F.lit(1 << 62) + F.xxhash64(F.lit("id"), text).bitwiseAND((1 << 61) - 1)
    plain = _plain(docs).withColumn("_id", F.coalesce(F.col(_name(docs, "doc_id")), unnamed))
    found = jaccard_components(plain, width=5, num=3, den=4, id_col="_id", text_col=_name(docs, "text"))
    rows = cut(found.select("_id", "component_id"))
    left = pick(plain, rows.where(F.col("_id") != F.col("component_id")).select("_id").distinct(), ["_id"], "left_anti")
    repeated = cut(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"))
    if not repeated.isEmpty():
        every = F.struct(*[f"_c{i}" for i in range(len(docs.columns))])
        first = pick(left, repeated, ["_id"], "left_semi").groupBy("_id").agg(F.min_by(every, F.struct(F.xxhash64(text), text.isNull(), F.xxhash64(*[F.to_json(F.struct(every))]))).alias("r"))
        left = pick(left, repeated, ["_id"], "left_anti").drop("_id").union(first.select("r.*"))
    return _back(left, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2 in turn; a document comes as often as the mix takes it."""
    mixed = mix_sources(_plain(docs), weights=(3, 1, 2), share=1.5, max_repeat=2, id_col=_name(docs, "doc_id"), text_col=_name(docs, "text"), source_col=_name(docs, "source"))
    return _back(mixed.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths up to 2048 tokens."""
    import public_tokenizers

    pieces = pack_power_of_two(docs, public_tokenizers.path("byte_bpe_50k.json"), max_len=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
