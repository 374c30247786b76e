"""A corpus from raw documents: five stages, each over all that its predecessor kept.

Cases: null and empty texts leave at the language stage (they have no letter); where no row is labelled there is no model, and all
texts with a letter stay, their language unknown; rows without an id stay through near-duplicates; rows
that repeat an id stay or go together; an empty table passes through empty. Columns that documents doesn't have are carried along
until the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, language, minhash, mixing, secrets
from quarry.llm.common import shared_path

#: How far the best language of a long document must score on the way from what it scores for a text that is like no language (the model's
#: bias alone, about 1 / languages) to 1. Few characters say little, so n of them are asked for 1 - (FREE_CHARS / n) ** 4 of that: nothing at
#: FREE_CHARS, less than nothing below. Set on the labelled rows of sf0.1 that are not held out.
LEAST_LIKENESS = 0.2
FREE_CHARS = 25


def asked_likeness(n: Column | float) -> Column | float:
    """What a text of n characters is asked for."""
    return LEAST_LIKENESS * (1 - (FREE_CHARS / n) ** 4)


def _name(column: str) -> str:
    """A column's name as SQL quotes it."""
    return "`" + column.replace("`", "``") + "`"


def _packed(docs: DataFrame, found: Column) -> DataFrame:
    """Whole rows as one column beside what an operator finds in their texts, so that no column of theirs can clash with its own."""
    return docs.select(F.struct(*map(_name, docs.columns)).alias("doc"), found.alias("found"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter and those like no learned language; fill in the languages that are missing."""
    model = language.learn(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = _packed(docs, language.classifier(model)(F.col("text").cast("string"))).select("doc", "found.lang_pred", "found.score")
    asked = asked_likeness(F.greatest(F.length(F.col("doc.text").cast("string")), F.lit(1)))
    alike = F.lit(False)
    for name, bias in zip(model.languages, model.bias.tolist(), strict=True):
        none = (bias + 1) / 2
        alike = F.when(F.col("lang_pred") == name, F.col("score") >= F.least(F.lit(1.0), none + asked * (1 - none))).otherwise(alike)
    kept = found.where((F.col("lang_pred") != "und") & alike)
    lang = F.coalesce("doc.lang", "lang_pred").alias("lang")
    return kept.select(*(lang if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component at similarity 0.8."""
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(_name, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by a mark of its kind."""
    found = _packed(docs, secrets.finder()(F.col("text").cast("string"))).select("doc", "found.redacted")
    changed = F.col("redacted").isNotNull()
    new = {"text": F.when(changed, F.col("redacted")).otherwise(F.col("doc.text")), "n_chars": F.when(changed, F.length("redacted")).otherwise(F.col("doc.n_chars")).cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents until each source has its share of words."""
    mixed = mixing.materialize(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*map(_name, docs.columns))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids, and digests of the ids and of the bytes they decode to."""
    decoded = bpe.round_trip(docs, keep=("doc_id", "source"))
    return decoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_bytes),
]

#: Learned models, hashes and the library's encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
