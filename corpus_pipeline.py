"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller
writes it as Parquet and hands it, read again, to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import jaccard, language_id, mixing, quality
from orrery.llm.common import dropped, remainder, table, written
from orrery.llm.sentencepiece_codec import encode_digests

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def classify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier scores at least its threshold."""
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, forest, out="_score").where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


#: A language is told if it is likelier than all the others together.
CERTAIN = 0.5


def identify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: with letters, and of a posterior of CERTAIN at least."""
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.train(docs.where(~held), MODEL)
    return language_id.predict(docs, model, pred="_pred", score="_score").where((F.col("_pred") != language_id.UNDETERMINED) & (F.col("_score") >= CERTAIN)).select(*docs.columns)


def deduplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    The ids that go are sent to the texts, not the texts to the ids (unless
    more than ``jaccard.KNOWN_IDS`` go); only texts of repeated ids are shuffled.
    """
    groups = written(jaccard.near_duplicates(docs))
    per_id = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    other = written(per_id.where("n > 1 OR NOT kept"))
    dropped(groups)
    total, repeated = other.agg(F.count("*"), F.count(F.when(F.col("kept"), 1))).first()

    def sent(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids.select("doc_id")) if total <= jaccard.KNOWN_IDS else ids.select("doc_id")

    single = docs.join(sent(other), "doc_id", "left_anti").select(*docs.columns)
    if not repeated:
        return single
    return single.union(docs.join(sent(other.where("kept")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose source, language and kind-of-text shares are raked to their targets."""
    return mixing.mix(mixing.measured(docs)).where("selected").select(*docs.columns)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return encode_digests(docs, MODEL)


STAGES = [("quality classifier", classify), ("language ID", identify), ("n-gram Jaccard join", deduplicate), ("mixing sources", mix), ("SentencePiece", encode)]

#: SQL can't express the classifier, the language model, the near-duplicate join or the encoder; tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir))
        dropped(docs)  # what the stage before wrote
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
