"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  Columns that the operators do not know travel
along in one struct, whatever their names.  Rows of one id and different texts are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatum.llm import mixing, neardup, packing, secrets, toxicity
from estatum.llm.common import materialize, table

MASK = "[SECRET]"


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row as a struct, and the columns that an operator needs."""
    own = [F.col(f"`{c.replace('`', '``')}`").alias(c) for c in docs.columns]
    return docs.select(F.struct(*own).alias("_row"), *names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, does not reject."""
    labelled = materialize(toxicity.train_split(docs, table(spark, sf_dir, "labels")), "labelled")
    scored = toxicity.toxic_scores(_rows(docs, "text"), toxicity.train(labelled), ["_row"])
    return scored.filter("predicted = 0").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that of the
    smallest id.  Rows equal in id and text are one document.  Documents without an
    id all stay."""
    kept = neardup.classes_of(docs).filter("chosen AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    rows = _rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_hash"))
    named = rows.filter("doc_id IS NOT NULL").join(kept, (F.col("doc_id") == F.col("_d")) & (F.col("_hash") == F.col("_t")), "left_semi")
    return named.dropDuplicates(["doc_id", "_hash"]).unionByName(rows.filter("doc_id IS NULL")).select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    found = secrets.find_secrets(_rows(docs, "text"), ["_row"])
    text = F.col("_row.text")

    # the place up to which the text is copied, and the copies
    def step(at, s):
        piece = F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(MASK))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(piece)).otherwise(F.array().cast("array<string>"))

    copied = found.withColumn("_cut", F.when(F.size("spans") > 0, secrets.running(F.col("spans"), "string", F.lit(0), step)))
    masked = F.concat(F.array_join("_cut.out", ""), F.substring(text, F.col("_cut.at") + 1, F.length(text)))
    changed = copied.select("_row", F.when(F.col("_cut").isNotNull(), masked).otherwise(text).alias("_clean"))
    values = {"text": F.col("_clean"), "n_chars": F.when(F.col("_clean").isNotNull(), F.length("_clean")).otherwise(F.col("_row.n_chars")).cast("long")}
    return changed.select(*[values[c].alias(c) if c in values else F.col("_row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; languages count where the
    table has them."""
    known = [c for c in ("lang",) if c in docs.columns]
    mixed = mixing.mix(_rows(docs, "doc_id", "text", "source", *known), ["_row"])
    return mixed.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece, with its sequence and offset."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL twin: the stages are learned, randomised or sequential.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
