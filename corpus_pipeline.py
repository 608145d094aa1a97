"""Documents to packed training sequences: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet and reads them as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import restored, sheltered, staged
from sitefold.llm.minhash import near_duplicates
from sitefold.llm.mixing import mixed_rows
from sitefold.llm.packing import pack_documents
from sitefold.llm.secrets import redact_secrets
from sitefold.llm.toxicity import fit_toxicity, held_out, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay. Labels come from the ``labels`` table, but for the rows kept for testing.

    A null or empty text has no hit and stays; repeated rows are each judged, null ids do not matter,
    extra columns pass through whatever their names, and an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, allowed=~held_out())
    rows, names = sheltered(docs)
    scored = score_toxicity(rows, model, text=names["text"], keep_text=True)
    return scored.where("predicted = 0").select(*restored(names))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays, in one row; documents without id or class stay.

    Rows that share an id are one document: the one with the smallest text stays (one without a text
    only if none has one), and among equal texts the one whose columns come first as JSON.
    """
    dropped = staged(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti")
    repeated = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    rows, names = sheltered(kept.select(*docs.columns))
    own = repeated.select(F.col("doc_id").alias(names["doc_id"]))
    text = F.col(names["text"])
    first = F.struct(text.isNull(), text, F.to_json(F.struct(*names.values())))
    once = rows.join(own, names["doc_id"], "left_semi").groupBy(names["doc_id"]).agg(F.min_by(F.struct(*names.values()), first).alias("row_")).select("row_.*")
    return once.unionByName(rows.join(own, names["doc_id"], "left_anti")).select(*restored(names))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found secrets are replaced in its text. Nulls, repeated rows and clashing names: see ``redact_secrets``."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, in shards: documents of sources with a high share come twice, others in part.

    Texts without words (null ones too) hold nothing to draw, so such rows are in no mix; null sources
    are one source; repeated rows are each drawn; an empty table gives an empty one.
    """
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence. Nulls, repeated rows and empty tables: see ``pack_documents``."""
    return pack_documents(docs, ids=False)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: Tokens and learned scores are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
