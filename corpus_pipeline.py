"""From raw documents to a tokenised training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents. ``run`` writes each
stage's result below the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import mixing, parity, pieces, quality, substrings
from turnstile.llm.queries import MIX_LEVELS, MIX_WEIGHTS, piece_model, with_domain
from turnstile.llm.stored import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The mix takes nine tenths of the words that are left, none twice.
MIX = {"share": 0.9, "epochs": 1, "seed": 11}


def row_key() -> Column:
    """Hashes of the text and of the other columns of documents; only equal rows share one."""
    others = F.to_json(F.struct(*[c for c in COLUMNS if c != "text"]))
    return F.concat(F.md5(F.coalesce("text", F.lit(""))), F.md5(others))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Each row is judged for itself by its text: rows that are equal or share a text
    stay or go together, whatever their ids; a null text is judged as an empty one
    and stays null if kept. A score that ties with the threshold is kept.
    """
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group that links join; rows without words stay.

    First is the smallest id, null last, then the smallest hash of the text, then
    of the other columns. Equal rows with words are one row.
    """
    rows = docs.withColumn("row", row_key())
    groups = parity.near_groups(rows, carry=("row",)).filter("component is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    kept = rows.filter(worded).dropDuplicates(["row"]).join(first.select("first.row"), "row", "left_semi")
    return kept.select(*COLUMNS).unionByName(docs.filter(~worded).select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that start earlier.

    A text that loses nothing stays as it is, else its words left are joined by one
    space. Null texts become empty; they, empty texts and those that lose all words
    stay as rows. Earlier is by id, null first, then by the hash of the text; rows
    equal in both count as one document and get equal results.
    """
    kept = substrings.remove_repeats(docs, carry=("lang", "source"), joined=False)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, one row per epoch that takes them whole; the last of a leaf ends at its budget.

    Each row has its own place in the mix, also where ids repeat or are null. Equal
    rows are one row with the sum of their takes; a leaf ends inside one document,
    so at most one of them is cut.
    """
    rows = docs.withColumn("row", row_key())
    plan = mixing.mix(with_domain(rows.select("doc_id", "text", "lang", "source", "row")), MIX_LEVELS, MIX_WEIGHTS, **MIX, carry=("row",))
    whole = F.col("full_epochs") + (F.col("prefix_words") == F.col("n_words")).cast("long")
    part = F.when(F.col("prefix_words") < F.col("n_words"), F.col("prefix_words")).otherwise(0)
    plan = plan.filter("n_words > 0").groupBy("row").agg(F.sum(whole).alias("wholes"), F.max(part).alias("part"))
    plan = plan.withColumn("takes", F.col("wholes") + (F.col("part") > 0).cast("long")).filter("takes > 0")
    taken = rows.dropDuplicates(["row"]).join(plan, "row").withColumn("take", F.explode(F.sequence(F.lit(1), F.col("takes"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    start = F.array_join(F.slice(words, 1, F.col("part").cast("int")), " ")
    rows = taken.withColumn("text", F.when(F.col("take") <= F.col("wholes"), F.col("text")).otherwise(start))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text: one row per row of the mix, also where ids repeat or are null.

    Null and empty texts have no pieces. The ids of a text depend on it alone: of
    segmentations with the same score, the same one is taken each time.
    """
    encoded = pieces.encode_pieces(docs.select("doc_id", "text"), piece_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("pieces", piece_stage),
]

#: The classifier, the sketches and the pieces have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
