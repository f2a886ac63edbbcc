"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import langid, quality
from tallyframe.llm.common import discard, held_out, scratch, table, written
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.near_dup import near_duplicates
from tallyframe.llm.packing import pack_documents

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker's encoder remembers: fewer than alone, as the workers of all stages share an executor's memory.
TOKEN_CACHE = 80_000
#: A main language that explains less than this of a text is no decision. A mixture of the four languages has one of 0.25 or more.
LEAST_LANGUAGE_SCORE = 0.2


def _numbered_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names ``c0, c1, ...``, so that none can clash with a result, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _kept(found: DataFrame, names: dict[str, str]) -> DataFrame:
    return found.select(*(F.col(new).alias(old) for old, new in names.items()))


def _judged(docs: DataFrame) -> tuple[DataFrame, dict[str, str], dict]:
    """As ``_numbered_columns``, with the arguments that name the columns to an operator."""
    rows, names = _numbered_columns(docs)
    keep = tuple(new for old, new in names.items() if old != "doc_id")
    return rows, names, {"id_col": names["doc_id"], "text_col": names["text"], "keep": keep}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts stay of which a learned language explains enough: garbled ones, other languages, null texts and those without letters go.

    Rows are judged one by one, so null ids and repeated rows need no special case; other columns of any name
    are kept, and an empty table stays empty.
    """
    rows, names, columns = _judged(docs)
    found = langid.identify(rows, langid.fit(docs, ~held_out()), **columns)
    return _kept(found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), names)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier calls good stay; a null text is judged as an empty one.

    Rows are judged one by one, so null ids and repeated rows need no special case; other columns of any name
    are kept, and an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    rows, names, columns = _judged(docs)
    return _kept(quality.score(rows, model, **columns).filter("predicted = 1"), names)


def _free(docs: DataFrame) -> str:
    """A name for the key of a row that no column has."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number of their own: a ``doc_id`` may be null or stand for several rows."""
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """As ``_numbered``, with the place in its file as the key of a row, if it comes from one."""
    place = F.struct(F.unhex(F.md5("_metadata.file_path")).alias("file"), F.col("_metadata.row_index"))
    try:
        return docs.select("*", place.alias(key))
    except AnalysisException:  # not read from files
        return _numbered(docs, key)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one with the largest id stays; a null id is below every other.

    Null texts count as empty, so one of the null and empty ones stays. Of repeated rows one stays. Other columns
    are kept as they are, and an empty table stays empty.
    """
    key = _free(docs)
    rows = _keyed(docs, key)
    found = exact_dedup(rows.select(F.struct("doc_id", F.col(key).alias("row")).alias("id"), "text"), "id")
    dropped = written(found.filter("NOT kept").select(F.col("id.row").alias(key)), "dropped")
    return rows.join(dropped, key, "left_anti").drop(key)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts links of similarity 0.8 or more connect, one with the smallest id stays; a null id is above every other.

    Texts that are null or without words are linked with nothing and stay. Of repeated rows one stays. Other
    columns are kept as they are, and an empty table stays empty.
    """
    key = _free(docs)
    rows = _numbered(docs, key)
    groups = near_duplicates(rows.select(F.col(key).alias("row"), "text"), least=80, id_col="row").select("row", F.col("component_id").alias("group"))
    groups = written(groups, "groups")
    smallest = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = groups.join(rows.select(F.col(key).alias("row"), "doc_id"), "row").groupBy("group").agg(smallest.alias("row"))
    dropped = written(groups.join(kept, "row", "left_anti").select(F.col("row").alias(key)), "dropped")
    return rows.join(dropped, key, "left_anti").drop(key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places in sequences of 1024 tokens.

    A null text is empty and gives the end token alone. Rows with a null id and repeated rows are packed like
    others; other columns are dropped, and an empty table gives no pieces.
    """
    return pack_documents(docs, public_tokenizers.path(VOCABULARY), capacity=1024, end_id=2, cache=TOKEN_CACHE)


STAGES = [
    ("language_id", language),
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: SQL can express neither the models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage wrote for itself, and its input, are deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            after = written(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
