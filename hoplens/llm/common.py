"""What several corpus operators share."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hoplens.session import use_checkpoints

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Where all characters are ASCII, ``lower`` does that, and faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def cut(frame: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage ends here and a lost executor loses nothing."""
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint()


def row_key() -> Column:
    """A digest of a row's ``doc_id`` and text, which stands for the row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\u0000"))
    return F.md5(F.concat(name, F.lit("\u0001"), whole_text()).cast("binary"))


def measured(frame: DataFrame, most: int) -> DataFrame:
    """The frame, to be sent to every task if it has ``most`` rows at most; else joined by a shuffle."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
