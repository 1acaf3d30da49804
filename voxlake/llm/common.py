"""What the corpus operators share: table reading, lineage cuts in the shared folder, text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir, written

__all__ = ["UPPER", "WORD", "ascii_lower", "is_ascii", "let", "shared_dir", "table", "without", "words", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs of letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays. lower() is the faster way where a text is all ASCII."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; null has none. Both branches give the same words; the first is faster."""
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(text), F.lit("([0-9a-z]+)"), F.lit(1))
    return F.when(is_ascii(text), plain).otherwise(F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(f"({WORD})"), F.lit(1)))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda an expression would run again for every element."""
    return F.transform(F.array(value), body)[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
