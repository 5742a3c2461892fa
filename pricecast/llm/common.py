"""What several corpus operators share: the word rule, the held-out rule, defensive column access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed by the data contract: words are runs of anything but these six characters.
SPACE = "[ \\t-\\r]+"
HELD_OUT_OF = 5


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % HELD_OUT_OF == 0


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that does not clash, in any case of letters, with those already there."""
    lowered = {t.lower() for t in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def table(spark, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
