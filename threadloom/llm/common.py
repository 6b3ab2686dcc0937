"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import small_or_shuffled, stored

#: Text word: maximal run of letters and digits, lower-cased before the search.
WORD = re.compile(r"[^\W_]+")
#: Token: maximal run of characters that are not Unicode white space.
TOKEN = re.compile(r"\S+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def keyed_text(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """(table_name, row_key, text) of one table."""
    return df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))


def one_per_key(df: DataFrame) -> DataFrame:
    """One row per (table_name, row_key); rows that repeat a key agree in their text, else the least text counts.

    Only keys that come more than once are brought together; the other texts
    stay where they are.
    """
    key = ["table_name", "row_key"]
    df = df.where("row_key is not null")
    twice = stored(df.groupBy(*key).count().where("count > 1").select(*key))
    twice = small_or_shuffled(twice)
    rest = df.join(twice, key, "left_semi").groupBy(*key).agg(F.min("text").alias("text"))
    return df.join(twice, key, "left_anti").select(*key, "text").unionByName(rest)


def read_blobs(folder: str, part: str = "") -> Iterator[bytes]:
    """The column ``blob`` of a table in the shared folder, or of one partition of it; for workers."""
    system, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://") if "://" in folder else "file://" + folder.removeprefix("file:"))
    for f in sorted(system.get_file_info(fs.FileSelector(f"{path}/{part}".rstrip("/"), allow_not_found=True)), key=lambda x: x.path):
        if f.base_name.endswith(".parquet"):
            for b in parquet.ParquetFile(system.open_input_file(f.path), buffer_size=1 << 20).iter_batches(1, columns=["blob"]):
                yield from b.column(0).to_pylist()
