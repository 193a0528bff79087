"""Text files made from a DataFrame, one per row: input for the readers of saved responses."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder

#: Folders that the files are dealt into.
FOLDERS = 64


def write_texts(df: DataFrame, purpose: str) -> str:
    """Writes `value` of every row as a file of its own, named by `file` (unique), into a new shared folder.

    Tasks write the files themselves, in a bounded number of folders: no folder per file, and no
    move of each file by the driver. A task that runs again replaces its own files.
    """
    folder = shared_folder(df.sparkSession, purpose)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for i in range(FOLDERS):
            system.create_dir(f"{inner}/{i:03d}")
        for batch in batches:
            for within, file, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_output_stream(f"{inner}/{within:03d}/{file}") as out:
                    out.write(f"{value}\n".encode())
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    within = F.pmod(F.xxhash64("file"), F.lit(FOLDERS))
    df.select(within, "file", "value").mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()
    return folder
