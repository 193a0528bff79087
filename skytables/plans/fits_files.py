"""FITS files made from a DataFrame, some per partition: input for the FITS reader's checks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..session import shared_folder

TEXT_BYTES = 20
#: Rows of a file, about: what a task holds at a time.
FILE_ROWS = 500_000


def _card(key: str, value) -> str:
    text = f"'{value:<8}'" if isinstance(value, str) else ("T" if value is True else str(value))
    return f"{key:<8}= {text:>20}".ljust(80)


def _block(cards: list[str]) -> bytes:
    text = "".join(cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode("ascii")


def table_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A FITS file with one binary table: doubles and text of TEXT_BYTES bytes."""
    form = {n: "D" if a.dtype.kind == "f" else f"{TEXT_BYTES}A" for n, a in columns.items()}
    kind = {"D": ">f8", f"{TEXT_BYTES}A": f"S{TEXT_BYTES}"}
    rows = np.zeros(len(next(iter(columns.values()))), dtype=[(n, kind[form[n]]) for n in columns])
    for n, a in columns.items():
        rows[n] = a
    primary = _block([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0)])
    cards = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize),
             _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(columns))]
    for i, n in enumerate(columns, 1):
        cards += [_card(f"TTYPE{i}", n), _card(f"TFORM{i}", form[n])]
    body = rows.tobytes()
    return primary + _block(cards) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def _fixed_text(column: pa.ChunkedArray) -> np.ndarray:
    """Text as arrays of TEXT_BYTES bytes, longer text cut, nulls as the word None."""
    return np.array(column.to_pylist(), dtype=f"S{TEXT_BYTES}")


def write_parts(df: DataFrame, file_rows: int = FILE_ROWS) -> str:
    """Writes every partition of `df` (doubles and text) as FITS files of about `file_rows` rows into a shared folder.

    A file is written under another name and moved when complete, so a task that
    runs again replaces its own files.
    """
    folder = shared_folder(df.sparkSession, "fits")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, inner = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        system.create_dir(inner)

        def file(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            columns = {
                n: c.to_numpy() if pa.types.is_floating(c.type) else _fixed_text(c)
                for n, c in zip(whole.column_names, whole.columns)
            }
            name = f"{inner}/part-{task.partitionId():06d}-{number:06d}.fits"
            draft = f"{inner}/.draft-{task.taskAttemptId()}-{number}"
            with system.open_output_stream(draft) as out:
                out.write(table_bytes(columns))
            system.move(draft, name)
            return pa.RecordBatch.from_pydict({"file": [name], "n_rows": [len(whole)]})

        number, held = 0, []
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= file_rows:
                yield file(number, held)
                number, held = number + 1, []
        if held:
            yield file(number, held)

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df.mapInArrow(write, "file string, n_rows bigint").agg({"n_rows": "sum"}).collect()
    return folder
