"""FITS binary tables as a Spark data source.

    register(spark)
    spark.read.format("fits_table").option("hdu", 1).load(path)

`path` is a file or a folder of files with the same table. Files are split into
row ranges by size; every task reads the header of its own file, then only the
bytes of its rows, and decodes them with a numpy record type into Arrow batches.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK, CARD = 2880, 80
#: FITS format letters: numpy type and Spark type (fixed values).
FORMATS = {
    "L": ("S1", T.BooleanType()), "B": ("u1", T.ShortType()), "I": (">i2", T.ShortType()),
    "J": (">i4", T.IntegerType()), "K": (">i8", T.LongType()), "E": (">f4", T.FloatType()),
    "D": (">f8", T.DoubleType()), "A": ("S", T.StringType()),
}
#: Letters that are not read, with their bytes an element (fixed values): complex numbers and descriptors of
#: variable-length arrays. Bits (X) take a byte for eight.
SKIPPED = {"C": 8, "M": 16, "P": 8, "Q": 16, "X": 1}
SPLIT_BYTES = 64 * 1024 * 1024
BATCH_ROWS = 65_536
#: With more ranges than this, they are made larger, up to SPLIT_BYTES: a task costs more than reading a small one.
RANGES = 64


class Column:
    """One column of the table: where it is in a row and how it is read. One that is not read has no `kind`."""

    def __init__(self, name: str, form: str, scale: float, zero: float, null: int | None = None):
        found = re.fullmatch(r"(\d*)([LBIJKEDACMPQX])\S*", form.strip())
        if found is None:
            raise ValueError(f"column {name}: format {form!r} is not supported")
        self.name, self.letter = name, found.group(2)
        self.repeat = int(found.group(1) or 1)
        self.scale, self.zero, self.null = scale, zero, null
        if self.letter in SKIPPED:
            n = -(-self.repeat // 8) if self.letter == "X" else self.repeat
            self.dtype, self.kind = (name, f"V{n * SKIPPED[self.letter]}"), None
            return
        code, kind = FORMATS[self.letter]
        if self.letter == "A":
            self.dtype = (name, f"S{self.repeat}")
        else:
            self.dtype = (name, code) if self.repeat == 1 else (name, code, (self.repeat,))
        if scale != 1 or (zero != 0 and self.letter in "ED"):
            kind = T.DoubleType()
        elif zero != 0:
            kind = T.LongType()
        self.kind = kind if self.letter == "A" or self.repeat == 1 else T.ArrayType(kind)

    def decode(self, raw: np.ndarray, arrow: pa.DataType) -> pa.Array:
        if self.letter == "A":
            text = np.char.rstrip(np.char.decode(raw, "ascii"), "\x00 ")
            return pa.array(text.tolist(), pa.string())
        none = None
        if self.letter == "L":
            native = raw == b"T"
            none = ~native & (raw != b"F")
        else:
            native = raw.astype(raw.dtype.newbyteorder("="))
            if self.null is not None and self.letter in "BIJK":
                none = native == self.null
        if self.scale != 1:
            native = native * self.scale + self.zero
        elif self.zero != 0:
            native = native.astype("f8" if self.letter in "ED" else "i8") + (
                self.zero if self.letter in "ED" else int(self.zero))
        if self.repeat == 1:
            return pa.array(native, mask=none).cast(arrow)
        if none is None or not none.any():
            return pa.array(list(native)).cast(arrow)
        return pa.array([[None if m else v for v, m in zip(*row, strict=True)] for row in zip(native.tolist(), none.tolist(), strict=True)]).cast(arrow)


class Table:
    """What the header says: the columns, the size of a row, how many, and where they start."""

    def __init__(self, stream, hdu: int):
        cards, start = self._header(stream, 0)
        for _ in range(hdu):
            cards, start = self._header(stream, start + self._data_bytes(cards))
        if cards.get("XTENSION") != "BINTABLE":
            raise ValueError(f"HDU {hdu} is not a binary table")
        self.start, self.row_bytes, self.n_rows = start, int(cards["NAXIS1"]), int(cards["NAXIS2"])
        columns = [
            Column(cards[f"TTYPE{i}"], cards[f"TFORM{i}"], float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)),
                   int(cards[f"TNULL{i}"]) if f"TNULL{i}" in cards else None)
            for i in range(1, int(cards["TFIELDS"]) + 1)
        ]
        self.columns = [c for c in columns if c.kind is not None]
        self.dtype = np.dtype([c.dtype for c in columns])
        if self.dtype.itemsize != self.row_bytes:
            raise ValueError(f"columns add up to {self.dtype.itemsize} bytes, a row has {self.row_bytes}")

    @staticmethod
    def _header(stream, at: int) -> tuple[dict[str, str], int]:
        stream.seek(at)
        cards: dict[str, str] = {}
        while True:
            block = stream.read(BLOCK)
            if len(block) < BLOCK:
                raise ValueError("the file ends inside a header")
            at += BLOCK
            for i in range(0, BLOCK, CARD):
                card = bytes(block[i:i + CARD]).decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    return cards, at
                if card[8:10] == "= ":
                    value = card[10:].strip()
                    quoted = re.match(r"'((?:[^']|'')*)'", value)
                    cards[key] = quoted.group(1).replace("''", "'").rstrip() if quoted else value.split("/")[0].strip()

    @staticmethod
    def _data_bytes(cards: dict[str, str]) -> int:
        axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards["NAXIS"]) + 1)]
        if not axes:
            return 0
        cells = int(np.prod(axes, dtype=np.int64)) + int(cards.get("PCOUNT", 0))
        size = abs(int(cards["BITPIX"])) // 8 * int(cards.get("GCOUNT", 1)) * cells
        return -(-size // BLOCK) * BLOCK


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.Directory:
        listed = system.get_file_info(pafs.FileSelector(inner))
        files = sorted((f for f in listed if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)
    else:
        files = [info] if info.is_file else []
    if not files:
        raise ValueError(f"no FITS file at {path}")
    return system, files


class RowRange(InputPartition):
    """Part `part` of `parts` of the rows of one file."""

    def __init__(self, file: str, part: int, parts: int):
        self.file, self.part, self.parts = file, part, parts


class FitsReader(DataSourceReader):
    def __init__(self, path: str, hdu: int, split_bytes: int, schema: T.StructType):
        self.path, self.hdu, self.split_bytes = path, hdu, split_bytes
        self.names = schema.names

    def partitions(self) -> list[InputPartition]:
        ranges, files = [], _files(self.path)[1]
        split = max(self.split_bytes, min(SPLIT_BYTES, sum(f.size for f in files) // RANGES))
        for f in files:
            parts = max(1, -(-f.size // split))
            ranges.extend(RowRange(f.path, i, parts) for i in range(parts))
        return ranges

    def read(self, partition: RowRange):
        system = _filesystem(self.path)[0]
        with system.open_input_file(partition.file) as stream:
            table = Table(stream, self.hdu)
            columns = {c.name: c for c in table.columns}
            first = table.n_rows * partition.part // partition.parts
            last = table.n_rows * (partition.part + 1) // partition.parts
            for at in range(first, last, BATCH_ROWS):
                n = min(BATCH_ROWS, last - at)
                stream.seek(table.start + at * table.row_bytes)
                rows = np.frombuffer(stream.read(n * table.row_bytes), dtype=table.dtype)
                arrays = [columns[c].decode(rows[c], _arrow(columns[c].kind)) for c in self.names]
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {
        "boolean": pa.bool_(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(),
        "float": pa.float32(), "double": pa.float64(), "string": pa.string(),
    }[kind.typeName()]


class FitsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _hdu(self) -> int:
        return int(self.options.get("hdu", "1"))

    def schema(self) -> T.StructType:
        system, files = _files(self.options["path"])
        with system.open_input_file(files[0].path) as stream:
            table = Table(stream, self._hdu())
        return T.StructType([T.StructField(c.name, c.kind) for c in table.columns])

    def reader(self, schema: T.StructType) -> FitsReader:
        split = int(self.options.get("split_bytes", str(SPLIT_BYTES)))
        return FitsReader(self.options["path"], self._hdu(), split, schema)


def register(spark: SparkSession) -> None:
    """Makes format `fits_table` known. The classes travel with the plan, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FitsSource)


def read_fits(spark: SparkSession, path: str, hdu: int = 1, split_bytes: int = SPLIT_BYTES):
    register(spark)
    return (
        spark.read.format("fits_table").option("hdu", str(hdu)).option("split_bytes", str(split_bytes)).load(path)
    )
