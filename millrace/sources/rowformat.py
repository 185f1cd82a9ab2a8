"""The row format of key-value stores: ``key SP (column SP length SP bytes SP)*``, one row to a line end; and file names made of keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def parse_rows(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(row_key, column, value) of every cell. A row without cells gives none; a cut-off row is an error."""
    at, n = 0, len(data)
    while at < n:
        end = data.index(b" ", at)
        key = data[at:end].decode()
        at = end + 1
        while at < n and data[at : at + 1] != b"\n":
            end = data.index(b" ", at)
            column = data[at:end].decode()
            at = end + 1
            end = data.index(b" ", at)
            size = int(data[at:end])
            at = end + 1
            if at + size > n:
                raise ValueError(f"row {key} is cut off")
            yield key, column, data[at : at + size]
            at += size + 1
        at += 1


def format_row(key: str, cells: dict[str, bytes]) -> bytes:
    return key.encode() + b" " + b"".join(c.encode() + b" " + str(len(v)).encode() + b" " + v + b" " for c, v in sorted(cells.items())) + b"\n"


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """row_key, col, value of all files under a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame([(k, c, v.decode("utf-8", "replace")) for k, c, v in parse_rows(bytes(content))], columns=["row_key", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row_key string, col string, value string")


def encode_key(key: str) -> str:
    """A key as a file name: other characters than letters, digits and hyphens as an underscore and two hex digits of each byte."""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or b == 45 else f"_{b:02x}" for b in key.encode())


def decode_key(name: str) -> str:
    out, at = bytearray(), 0
    while at < len(name):
        if name[at] == "_":
            out.append(int(name[at + 1 : at + 3], 16))
            at += 3
        else:
            out.append(ord(name[at]))
            at += 1
    return out.decode()
