"""Sample sheets: sections of comma-separated rows, without quoting; read on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ord bigint, sample_id string, index1 string, index2 string, lane bigint"
# The sections that hold samples, and the names of their columns.
SECTIONS = ("BCLConvert_Data", "Data")
ALIASES = {
    "sample_id": ("sample_id", "sampleid", "sample"),
    "index1": ("index", "index1", "i7_index_id"),
    "index2": ("index2", "i5_index_id"),
    "lane": ("lane",),
}
BLANKS = " \t\r\n"


def _lane(text: str) -> int:
    digits = text.lstrip(BLANKS)
    sign, digits = (-1, digits[1:]) if digits[:1] == "-" else (1, digits.removeprefix("+"))
    end = next((i for i, c in enumerate(digits) if not c.isdigit()), len(digits))
    return sign * int(digits[:end]) if end else 0


def parse(text: str) -> list[tuple[int, str, str, str, int]]:
    """(order, sample, first index, second index, lane; 0 for any lane) of every sample."""
    rows, inside, columns = [], False, None
    for line in text.split("\n"):
        line = line.removeprefix("﻿").strip(BLANKS)
        if not line:
            continue
        if line.startswith("["):
            inside, columns = line[1 : line.find("]")] in SECTIONS if "]" in line else False, None
            continue
        if not inside:
            continue
        cells = [c.strip(BLANKS) for c in line.split(",")]
        if columns is None:
            names = [c.lower() for c in cells]
            if any(n in ALIASES["sample_id"] for n in names):
                # Of several columns of one meaning the last counts.
                columns = {k: max((i for i, n in enumerate(names) if n in known), default=None) for k, known in ALIASES.items()}
            continue
        cell = lambda k: cells[columns[k]] if columns[k] is not None and columns[k] < len(cells) else ""  # noqa: E731, B023
        if cell("sample_id") and cell("sample_id") not in ("Sample_ID", "SampleID"):
            rows.append((len(rows), cell("sample_id"), cell("index1"), cell("index2"), _lane(cell("lane"))))
    return rows


def parse_positional(text: str) -> list[tuple[int, str, str, str, int]]:
    """As parse, of sheets read by position: after [Data] and one header row, the sample's name second, indexes eighth and ninth; NA is no index."""
    rows, lines = [], iter(text.split("\n"))
    for line in lines:
        if "[Data]" in line:
            next(lines, None)
            break
    for line in lines:
        line = line.strip(BLANKS)
        if line.startswith("["):
            break
        if line:
            cells = [*(c.strip(BLANKS) for c in line.split(",")), *[""] * 9]
            rows.append((len(rows), cells[1], cells[7], "" if cells[8] == "NA" else cells[8], 0))
    return rows


def load(spark: SparkSession, path: str, positional: bool = False) -> DataFrame:
    """The samples of a sheet that Spark can read, in file order."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    rows = (parse_positional if positional else parse)("\n".join(lines))
    if not rows:
        raise ValueError(f"{path}: no samples in the sample sheet")
    return spark.createDataFrame(rows, SCHEMA)
