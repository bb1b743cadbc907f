"""Reports of runs: a JSON file for each run, and a summary of all runs as CSV and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import telemetry_summary


def write_runs(telemetry: DataFrame, run: str, value: str, folder: str) -> None:
    """A folder of JSON for each run (run=<name>) with its samples' number, average, least, greatest and rise."""
    telemetry_summary(telemetry, run, value).withColumnRenamed(run, "run").write.mode("overwrite").partitionBy("run").json(folder)


def write_summary(rows: DataFrame, folder: str) -> None:
    """The summary rows as <folder>/summary.csv with a header and <folder>/summary.json, both folders of Spark; there is one row for each run."""
    one = rows.coalesce(1)
    one.write.mode("overwrite").option("header", "true").csv(f"{folder}/summary.csv")
    one.write.mode("overwrite").json(f"{folder}/summary.json")


def read_summary(spark, folder: str, schema: str, kind: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.json(f"{folder}/summary.json") if kind == "json" else reader.option("header", "true").csv(f"{folder}/summary.csv")


def _two_digits(x) -> "F.Column":
    """A double of 0 or more below 2^63 as text with two digits, by its exact binary value and halves to even, as C's printf; its decimal form may look like a half that it is not."""
    whole = F.floor(x)
    hundred = ((x - whole) * F.lit(2.0**56)).cast("bigint") * 100  # exact for whole numbers over a power of 2 of up to 56
    cents, rest = F.shiftright(hundred, 56), hundred.bitwiseAND(F.lit((1 << 56) - 1))
    cents = cents + F.when((rest > 1 << 55) | (rest == 1 << 55) & (cents % 2 == 1), 1).otherwise(0)
    return F.format_string("%d.%02d", whole + F.when(cents == 100, 1).otherwise(0), cents % 100)


def human_size(n) -> "F.Column":
    """Whole bytes as text with two digits: B, KB, MB, GB or TB; null of null."""

    def of(unit: str, power: int):
        x = n / F.lit(1024.0**power)
        exact = F.concat(F.when(n < 0, "-").otherwise(""), _two_digits(F.abs(x)), F.lit(f" {unit}"))
        return F.when(F.abs(x) < 2.0**63, exact).otherwise(F.format_string(f"%.2f {unit}", F.bround(x, 2)))

    text = of("TB", 4)
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        text = F.when(n < 1024 ** (i + 1), of(unit, i)).otherwise(text)
    return F.when(n.isNotNull(), text)
