"""Base-call, barcode and read expressions as columns; no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public adapter sequences that mark a read as contamination.
ADAPTERS = (
    "CTGTCTCTTATACACATCT",
    "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "AATGATACGGCGACCACCGAGATCTACAC",
    "CAAGCAGAAGACGGCATACGAGAT",
)
#: Symbols that a decoded read can hold.
ALPHABET = "ACGTN"


def base(call: Column) -> Column:
    """The base of a base-call byte: N where its quality is 0."""
    return F.when(F.shiftright(call, 2).bitwiseAND(63) == 0, "N").otherwise(F.substring(F.lit("ACGT"), call.bitwiseAND(3) + 1, F.lit(1)))


def quality(call: Column) -> Column:
    """The quality character of a base-call byte."""
    return F.char(F.shiftright(call, 2).bitwiseAND(63) + 33)


def nibble(byte: Column, cluster: Column) -> Column:
    """The 4 bits of a cluster in a byte for two: the even one is low."""
    return F.when(cluster % 2 == 0, byte.bitwiseAND(15)).otherwise(F.shiftright(byte, 4).bitwiseAND(15))


def binned_quality(bits: Column) -> Column:
    """The quality of a 2-bit bin on the linear map: 2, 12, 22, 32."""
    return bits * 10 + 2


def call_byte(base_bits: Column, quality_value: Column) -> Column:
    return F.shiftleft(quality_value, 2).bitwiseOR(base_bits)


def reverse_complement(sequence: Column, fold_case: bool = True) -> Column:
    """Complement, other symbols to N, and reverse; without fold_case lower case counts as other."""
    given = F.upper(sequence) if fold_case else sequence
    return F.reverse(F.translate(F.regexp_replace(given, "[^ACGT]", "N"), "ACGT", "TGCA"))


def combined_barcode(index1: Column, index2: Column, flip: Column) -> Column:
    return F.concat(index1, F.when(flip & (index2 != ""), reverse_complement(index2)).otherwise(index2))


def read_key(index1: Column, index2: Column, length1: int, length2: int) -> Column:
    """Both indexes cut or padded with N to the barcode's lengths."""
    first = F.rpad(index1, length1, "N")
    return F.concat(first, F.rpad(index2, length2, "N")) if length2 else first


def has_adapter(sequence: Column, adapters: tuple[str, ...] = ADAPTERS) -> Column:
    found = F.lit(False)
    for a in adapters:
        found = found | sequence.contains(a)
    return found


def trim_position(sequence: Column, adapter: str, least: int = 10) -> Column:
    """The first position from `least` on where the read goes on as the adapter does, for `least` symbols or more; else the length."""
    n = F.length(sequence)
    if len(adapter) < least:
        return n
    k = lambda p: F.least(F.lit(len(adapter)), n - p)
    hits = F.filter(F.sequence(F.lit(least), n - least), lambda p: F.substring(sequence, p + 1, k(p)) == F.substring(F.lit(adapter), F.lit(1), k(p)))
    return F.when(n < 2 * least, n).otherwise(F.coalesce(F.array_min(hits), n))


def quality_fraction(qualities: Column, least: int) -> Column:
    """Share of the characters whose quality is `least` or more; null for an empty read."""
    low = "".join(rf"\x{33 + q:02x}" for q in range(least))
    kept = F.length(F.regexp_replace(qualities, f"[{low}]", "")) if low else F.length(qualities)
    return F.when(F.length(qualities) > 0, kept / F.length(qualities))


def segment(calls: Column, start: int, length: int) -> Column:
    return F.substring(calls, start + 1, length)


def lane_tag(lane: Column) -> Column:
    return F.format_string("L%03d", lane)


def fastq_record(name: Column, number: Column, sequence: Column, qualities: Column, mate: str = "") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), name, F.lit("_"), number.cast("string"), F.lit(mate)), sequence, F.lit("+"), qualities)


def hamming(a: Column, b: Column, length: int) -> Column:
    """Number of positions that differ, as a sum over the positions."""
    total = F.lit(0)
    for i in range(1, length + 1):
        total = total + F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1).otherwise(0)
    return total


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"
