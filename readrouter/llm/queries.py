"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from . import lines, near_dedup, suffix_dedup, topk
from .common import table


def op1_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark, sf_dir):
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark, sf_dir):
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    from .lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_best_fit(spark, sf_dir):
    from .packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op10_exact_top_k(spark, sf_dir):
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html_text, op3_suffix_dedup, op4_bpe, op5_quality, op6_line_dedup, op7_fingerprints, op8_best_fit, op9_near_dedup, op10_exact_top_k)}
ORACLE_SQL: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op6_line_dedup": lines.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
}
