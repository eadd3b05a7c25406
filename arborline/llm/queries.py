"""The queries of the text problems (p6 to p8). None of them can be put in SQL over whole texts; the tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborline.common import table
from arborline.llm import leakage, mixture, subjects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p7_mixture": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
    "p7_shares": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
    "p8_found": lambda s, d: subjects.document_subjects(table(s, d, "documents"), table(s, d, "subject_examples")),
    "p8_corpus": lambda s, d: subjects.corpus_subjects(table(s, d, "documents"), table(s, d, "subject_examples")),
}

ORACLES: dict[str, str] = {}
