"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from spreadloom.llm import decontam, exactdedup, lengths, lines, packing, pages, phrases, quality, repair, repeats, secrets, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_lengths": lengths.op2_lengths,
        "op3_exact_dedup": exactdedup.op3_exact_dedup,
        "op4_best_fit": packing.op4_best_fit,
        "op5_lines": lines.op5_lines,
        "op6_secrets": secrets.op6_secrets,
        "op7_rules": quality.op7_rules,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_main_text": pages.op9_main_text,
        "op10_repeats": repeats.op10_repeats,
        "op11_repair": repair.op11_repair,
        "op12_warc": warc.op12_warc,
        "op13_phrases": phrases.op13_phrases,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exactdedup.OP3_SQL, "op5_lines": lines.OP5_SQL, "op12_warc": warc.OP12_SQL, "op13_phrases": phrases.OP13_SQL}
