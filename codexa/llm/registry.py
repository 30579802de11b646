"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op5_url_filter": "urls",
    "op6_source_mix": "mixing",
    "op2_ogg_media": "ogg",
    "op9_quality": "quality",
    "op7_toxicity": "toxicity",
    "op10_language": "language",
    "op4_ngram_jaccard": "jaccard",
    "op3_suffix_dedup": "suffixes",
    "op8_main_text": "extract",
    "op1_decontaminate": "decontaminate",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: import_module(f"codexa.llm.{module}").query for name, module in _MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = {name: getattr(import_module(f"codexa.llm.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
