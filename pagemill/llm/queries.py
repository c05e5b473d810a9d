"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pagemill.llm import credentials, fingerprints, language, licenses, line_dedup, media, mixing, packing, quality, simhash, spelling, substrings, tries

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_packing": packing.op3_packing,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_language_id": language.op5_language_id,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality": quality.op9_quality,
    "op10_media": media.op10_media,
    "op11_prefix_trie": tries.op11_prefix_trie,
    "op12_secrets": credentials.op12_secrets,
    "op13_spelling": spelling.op13_spelling,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {"op1_line_dedup": line_dedup.ORACLE, "op4_substring_dedup": substrings.ORACLE, "op6_mixing": mixing.ORACLE, "op8_license_scan": licenses.ORACLE,
          "op11_prefix_trie": tries.ORACLE, "op13_spelling": spelling.ORACLE}
