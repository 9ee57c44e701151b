"""Registered queries of the subpackage: each operator over the whole of its table."""

from __future__ import annotations

import public_tokenizers

from . import decontaminate, fuzzyhash, language, merkle, mixing, ordinal, periodic, preference, sharding, simhash, substring, tokenfile, toxicity
from .store import table

#: The vocabulary file is a parameter of the operator and stays outside the repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def registry() -> dict:
    """Name to query and SQL; None where SQL can't express the query."""
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_token_files": (lambda s, d: tokenfile.digest(docs(s, d), TOKENIZER), None),
        "op2_source_mix": (lambda s, d: mixing.digest(docs(s, d)), None),
        "op3_fuzzy_fingerprints": (lambda s, d: fuzzyhash.compared(docs(s, d)), None),
        "op4_preference_pairs": (lambda s, d: preference.digest(table(s, d, "conversations")), preference.SQL),
        "op5_substring_dedup": (lambda s, d: substring.digest(docs(s, d)), None),
        "op6_ordinal_quality": (lambda s, d: ordinal.digest(docs(s, d), table(s, d, "labels")), None),
        "op7_benchmark_matches": (lambda s, d: decontaminate.digest(docs(s, d), table(s, d, "benchmark")), None),
        "op8_hash_shards": (lambda s, d: sharding.digest(docs(s, d)), None),
        "op9_toxicity": (lambda s, d: toxicity.digest(docs(s, d), table(s, d, "labels")), None),
        "op10_simhash_components": (lambda s, d: simhash.digest(docs(s, d)), None),
        "op11_merkle_manifest": (lambda s, d: merkle.digest(docs(s, d)), None),
        "op12_periodic_runs": (lambda s, d: periodic.digest(docs(s, d)), None),
        "op13_language": (lambda s, d: language.digest(docs(s, d)), None),
    }
