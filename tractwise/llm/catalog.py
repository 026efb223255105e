"""Registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from tractwise.llm.collocations import OP12_SQL, op12_phrase_collocations
from tractwise.llm.decontaminate import OP3_SQL, op3_benchmark_decontamination
from tractwise.llm.lines import OP9_SQL, op9_segment_edit_join
from tractwise.llm.minhash import OP11_SQL, op11_circulant_minhash
from tractwise.llm.nearest import op4_one_bit_neighbours
from tractwise.llm.ngram_join import OP6_SQL, op6_parity_sketch_join
from tractwise.llm.packing import op5_packing
from tractwise.llm.records import op1_binary_records
from tractwise.llm.rules import op10_rule_ensemble
from tractwise.llm.secret_scan import op8_secret_scan
from tractwise.llm.substrings import op7_suffix_dedup
from tractwise.llm.trie import OP13_SQL, op13_conversation_trie
from tractwise.llm.urls import op2_url_language_model

QUERIES = {
    "op1_binary_records": op1_binary_records,
    "op2_url_language_model": op2_url_language_model,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_one_bit_neighbours": op4_one_bit_neighbours,
    "op5_packing": op5_packing,
    "op6_parity_sketch_join": op6_parity_sketch_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_segment_edit_join": op9_segment_edit_join,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op11_circulant_minhash": op11_circulant_minhash,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES = {
    "op3_benchmark_decontamination": OP3_SQL,
    "op6_parity_sketch_join": OP6_SQL,
    "op9_segment_edit_join": OP9_SQL,
    "op11_circulant_minhash": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_conversation_trie": OP13_SQL,
}
