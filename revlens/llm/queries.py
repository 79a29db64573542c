"""The queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from revlens.llm.additive_model import op9_additive_model
from revlens.llm.bloom_digest import op10_bloom_digest
from revlens.llm.bpe_trie import op3_bpe_trie
from revlens.llm.kneser_ney import op8_kneser_ney
from revlens.llm.lanczos import op13_lanczos_whitening
from revlens.llm.line_runs import OP11_SQL, op11_line_runs
from revlens.llm.lsh_forest import op1_lsh_forest
from revlens.llm.mixing import OP7_SQL, op7_fair_mix
from revlens.llm.prefix_trie import OP12_SQL, op12_prefix_rollup
from revlens.llm.sharding import OP6_SQL, op6_extendible_shards
from revlens.llm.token_blocks import op2_token_blocks
from revlens.llm.token_counts import op5_token_counts
from revlens.llm.toxicity import op4_term_automata

QUERIES = {f.__name__: f for f in (
    op1_lsh_forest, op2_token_blocks, op3_bpe_trie, op4_term_automata, op5_token_counts, op6_extendible_shards, op7_fair_mix,
    op8_kneser_ney, op9_additive_model, op10_bloom_digest, op11_line_runs, op12_prefix_rollup, op13_lanczos_whitening)}
SQL = {"op6_extendible_shards": OP6_SQL, "op7_fair_mix": OP7_SQL, "op11_line_runs": OP11_SQL,
       "op12_prefix_rollup": OP12_SQL}
