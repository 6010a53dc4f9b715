"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from evidex.llm.byte_bpe import op10_byte_bpe
from evidex.llm.embedding_dedup import LOOSE_SQL, OP7_SQL, embedding_links_loose, op7_embedding_dedup
from evidex.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from evidex.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from evidex.llm.kneser_ney import op4_kneser_ney
from evidex.llm.license_scan import op8_license_scan
from evidex.llm.license_sql import OP8_SQL
from evidex.llm.line_dedup import OP3_SQL, op3_line_dedup
from evidex.llm.merkle import op13_merkle_manifest
from evidex.llm.merkle_sql import OP13_SQL
from evidex.llm.mixing import op5_mixing
from evidex.llm.piece_bpe import op11_piece_bpe
from evidex.llm.quality import op2_quality
from evidex.llm.simhash_dedup import op1_simhash_dedup
from evidex.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle_manifest": op13_merkle_manifest,
    "embedding_links_loose": embedding_links_loose,
}
ORACLES = {
    "op3_line_dedup": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
    "embedding_links_loose": LOOSE_SQL,
}
