"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from tilelake.llm.bpe import op9_byte_bpe
from tilelake.llm.fingerprints import op8_fingerprints
from tilelake.llm.langid import op13_language_id
from tilelake.llm.media import op3_media_columns
from tilelake.llm.merkle import SQL as MERKLE_SQL
from tilelake.llm.merkle import op11_merkle_manifest
from tilelake.llm.ngram_join import op1_ngram_join
from tilelake.llm.packing import op5_packing
from tilelake.llm.pii import op6_personal_data
from tilelake.llm.secrets import op10_secret_scan
from tilelake.llm.sharding import op7_hilbert_shards
from tilelake.llm.substring_dedup import op2_substring_dedup
from tilelake.llm.toxicity import op4_toxicity
from tilelake.llm.trie import SQL as TRIE_SQL
from tilelake.llm.trie import op12_prefix_trie

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_personal_data": op6_personal_data,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_fingerprints": op8_fingerprints,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_language_id": op13_language_id,
}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL, "op12_prefix_trie": TRIE_SQL}
