"""Contract queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroids
from .ctw import op9_lm_score
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .exact_topk import OP1_SQL, op1_exact_topk
from .mixing import op10_mix_sources
from .ngram_join import OP13_SQL, op13_ngram_join
from .pii import op2_pii
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op5_quality
from .secrets import op3_secrets
from .sentencepiece import op7_sentencepiece
from .simhash import op8_simhash
from .url_filter import OP6_SQL, op6_url_filter

QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_pii, op3_secrets, op4_exact_dedup, op5_quality, op6_url_filter, op7_sentencepiece, op8_simhash, op9_lm_score, op10_mix_sources, op11_centroids, op12_prefix_trie, op13_ngram_join)}
ORACLE_SQL = {"op1_exact_topk": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op11_centroids": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_ngram_join": OP13_SQL}
