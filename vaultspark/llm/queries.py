"""The queries of this subpackage and their SQL, for `__spark_entry__.py`."""

from __future__ import annotations

from vaultspark.llm import ann, chat, language, minhash, mixing, ngram_join, packing, periodic, secrets, substring, tokens, topk, whitening

QUERIES = {
    "op1_language": language.op1_language,
    "op2_tokens": tokens.op2_tokens,
    "op3_mixing": mixing.op3_mixing,
    "op4_substrings": substring.op4_substrings,
    "op5_packing": packing.op5_packing,
    "op6_neardup": minhash.op6_neardup,
    "op7_chat": chat.op7_chat,
    "op8_neighbours": ann.op8_neighbours,
    "op9_topk": topk.op9_topk,
    "op10_secrets": secrets.op10_secrets,
    "op11_whitening": whitening.op11_whitening,
    "op12_runs": periodic.op12_runs,
    "op13_ngram_join": ngram_join.op13_ngram_join,
}
