"""Queries and SQL of the training-data operators."""

from rebill.llm import archive, decontamination, language, minhash, mixing, neighbours, ngram_lm, piece, prefixes, simhash, substring, toxicity, whitening

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_language": language.op2_language,
    "op3_warc": archive.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_ngram_lm": ngram_lm.op7_ngram_lm,
    "op8_pieces": piece.op8_pieces,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring": substring.op10_substring,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_prefixes": prefixes.op12_prefixes,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {"op3_warc": archive.ORACLE, "op11_decontamination": decontamination.ORACLE, "op12_prefixes": prefixes.ORACLE}
