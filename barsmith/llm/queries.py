"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from barsmith.llm import chat, fingerprints, lattice, licenses, middle, mixing, packing, quality, repeats, simhash, toxicity, urls, variants

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_licenses": licenses.op2_licenses,
    "licenses_planted": licenses.licenses_planted,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_url_filter": urls.op6_url_filter,
    "op7_embeddings": lattice.op7_embeddings,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_chat": chat.op10_chat,
    "op11_repeats": repeats.op11_repeats,
    "op12_variants": variants.op12_variants,
    "op13_middle": middle.op13_middle,
}

ORACLES: dict[str, str] = {
    "op2_licenses": licenses.ORACLE,
    "licenses_planted": licenses.PLANTED_ORACLE,
    "op6_url_filter": urls.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_repeats": repeats.ORACLE,
    "op12_variants": variants.ORACLE,
    "op13_middle": middle.ORACLE,
}
