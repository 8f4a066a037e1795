"""The registered queries of the package, and their SQL where SQL can express them."""
from . import bpe, decontamination, embeddings, jaccard, langid, licenses, lm, merkle, periodic, substring, tokenfile, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_substring_dedup": substring.query,
    "op3_license_scan": licenses.query,
    "op4_jaccard_join": jaccard.query,
    "op5_lm_score": lm.query,
    "op6_langid": langid.query,
    "op7_warc": warc.query,
    "op8_bpe": bpe.query,
    "op9_embedding_dedup": embeddings.query,
    "op10_toxicity": toxicity.query,
    "op11_token_files": tokenfile.query,
    "op12_merkle_manifest": merkle.query,
    "op13_periodic_runs": periodic.query,
}
ORACLES = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_substring_dedup": substring.ORACLE,
    "op4_jaccard_join": jaccard.ORACLE,
    "op7_warc": warc.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
