"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from colophon.llm import bestfit, codes, fingerprints, langid, licenses, mixing, packing, rules, simhash, tokenfiles, urls, warc, whitening
from colophon.llm.common import table


def op1_language_id(spark, sf_dir):
    return langid.op1_language_id(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_url_filter": urls.op3_url_filter,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_packing": packing.op6_packing,
    "op7_token_files": tokenfiles.op7_token_files,
    "op8_simhash": simhash.op8_simhash,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_arc_to_warc": warc.op10_arc_to_warc,
    "op11_whitening": whitening.op11_whitening,
    "op12_best_fit": bestfit.op12_best_fit,
    "op13_vector_codes": codes.op13_vector_codes,
}
ORACLES = {"op4_quality_rules": rules.OP4_SQL}
