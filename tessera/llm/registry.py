"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.llm import audit, decontaminate, htmltext, infill, langid, licenses, lmscore, mixing, packing, prefixhash, secrets, simhash, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_langid": langid.op2_langid,
        "op3_fingerprints": prefixhash.op3_fingerprints,
        "op4_secrets": secrets.op4_secrets,
        "op5_htmltext": htmltext.op5_htmltext,
        "op6_lmscore": lmscore.op6_lmscore,
        "op7_mixing": mixing.op7_mixing,
        "op8_licenses": licenses.op8_licenses,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_packing": packing.op11_packing,
        "op12_audit": audit.op12_audit,
        "op13_infill": infill.op13_infill,
    }


def oracle_sql() -> dict:
    return {"op7_mixing": mixing.oracle(), "op12_audit": audit.oracle(), "op13_infill": infill.oracle()}
