"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, decontam, embedding, licenses, lines, lm, merkle, pieces, quality, rules, simhash, urls, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_urls": urls.op3_urls,
    "op4_decontam": decontam.op4_decontam,
    "op5_licenses": licenses.op5_licenses,
    "op6_simhash": simhash.op6_simhash,
    "op7_embedding": embedding.op7_embedding,
    "op9_lines": lines.op9_lines,
    "op10_pieces": pieces.op10_pieces,
    "op8_lm": lm.op8_lm,
    "op11_merkle": merkle.op11_merkle,
    "op12_centroids": centroids.op12_centroids,
    "op13_rules": rules.op13_rules,
}
ORACLE_SQL = {
    "op1_warc": warc.SQL1,
    "op5_licenses": licenses.SQL5,
    "op11_merkle": merkle.SQL11,
    "op12_centroids": centroids.SQL12,
}
