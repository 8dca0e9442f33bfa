"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import chat, decontaminate, language, leaks, lines, merkle, pieces, pitman_yor, quality, search, simhash, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_warc": warc.op2_warc,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_perspectives": chat.op6_perspectives,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pitman_yor": pitman_yor.op9_pitman_yor,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_secrets": leaks.op11_secrets,
    "op12_merkle": merkle.op12_merkle,
    "op13_search": search.op13_search,
}
ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op6_perspectives": chat.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_search": search.ORACLE,
}
