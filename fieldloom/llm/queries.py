"""Registered queries of the training-data operators."""

from __future__ import annotations

from . import audio, chat, decontam, htmltree, langid, linededup, mixing, periods, phrases, resample, secrets, simhash, suffixes

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_mixing": mixing.op2_mixing,
    "op3_audio": audio.op3_audio,
    "op4_main_text": htmltree.op4_main_text,
    "op5_simhash": simhash.op5_simhash,
    "op6_secrets": secrets.op6_secrets,
    "op7_lines": linededup.op7_lines,
    "op8_phrases": phrases.op8_phrases,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_periods": periods.op11_periods,
    "op12_resample": resample.op12_resample,
    "op13_chat": chat.op13_chat,
}
ORACLE = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op8_phrases": phrases.ORACLE_SQL,
    "op9_suffixes": suffixes.ORACLE_SQL,
    "op10_decontaminate": decontam.ORACLE_SQL,
    "op12_resample": resample.ORACLE_SQL,
    "op13_chat": chat.ORACLE_SQL,
}
