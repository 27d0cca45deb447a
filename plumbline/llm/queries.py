"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from plumbline.llm import ballkmeans, chat, decontam, langid, linededup, matroska, mixing, phrases, quality, simhash, urlfilter, vectorcodes, warc

QUERIES = {
    "op1_chat_format": chat.op1,
    "op2_warc_index": warc.op2,
    "op3_quality": quality.op3,
    "op4_matroska": matroska.op4,
    "op5_line_dedup": linededup.op5,
    "op6_mixing": mixing.op6,
    "op7_langid": langid.op7,
    "op8_simhash": simhash.op8,
    "op9_decontam": decontam.op9,
    "op10_url_filter": urlfilter.op10,
    "op11_vector_codes": vectorcodes.op11,
    "op12_phrase_automata": phrases.op12,
    "op13_ball_kmeans": ballkmeans.op13,
}

ORACLES = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_warc_index": warc.OP2_SQL,
    "op5_line_dedup": linededup.OP5_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
    "op11_vector_codes": vectorcodes.OP11_SQL,
    "op12_phrase_automata": phrases.OP12_SQL,
    "op13_ball_kmeans": ballkmeans.OP13_SQL,
}
