"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, chat, decontaminate, licenses, lines, minmax, mixing, periodic, ppm, quality, sharding, simhash, tokens

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_sharding,
        tokens.op2_token_counts,
        chat.op3_chat_perspectives,
        lines.op4_line_dedup,
        quality.op5_quality,
        ppm.op6_lm_score,
        licenses.op7_licenses,
        decontaminate.op8_decontaminate,
        simhash.op9_simhash,
        mixing.op10_mixing,
        minmax.op11_minmax,
        audit.op12_filter_audit,
        periodic.op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_chat_perspectives": chat.OP3_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op12_filter_audit": audit.OP12_SQL, "op13_periodic_runs": periodic.OP13_SQL}
