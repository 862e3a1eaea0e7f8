"""The registered query of each pipeline operator, and the SQL twins."""

from __future__ import annotations

from wordweft.llm.adaptive_rules import op2_adaptive_rules
from wordweft.llm.bilinear_lm import op10_bilinear_lm
from wordweft.llm.bpe import op5_bpe
from wordweft.llm.chat_format import INSTRUCT, op6_chat_format
from wordweft.llm.dart_minhash import op7_dart_minhash
from wordweft.llm.length_buckets import op9_packing
from wordweft.llm.progressive_jpeg import op3_progressive_jpeg
from wordweft.llm.rule_ensemble import op1_rule_ensemble
from wordweft.llm.secret_scan import op4_secret_scan
from wordweft.llm.suffix_dedup import op8_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_rule_ensemble, op2_adaptive_rules, op3_progressive_jpeg, op4_secret_scan, op5_bpe, op6_chat_format, op7_dart_minhash, op8_suffix_dedup, op9_packing, op10_bilinear_lm)}

def _chat_sql(template=INSTRUCT) -> str:
    """The chat query: turns and learnt texts as they were said, and the length of what the template makes of them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(c: str) -> str:
        c = f"replace({c}, '\\', '\\\\')"
        for mark in template.controls:
            c = f"replace({c}, {quoted(mark)}, {quoted(mark[0] + chr(92) + mark[1:])})"
        return c

    opening = f"length({escaped('role')}) + {sum(map(len, template.other))}"
    opens = "CASE role " + " ".join(f"WHEN {quoted(r)} THEN {len(m)}" for r, m in template.opens.items()) + f" ELSE {opening} END"
    learnt = "role IN (" + ", ".join(map(quoted, sorted(template.loss))) + ")"
    return f"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE {learnt}), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE {learnt}), '')) AS loss_sha256,
  sum({opens} + length({escaped('text')}) + {len(template.close)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


#: The others have no SQL form: learnt models, sketches, byte-level suffixes, files, merges, dynamic programmes. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op6_chat_format": _chat_sql()}
