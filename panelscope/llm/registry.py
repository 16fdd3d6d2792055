"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from panelscope.llm import decontaminate, hardneg, urlfilter, warc
from panelscope.llm.align import op13_alignment
from panelscope.llm.anomaly import op6_quality_rules
from panelscope.llm.bpe import op1_bpe
from panelscope.llm.brown import op7_brown
from panelscope.llm.chat import op4_chat
from panelscope.llm.decontaminate import op3_decontaminate
from panelscope.llm.hardneg import op11_hard_negatives
from panelscope.llm.linededup import op5_linededup
from panelscope.llm.ordinal import op10_ordinal
from panelscope.llm.simhash import op9_simhash
from panelscope.llm.toxicity import op2_toxicity
from panelscope.llm.urlfilter import op12_url_filter
from panelscope.llm.warc import op8_warc

QUERIES = {q.__name__: q for q in (op1_bpe, op2_toxicity, op3_decontaminate, op4_chat, op5_linededup, op6_quality_rules, op7_brown, op8_warc, op9_simhash, op10_ordinal, op11_hard_negatives, op12_url_filter, op13_alignment)}
ORACLES: dict[str, str] = {"op3_decontaminate": decontaminate.SQL.strip(), "op8_warc": warc.SQL.strip(), "op11_hard_negatives": hardneg.SQL.strip(), "op12_url_filter": urlfilter.sql().strip()}
