"""Queries of the training-data operators, and their SQL where SQL can express them."""

from tidewheel.llm.chat import OP8_SQL, op8_chat
from tidewheel.llm.forest import OP5_SQL, op5_forest
from tidewheel.llm.mixing import OP3_SQL, op3_mixing
from tidewheel.llm.ogg import op6_media
from tidewheel.llm.packing import op1_packing
from tidewheel.llm.paragraphs import op7_paragraphs
from tidewheel.llm.pii import op4_pii
from tidewheel.llm.quality import op10_quality
from tidewheel.llm.simhash import op9_simhash
from tidewheel.llm.substrings import op2_substrings

QUERIES = {
    "op1_packing": op1_packing,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_forest": op5_forest,
    "op6_media": op6_media,
    "op7_paragraphs": op7_paragraphs,
    "op8_chat": op8_chat,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
}
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL, "op5_forest": OP5_SQL, "op8_chat": OP8_SQL}
