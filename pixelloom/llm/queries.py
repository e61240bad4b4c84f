"""The operators' queries over the driver tables, and SQL for those that SQL can express."""

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .jaccard import op8_jaccard
from .licenses import op2_licenses
from .mixing import op7_mixing
from .packing import op1_packing
from .quality import op4_quality
from .substrings import op10_substrings
from .syncmers import op9_syncmers
from .toxicity import op5_toxicity
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_jaccard": op8_jaccard,
    "op9_syncmers": op9_syncmers,
    "op10_substrings": op10_substrings,
}
SQL = {"op3_warc": OP3_SQL, "op6_exact_dedup": OP6_SQL}
