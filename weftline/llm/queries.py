"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from .ann import op1_ann
from .bpe import op2_byte_bpe
from .langid import op6_language_id
from .licenses import op7_license_scan
from .mixing import OP9_SQL, op9_mixing
from .neardup import op3_minhash_near_dedup
from .quality import op10_quality
from .secrets import op4_secret_scan
from .sharding import op5_sharding
from .topk import OP8_SQL, op8_exact_top_k


def queries() -> dict:
    return {f.__name__: f for f in (op1_ann, op2_byte_bpe, op3_minhash_near_dedup, op4_secret_scan, op5_sharding, op6_language_id, op7_license_scan, op8_exact_top_k, op9_mixing, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": OP8_SQL, "op9_mixing": OP9_SQL}
