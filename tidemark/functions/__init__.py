from tidemark.functions.hashing import (
    FINGERPRINT_FIELDS,
    fingerprint_columns,
    fingerprint_text,
    hash_draw,
    pick,
    row_hash,
)
from tidemark.functions.numbers import (
    clamp_zero,
    duration_ms,
    floor_average,
    number_word,
    thousands,
    zero_event_bound,
)
from tidemark.functions.text import (
    basename,
    first_line,
    is_blank,
    is_offset,
    plain_blanks,
    split_lines,
    squash_whitespace,
    strip_ansi,
)

__all__ = [
    "FINGERPRINT_FIELDS", "basename", "clamp_zero", "duration_ms", "fingerprint_columns",
    "fingerprint_text", "first_line", "floor_average", "hash_draw", "is_blank",
    "is_offset", "number_word", "pick", "plain_blanks", "row_hash", "split_lines", "squash_whitespace", "strip_ansi", "thousands", "zero_event_bound",
]
