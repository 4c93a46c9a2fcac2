"""Words of ASCII letters, digits and all that is not ASCII, on UTF-8 bytes, A-Z as a-z."""

from __future__ import annotations

from palimp.session import ship_by_value

ship_by_value(__name__)

#: Word bytes stay, capitals become small, every other ASCII byte becomes a space; offsets are those of the text.
TABLE = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def normal(text: bytes | None) -> bytes:
    """The text with a space for every byte that is in no word; null is empty."""
    return text.translate(TABLE) if text else b""


#: The same words in DuckDB, for oracles.
SQL_WORDS = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
