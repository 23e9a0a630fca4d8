"""SQL for oracles that need Unicode forms which the SQL engine lacks: maps of characters, made from rules."""

from __future__ import annotations

import unicodedata


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def map_sql(of: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in of.items()) + "}"


CHARS = [c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x20000)])]
#: Characters that compatibility composition changes, beyond canonical composition, and those that case folding changes.
NFKC = {c: x for c in CHARS if (x := unicodedata.normalize("NFKC", c)) not in (c, unicodedata.normalize("NFC", c))}
FOLDED = {c: x for c in CHARS if (x := c.casefold()) != c}


def mapped(text: str, by: str, low: bool) -> str:
    """A text character by character; ``by`` names a map for those outside ASCII, which stay as they are or, if ``low``, in lower case."""
    each = f"CASE WHEN unicode(c) < 128 THEN {'lower(c)' if low else 'c'} ELSE coalesce({by}[c], c) END"
    return f"CASE WHEN strlen({text}) = length({text}) THEN {f'lower({text})' if low else text} ELSE array_to_string(list_transform(string_split({text}, ''), lambda c: {each}), '') END"


def nfkc(text: str, by: str = "nfkc") -> str:
    """NFKC of a text; ``by`` names the map NFKC."""
    return f"nfc_normalize({mapped(f'nfc_normalize({text})', by, False)})"
