"""Text functions as Column expressions; only what no built-in can express is an Arrow UDF.

All of them give null for null unless they say otherwise, and work on whole texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sentence with its white space, and a word.
SENTENCE = r"[ \t\n\r\f\x0B]*[^.!?…。！？]+[.!?…。！？]?[ \t\n\r\f\x0B]*"
WORD = r"[A-Za-z0-9]+(?:[’'\-][A-Za-z0-9]+)*"
#: Like SENTENCE, but keeps every terminator of a run of them.
LOSSLESS_SENTENCE = r"[^.!?…。！？]*[.!?…。！？]+[ \t\n\r\f\x0B]*|[^.!?…。！？]+"


# The usual spellings in ASCII of characters that have no decomposition into it.
SPELLED = {
    "ß": "ss", "ẞ": "Ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "ı": "i", "ŋ": "ng",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "−": "-", "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "«": "<<", "»": ">>", "‹": "<", "›": ">", "′": "'", "″": "''",
    "•": "*", "·": "*", "¡": "!", "¿": "?", "×": "x", "÷": "/", "°": "deg", "±": "+-", "€": "EUR", "£": "PS", "¥": "Y=", "¢": "C/", "©": "(c)", "®": "(r)", "§": "SS", "¶": "P", "¬": "!", "µ": "u", "、": ",", "。": ".",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u",
    "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
_SPELLED = SPELLED | {k.upper(): v[:1].upper() + v[1:] for k, v in SPELLED.items() if k.isalpha() and len(k.upper()) == 1 and k.upper() not in SPELLED}


def transliterated(text: str) -> str:
    """The text in ASCII: compatibility forms decomposed, marks dropped, listed characters spelled out, others dropped."""
    return "".join(x for c in unicodedata.normalize("NFKD", text) for x in _SPELLED.get(c, c) if x < "\x80")


@F.pandas_udf(T.StringType())
def _transliterated_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else transliterated(t))


@F.pandas_udf(T.StringType())
def _casefolded_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def _plain(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def ascii_folded(text: Column) -> Column:
    """:func:`transliterated` of a text; texts in ASCII never leave the JVM."""
    return F.when(_plain(text), text).otherwise(_transliterated_udf(F.when(~_plain(text), text)))


def nfkc_casefold(text: Column) -> Column:
    """NFKC form with full case folding; texts in ASCII never leave the JVM."""
    return F.when(_plain(text), F.lower(text)).otherwise(_casefolded_udf(F.when(~_plain(text), text)))


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks as one blank, line ends without blanks around, no blanks at the ends; an empty text for null."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\r\f\x0B]+", " ")
    return F.trim(F.regexp_replace(one, r"[ \n]*\n[ \n]*", "\n"), F.lit(" \n"))


def normalized(text: Column) -> Column:
    """:func:`collapse_spaces` of the ASCII form."""
    return collapse_spaces(ascii_folded(text))


def identifier(text: Column, most: int = 80, default: str = "x") -> Column:
    """Only letters, digits, ``_`` and ``-``, at most ``most`` characters; ``default`` if nothing is left."""
    kept = F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit(most))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def sentences(text: Column, lossless: bool = False) -> Column:
    """The sentences with their white space; the text itself if it has none."""
    found = F.regexp_extract_all(text, F.lit(LOSSLESS_SENTENCE if lossless else SENTENCE), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def words(text: Column) -> Column:
    """The words in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def lower_first(text: Column) -> Column:
    """The text with its first letter in lower case."""
    return _first_letter(text, F.lower)


def upper_first(text: Column) -> Column:
    """The text with its first letter in upper case."""
    return _first_letter(text, F.upper)


def _first_letter(text: Column, change) -> Column:
    at = F.regexp_instr(text, F.lit(r"\p{L}"))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), change(F.substring(text, at, F.lit(1))), F.substring(text, at + 1, F.length(text)))).otherwise(text)


def interior_spaces(text: Column) -> Column:
    """Positions, from 1, of blanks between the first and the last other character."""
    first = F.regexp_instr(text, F.lit(r"\S"))
    last = F.length(F.rtrim(text))
    every = F.when(last > first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substring(text, i, F.lit(1)) == " ")


def legal_word(word: Column, apostrophe: bool = True, hyphen: bool = True, least: int = 2) -> Column:
    """Whether a word has ``least`` characters and only letters and the allowed signs; false for null."""
    signs = ("'" if apostrophe else "") + ("-" if hyphen else "")
    return F.coalesce((F.length(word) >= least) & word.rlike(f"^[A-Za-z{signs}]+$"), F.lit(False))


def starts_word(piece: Column) -> Column:
    """Whether a subword piece begins a word."""
    return F.coalesce(piece.rlike(r"^▁[A-Za-z0-9][A-Za-z0-9'-]*$"), F.lit(False))


def continues_word(piece: Column) -> Column:
    """Whether a subword piece goes on with a word."""
    return F.coalesce(piece.rlike(r"^[A-Za-z'-]+$"), F.lit(False))


def joined_pieces(pieces: Column) -> Column:
    """The text of subword pieces; the mark of a word start is a blank."""
    return F.concat(F.replace(F.element_at(pieces, 1), F.lit("▁"), F.lit(" ")), F.array_join(F.slice(pieces, F.lit(2), F.size(pieces)), ""))


def readable(word: Column, least: int = 3, most: int = 12) -> Column:
    """Only letters, a length in bounds, no letter three times running, no chunk of three letters or more twice running."""
    low = F.lower(word)
    return F.coalesce(low.rlike("^[a-z]+$") & F.length(low).between(least, most) & ~low.rlike(r"(.)\1\1") & ~low.rlike(r"([a-z]{3,})\1"), F.lit(False))


def word_count(text: Column) -> Column:
    """The number of stretches without white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))), F.lit(0))


def parsed_words(raw: Column) -> Column:
    """The words of a list written as ``['a', 'b']``, of any other text itself, none for null and ``nan``."""
    inner = F.regexp_extract_all(raw, F.lit(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""), F.lit(0))
    listed = F.transform(inner, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(['\"\\])", "$1"))
    none = F.array().cast("array<string>")
    return F.when(raw.isNull() | (F.lower(F.trim(raw)).isin("nan", "")), none).when(F.trim(raw).rlike(r"^\[.*\]$"), listed).otherwise(F.array(raw))


def is_boolean_query(query: Column) -> Column:
    """Whether a query combines phrases with AND or OR."""
    q = F.trim(query)
    return F.coalesce(q.contains(" AND ") | q.contains(" OR "), F.lit(False))


def unsafe_verdict(answer: Column) -> Column:
    """Whether a classifier's answer says UNSAFE and nowhere else SAFE."""
    up = F.upper(F.coalesce(answer, F.lit("")))
    return up.contains("UNSAFE") & ~F.replace(up, F.lit("UNSAFE"), F.lit("")).contains("SAFE")


def truthy(value: Column) -> Column:
    """Whether a value reads as true; false for null."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def last_part(path: Column) -> Column:
    """The part after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def without_stress(phone: Column) -> Column:
    """A phone without its stress digit."""
    return F.regexp_replace(phone, r"\d$", "")
