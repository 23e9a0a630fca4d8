"""Records that are the same but for formatting: canonical keys, one representative per key, and copy counts.

The canonical form is the text in NFKC, then full case folding, then only its letters and digits. A text made of
fields (a JSON object of scalars, or two or more non-blank lines ``name: value``) is the set of its reduced fields.
Plain ASCII texts are reduced inside the JVM; only the others pass through an Arrow UDF. Keys are 128 bits of SHA-256.

Hot keys are found exactly from partial counts and can be at most ``1/HOT_SHARE`` many, so their table may be
broadcast: their members never meet in one task, and their counts come from a salted two-level aggregation. All
other keys take one shuffle. The representative is the member with the smallest identifier.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.storage import staged

#: Texts with fewer letters and digits have no key and stand for themselves.
MIN_CHARS = 20
#: A key is hot from this many members on, and from total / HOT_SHARE on; so at most HOT_SHARE keys of 16 bytes are
#: broadcast, and a key that isn't hot has fewer than 1e6 members even among 1e11 records.
HOT_ROWS = 10_000
HOT_SHARE = 100_000
SALTS = 64

_KEEP_OUT = re.compile(r"[\W_]+")
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
_LINE_ENDS = re.compile(r"\r\n|\r|\n")
#: What may be a JSON object, behind all that Python strips off an ASCII text.
_OBJECT = r"^[\t-\r\x1c-\x1f ]*\{"
_FIELD = re.compile(r"\s*([\w\-]+)\s*:(?!//)(.*)", re.S)


def reduced(text: str) -> str:
    """Letters and digits of the case-folded NFKC form."""
    return _KEEP_OUT.sub("", unicodedata.normalize("NFKC", text).casefold())


def _json_fields(text: str) -> list[tuple[str, str]] | None:
    bare = text.strip().strip("﻿​⁠").strip()
    if not (bare.startswith("{") and bare.endswith("}")):
        return None
    try:
        pairs = json.loads(bare, object_pairs_hook=lambda x: x, strict=False)
    except (ValueError, RecursionError):
        return None
    if not pairs or any(isinstance(v, (list, dict)) for _, v in pairs):
        return None
    return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in pairs]


def fields(text: str) -> list[tuple[str, str]] | None:
    """The fields of a text made of fields, in order; else None."""
    found = _json_fields(text)
    if found is None and "{" not in text and "｛" in text:
        found = _json_fields(unicodedata.normalize("NFKC", text))
    if found is not None:
        return found
    if "\n" not in text and "\r" not in text:
        return None
    lines = [x for x in _LINE_ENDS.split(_INVISIBLE.sub("", unicodedata.normalize("NFKC", text))) if x.strip()]
    if len(lines) < 2:
        return None
    found = []
    for line in lines:
        hit = _FIELD.fullmatch(line)
        if not hit:
            return None
        found.append((hit[1], hit[2]))
    return found


def canonical(text: str) -> str:
    """The canonical form; that of a text of fields starts with a mark that reduced text can't hold."""
    found = fields(text)
    if found is None:
        return reduced(text)
    return "\x03" + "\x02".join(sorted({f"{reduced(k)}\x01{reduced(v)}" for k, v in found}))


@F.pandas_udf(T.StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical(x) if x is not None else None for x in texts], dtype=object)


def canonical_keys(df: DataFrame, record: str, text: str) -> DataFrame:
    """(record_id, key, n_chars) per row: ``key`` is null for null texts and those under MIN_CHARS letters and digits."""
    rows = df.select(F.col(record).alias("record_id"), F.col(text).cast("string").alias("text"))
    t = F.col("text")
    plain = (F.octet_length(t) == F.length(t)) & ~t.rlike(_OBJECT) & ~(t.contains(":") & t.rlike("[\r\n]"))
    rows = rows.select("record_id", F.when(plain, F.lower(F.regexp_replace(t, "[^A-Za-z0-9]+", ""))).alias("easy"), _canonical_udf(F.when(~plain, t)).alias("hard"))
    form = F.coalesce("easy", "hard")
    n = F.coalesce(F.length(F.translate(form, "\x01\x02\x03", "")), F.lit(0))
    return rows.select("record_id", F.when(n >= MIN_CHARS, F.unhex(F.substring(F.sha2(form, 256), 1, 32))).alias("key"), n.alias("n_chars"))


def keyed_records(df: DataFrame, record: str = "record_id", text: str = "text") -> DataFrame:
    """One row (record_id, key) per distinct identifier, as a staged table; rows without an identifier are left out.

    An identifier that comes again counts once; should its texts differ, the one with the greatest key stands.
    """
    rows = canonical_keys(df, record, text).filter(F.col("record_id").isNotNull())
    rows = rows.repartition("record_id")  # few come twice, so nothing is gained by a sort before the shuffle
    return staged(rows.groupBy("record_id").agg(F.max("key").alias("key")), "canonical")


def hot_keys(keyed: DataFrame, hot_rows: int = HOT_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """(key) of at least ``max(hot_rows, total / hot_share)`` members, by exact counts; at most ``hot_share`` rows."""
    total = keyed.count()
    least = max(hot_rows, -(-total // hot_share), 1)
    return keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("key")


def _hot_groups(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    salted = keyed.join(F.broadcast(hot), "key").groupBy("key", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).alias("salt"))
    first = salted.agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies"))
    return first.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))


def collapse(keyed: DataFrame, **hot_bounds: int) -> DataFrame:
    """(record_id, copies): one row per key with its smallest identifier and its number of distinct records.

    Records without a key (null, empty or very short texts) come out as they are, with 1 copy.
    """
    hot = staged(hot_keys(keyed, **hot_bounds), "hot-keys")
    rest = keyed.filter(F.col("key").isNotNull()).join(F.broadcast(hot), "key", "left_anti").groupBy("key").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies"))
    groups = rest.unionByName(_hot_groups(keyed, hot)).select(F.col("first_id").alias("record_id"), "copies")
    return groups.unionByName(keyed.filter(F.col("key").isNull()).select("record_id", F.lit(1).cast("bigint").alias("copies")))


def copy_links(keyed: DataFrame, **hot_bounds: int) -> DataFrame:
    """(record_id_a, record_id_b): the smallest identifier of each key with each other record of that key."""
    hot = staged(hot_keys(keyed, **hot_bounds), "hot-keys")
    of_hot = keyed.join(F.broadcast(_hot_groups(keyed, hot)), "key").select("record_id", "first_id")
    rest = keyed.filter(F.col("key").isNotNull()).join(F.broadcast(hot), "key", "left_anti")
    of_rest = rest.select("record_id", F.min("record_id").over(Window.partitionBy("key")).alias("first_id"))
    return of_rest.unionByName(of_hot).filter(F.col("record_id") != F.col("first_id")).select(F.col("first_id").alias("record_id_a"), F.col("record_id").alias("record_id_b"))
