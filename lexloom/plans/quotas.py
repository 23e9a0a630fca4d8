"""Source projections, the quality gate, quotas and the top-k corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import projections, quota
from lexloom.plans.base import Plans
from lexloom.tables import table

plans = Plans()
TARGET, SMALL_TARGET, RESERVE = 100_000, 500, 1.2


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_IN_ASCII = {c: text.transliterated(c) for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x20000)])}
_TRANSLIT = "MAP {" + ", ".join(f"{_quoted(c)}: {_quoted(x)}" for c, x in _IN_ASCII.items() if x) + "}"


def ascii_sql(table: str, column: str, out: str = "ascii") -> str:
    """``table`` with the transliterated ``column`` as ``out``, for an SQL oracle."""
    each = f"CASE WHEN unicode(c) < 128 THEN c ELSE coalesce(_t[c], '') END"
    whole = f"array_to_string(list_transform(string_split({column}, ''), lambda c: {each}), '')"
    return f"(SELECT * EXCLUDE (_t), CASE WHEN strlen({column}) = length({column}) THEN {column} ELSE {whole} END AS {out} FROM (SELECT *, {_TRANSLIT} AS _t FROM {table}))"


_ONCE = "(SELECT DISTINCT record_id, text, hint, lower(trim(source)) AS source, lang, thread_id, created_at FROM toxic_document WHERE record_id IS NOT NULL)"
RECORDS = ascii_sql(_ONCE, "text")
COLLAPSED = r"trim(regexp_replace(regexp_replace(coalesce(ascii, ''), '[ \t\r\f\x0B]+', ' ', 'g'), '[ \n]*\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
_LANG = "lower(regexp_split_to_array(trim(lang), '[-_]')[1])"
GATED = f"""(SELECT source, record_id AS ord, {COLLAPSED} AS text, hint FROM {RECORDS}
    WHERE hint IS NOT NULL AND NOT isnan(hint) AND hint >= 0.5 AND source IS NOT NULL
    AND coalesce(length({_LANG}) <> 2 OR {_LANG} = 'en', true) AND length({COLLAPSED}) >= 5)"""
_COUNTS = f"(SELECT source, count(*) AS n FROM {GATED} GROUP BY source)"


def _apportion(rows: str, total: str, weight: str, out: str) -> str:
    return f"""(SELECT source, {weight}, CASE WHEN whole > 0 THEN floor(raw)::BIGINT + (row_number() OVER (ORDER BY raw - floor(raw) DESC, source DESC) <= t - sum(floor(raw)) OVER ())::BIGINT ELSE 0 END AS {out}
        FROM (SELECT source, {weight}, sum({weight}) OVER () AS whole, {total} AS t, CASE WHEN sum({weight}) OVER () > 0 THEN {weight}::DOUBLE / (sum({weight}) OVER ()) * {total} ELSE 0 END AS raw FROM {rows}))"""


_RANKED = f"""(SELECT source, ord, text, hint, row_number() OVER (PARTITION BY source ORDER BY hint DESC, ord) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY ord) AS rn FROM {GATED}) WHERE rn = 1)"""


def _caps(target: int) -> str:
    return _apportion(_COUNTS, str(target), "n", "cap")


def _corpus(target: int) -> str:
    held = f"(SELECT r.*, c.cap FROM {_RANKED} r JOIN {_caps(target)} c USING (source) WHERE r.rank <= greatest(c.cap, ceil(c.cap * {RESERVE})))"
    extra = f"""(SELECT source, taken, extra, greatest(least({target} - sum(taken) OVER (), sum(extra) OVER ()), 0) AS short FROM
        (SELECT source, count(*) FILTER (rank <= cap) AS taken, count(*) FILTER (rank > cap) AS extra FROM {held} GROUP BY source))"""
    refill = _apportion(extra, "short", "extra", "more")
    return f"""SELECT h.source, h.ord, h.text, h.hint AS tox_score, h.rank, CASE WHEN h.rank <= h.cap THEN 'quota' ELSE 'refill' END AS part
        FROM {held} h JOIN {refill} m USING (source) WHERE h.rank <= h.cap + m.more"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return quota.deliveries_once(table(spark, folder, "toxic_document"))


def gated(spark: SparkSession, folder: str) -> DataFrame:
    """The records that pass the gate of the production settings."""
    return quota.quality_gate(table(spark, folder, "toxic_document"))


@plans.query(f"SELECT source, ord, text, hint FROM {GATED}")
def flt_quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder)


@plans.query(f"SELECT source, ord, text, hint FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM {GATED}) WHERE rn <= 200")
def flt_gate_with_limit(spark: SparkSession, folder: str) -> DataFrame:
    return quota.quality_gate(table(spark, folder, "toxic_document"), quota.Gate(limit=200))


@plans.query(f"SELECT source, n FROM {_COUNTS}")
def agg_source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quota.counts(gated(spark, folder))


@plans.query(f"SELECT source, n, cap FROM {_caps(TARGET)}")
def quota_apportion(spark: SparkSession, folder: str) -> DataFrame:
    return quota.apportion(quota.counts(gated(spark, folder)), TARGET)


@plans.query(f"SELECT source, ord, hint, rank FROM {_RANKED} WHERE rank <= {int(TARGET * RESERVE)}")
def win_source_topk(spark: SparkSession, folder: str) -> DataFrame:
    return quota.ranked_by_source(gated(spark, folder), int(TARGET * RESERVE)).select("source", "ord", "hint", "rank")


@plans.query(_corpus(TARGET))
def quota_topk_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return quota.topk_corpus(gated(spark, folder), TARGET, RESERVE)


@plans.query(_corpus(SMALL_TARGET))
def quota_topk_small(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus that is much smaller than what passes the gate, so quotas and refills decide."""
    return quota.topk_corpus(gated(spark, folder), SMALL_TARGET, RESERVE)


_H = "CASE WHEN isnan(hint) THEN NULL ELSE hint END"
_PROJECTED = f"""
    SELECT record_id, coalesce(nullif(text, ''), thread_id) AS text, {_H} AS hint, source FROM {RECORDS} WHERE source = 'civil_comments' AND {_H} IS NOT NULL
    UNION ALL SELECT record_id, coalesce(nullif(text, ''), thread_id), coalesce(nullif({_H}, 0.0), 1 - {_H}), source FROM {RECORDS} WHERE source = 'real_toxicity_prompts' AND {_H} IS NOT NULL
    UNION ALL SELECT record_id, text, CASE WHEN {_H} >= 0.9 THEN 1.0 ELSE 0.8 END, source FROM {RECORDS} WHERE source = 'hatexplain' AND {_H} >= 0.4
    UNION ALL SELECT record_id, coalesce(nullif(text, ''), thread_id), greatest({_H}, {_H} / 2, 0.25), source FROM {RECORDS} WHERE source = 'jigsaw_toxicity_pred'
    UNION ALL SELECT record_id, text, 1.0, source FROM {RECORDS} WHERE source = 'toxic_conversations' AND {_H} >= 0.5"""


@plans.query(f"SELECT record_id, text, hint::DOUBLE AS hint, source FROM ({_PROJECTED})")
def src_projections(spark: SparkSession, folder: str) -> DataFrame:
    """The five source shapes, each made from the records of its source, through their projections."""
    rows = _records(spark, folder)
    of = lambda s: rows.filter(F.col("source") == s)
    hint = F.when(~F.isnan("hint"), F.col("hint"))
    keep = ("record_id",)
    civil = of("civil_comments").select("record_id", "text", F.col("thread_id").alias("comment_text"), F.col("hint").cast("string").alias("toxicity"))
    prompt = of("real_toxicity_prompts").select("record_id", F.col("text").alias("continuation_text"), F.col("thread_id").alias("prompt_text"), F.col("hint").alias("c_toxicity"), (1 - hint).alias("p_toxicity"))
    label = F.when(hint >= 0.9, " HateSpeech").when(hint >= 0.4, "offensive").otherwise("normal")
    labelled = of("hatexplain").select("record_id", "text", label.alias("label"))
    multi = of("jigsaw_toxicity_pred").select("record_id", F.col("thread_id").alias("text"), F.col("text").alias("comment_text"), F.col("hint").alias("toxic"), (hint / 2).alias("insult"), F.lit("0.25").alias("threat"))
    binary = of("toxic_conversations").select("record_id", "text", F.when(hint >= 0.5, 1).otherwise(0).alias("label"))
    out = projections.comment_style(civil, "civil_comments", keep)
    out = out.unionByName(projections.prompt_style(prompt, "real_toxicity_prompts", ["c_toxicity"], ["p_toxicity"], keep))
    out = out.unionByName(projections.label_style(labelled, "hatexplain", keep))
    out = out.unionByName(projections.multi_label_style(multi, "jigsaw_toxicity_pred", ["toxic", "insult", "threat"], keep))
    return out.unionByName(projections.binary_style(binary, "toxic_conversations", keep))
