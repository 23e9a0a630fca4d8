"""Candidates, screening, matching, insertion and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import sampling, text
from lexloom.functions.spans import spans_text
from lexloom.operators import annotate, screen
from lexloom.plans import quotas, unicode_sql
from lexloom.plans.base import Plans
from lexloom.streaming import jobs
from lexloom.tables import table

plans = Plans()
#: Terms that are matched besides the seeds which found a text.
TERMS = ["committee", "librarian", "night bus driver", "scumbag", "such name"]
#: The classifier of the screening here: a text is unsafe if it holds one of these words.
UNSAFE_WORDS = r"\b(bitch|asshole|scumbag|vermin|bullet|cunt|moron|bastard|slut|nudes|parasites?)\b"
_ANSWER = screen.pattern_answer(UNSAFE_WORDS)
_SYSTEM = "Say SAFE or UNSAFE."

_JSON = """(SELECT *, CASE WHEN json_valid(spans_json) THEN spans_json WHEN json_valid(mended) THEN mended END AS js FROM
    (SELECT *, replace(replace(spans_json, '''''', '"'), '""', '"') AS mended FROM unsafe_candidates))"""
_ITEM = {
    True: "CASE json_type(x) WHEN 'ARRAY' THEN x->>0 WHEN 'OBJECT' THEN coalesce(x->>'text', x->>'span', x->>'$.\"0\"', json_extract_string(x, '$.\"' || json_keys(x)[1] || '\"')) WHEN 'NULL' THEN NULL ELSE x->>'$' END",
    False: "CASE json_type(x) WHEN 'ARRAY' THEN x->>0 WHEN 'OBJECT' THEN x->>'$.\"0\"' END",
}


def _spans(any_key: bool) -> str:
    return f"CASE WHEN json_type(js) = 'ARRAY' THEN coalesce(array_to_string(list_transform(json_extract(js, '$[*]'), lambda x: {_ITEM[any_key]}), ''), '') END"


_TEXTS = f"(SELECT *, {_spans(True)} AS text FROM {_JSON})"
_STANDARD = f"""(SELECT trim(seed) AS word, text, true AS is_all_doc, true AS is_unsafe FROM {_TEXTS} WHERE doc_len IS NOT NULL AND doc_len = disp_len
    AND trim(seed) <> '' AND lower(trim(seed)) <> 'nan' AND trim(text) <> '' AND lower(trim(text)) <> 'nan')"""
_BY_TEXT = f"(SELECT text, list_sort(list_distinct(list(word))) AS words, arg_min(is_all_doc, word) AS is_all_doc, arg_min(is_unsafe, word) AS is_unsafe FROM {_STANDARD} GROUP BY text)"

_WORD, _SENTENCE = text.WORD.replace("'", "''"), text.SENTENCE
_words = lambda x: f"list_transform(regexp_extract_all({x}, '{_WORD}'), lambda w: lower(w))"
_sentences = lambda x: f"CASE WHEN len(regexp_extract_all({x}, '{_SENTENCE}')) > 0 THEN regexp_extract_all({x}, '{_SENTENCE}') ELSE [{x}] END"
_TERMS = f"list_transform(list_filter(flatten(list_transform(words, lambda q: regexp_split_to_array(q, '\\s+(?:AND|OR)\\s+|[()]'))), lambda p: trim(p) <> ''), lambda p: {_words('p')})"


def _holds(tokens: str, terms: str) -> str:
    joined = f"(' ' || array_to_string({tokens}, ' ') || ' ')"
    return f"len(list_filter({terms}, lambda t: len(t) > 0 AND (contains({joined}, ' ' || array_to_string(t, ' ') || ' ') OR contains({joined}, ' ' || array_to_string(t, ' ') || 's ') OR contains({joined}, ' ' || array_to_string(t, ' ') || '''s ') OR contains({joined}, ' ' || array_to_string(t, ' ') || '’s ')))) > 0"


_FORMS = f"(SELECT text, words, is_all_doc, is_unsafe, {_TERMS} AS terms, {_sentences('text')} AS sents FROM (SELECT text, words || {TERMS} AS words, is_all_doc, is_unsafe FROM {_BY_TEXT}))"
_MATCHED = f"(SELECT * FROM {_FORMS} WHERE len(list_filter(sents, lambda s: {_holds(_words('s'), 'terms')})) > 0)"


def _first(x: str, change: str) -> str:
    return f"(regexp_extract({x}, '^[^\\p{{L}}]*') || {change}(regexp_extract({x}, '\\p{{L}}')) || substr({x}, length(regexp_extract({x}, '^[^\\p{{L}}]*')) + length(regexp_extract({x}, '\\p{{L}}')) + 1))"


def _drawn(rows: str, key: str, t: annotate.TokenTable) -> str:
    u = sampling.u01_sql(annotate.SEED, key, "token")
    pick = sampling.pick_sql(annotate.POSITIONS, sampling.u01_sql(annotate.SEED, key, "position"))
    tokens = " ".join(f"WHEN '{p}' THEN {sampling.weighted_sql(getattr(t, p), t.weights, u)}" for p in annotate.POSITIONS)
    return f"(SELECT *, CASE position {tokens} END AS token FROM (SELECT *, {pick} AS position FROM {rows}))"


def _augmented_documents(rows: str, key: str, t: annotate.TokenTable, quoted: bool, change_case: bool) -> str:
    inner = "'\"' || token || '\"'" if quoted else "token"
    cut = f"(floor({sampling.u01_sql(annotate.SEED, key, 'cut')} * greatest(length(text) - 1, 1)) + 1)::INT"
    head = f"{_first('token', 'upper')} || ', ' || {_first('text', 'lower')}" if change_case else "token || ', ' || text"
    mid = f"CASE WHEN text = '' THEN {inner} ELSE substr(text, 1, {cut}) || ' ' || {inner} || ' ' || substr(text, {cut} + 1) END"
    return f"""(SELECT *, CASE WHEN position = 'head' THEN {head} ELSE '' END AS aug_head, CASE WHEN position = 'mid' THEN {mid} ELSE '' END AS aug_mid,
        CASE WHEN position = 'tail' THEN text || ', ' || token ELSE '' END AS aug_tail FROM {_drawn(rows, key, t)})"""


def _augmented_sentences(t: annotate.TokenTable) -> str:
    spaces = "list_filter(range(length(s) - length(ltrim(s, ' ' || chr(9) || chr(10) || chr(13))) + 1, length(rtrim(s, ' ')) + 1), lambda i: s[i] = ' ')"
    u = f"('0x' || substr(md5('{annotate.SEED}|' || md5(text) || '/' || (n - 1)::VARCHAR || '|place'), 1, 8))::BIGINT / 4294967296.0"
    sents = f"(SELECT text, words, is_all_doc, is_unsafe, terms, position, token, unnest(sents) AS s, unnest(range(1, len(sents) + 1)) AS n FROM {_drawn(_MATCHED, 'md5(text)', t)})"
    cut = f"(SELECT *, {_holds(_words('s'), 'terms')} AS hit, {spaces} AS sp, {u} AS u FROM {sents})"
    place = "sp[(floor(u * len(sp)) + 1)::INT]"
    one = f"""CASE WHEN NOT hit THEN s WHEN position = 'head' THEN {_first('token', 'upper')} || ', ' || {_first('s', 'lower')}
        WHEN position = 'mid' AND len(sp) > 0 THEN substr(s, 1, {place} - 1) || ', ' || token || ', ' || substr(s, {place} + 1) ELSE s || ', ' || token END"""
    whole = f"(SELECT text, words, is_all_doc, is_unsafe, position, token, string_agg({one}, '' ORDER BY n) AS augmented FROM {cut} GROUP BY ALL)"
    cols = ", ".join(f"CASE WHEN position = '{p}' THEN augmented ELSE '' END AS aug_{p}" for p in annotate.POSITIONS)
    return f"SELECT array_to_string(words, '|') AS words, text, is_all_doc, is_unsafe, true AS matched, token, position, {cols} FROM {whole}"


def _with_terms(rows: DataFrame) -> DataFrame:
    return annotate.by_text(rows).withColumn("words", F.array_union("words", F.array(*[F.lit(t) for t in TERMS])))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "unsafe_candidates")


@plans.query(f"SELECT candidate_id, {_spans(False)} AS text FROM {_JSON}")
def spans_first_form(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("candidate_id", spans_text(F.col("spans_json"), any_key=False).alias("text"))


@plans.query(f"SELECT candidate_id, {_spans(True)} AS text FROM {_JSON}")
def spans_any_form(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("candidate_id", spans_text(F.col("spans_json")).alias("text"))


@plans.query(f"SELECT word, text, is_all_doc, is_unsafe FROM {_STANDARD}")
def std_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.standardised(_candidates(spark, folder))


@plans.query(f"SELECT text, array_to_string(words, '|') AS words, is_all_doc, is_unsafe FROM {_BY_TEXT}")
def agg_words_by_text(spark: SparkSession, folder: str) -> DataFrame:
    return annotate.by_text(annotate.standardised(_candidates(spark, folder))).select("text", F.array_join("words", "|").alias("words"), "is_all_doc", "is_unsafe")


_MODEL_TOKENS = f"regexp_extract_all(text, '{screen._TOKEN}')"
_CUT = f"CASE WHEN len({_MODEL_TOKENS}) > {screen.MOST_TOKENS} THEN array_to_string({_MODEL_TOKENS}[1:{screen.MOST_TOKENS}], '') ELSE text END"
_SCREENED = f"""SELECT candidate_id, word, text, is_all_doc, CASE WHEN is_all_doc AND trim(text) <> '' THEN regexp_matches(lower(text), '{UNSAFE_WORDS}') END AS is_unsafe FROM
    (SELECT candidate_id, seed AS word, coalesce(left({_CUT}, {screen.MOST_CHARS}), '') AS text, coalesce(doc_len, 0) = coalesce(disp_len, 0) AND coalesce(disp_len, 0) <= {screen.MOST_SHOWN} AS is_all_doc FROM {_TEXTS})"""


@plans.query(_SCREENED)
def screen_tristate(spark: SparkSession, folder: str) -> DataFrame:
    return screen.screened(_candidates(spark, folder), _ANSWER)


@plans.query(_SCREENED)
def stream_screening(spark: SparkSession, folder: str) -> DataFrame:
    """The screening as a stream over the files of the table, in batches with durable progress."""
    return jobs.screened_by_stream(spark, f"{folder}/unsafe_candidates.parquet", _ANSWER)


@plans.query(f"SELECT text, array_to_string(words, '|') AS words, len(sents) AS sentences FROM {_MATCHED}")
def match_inflected(spark: SparkSession, folder: str) -> DataFrame:
    rows = annotate.matched(_with_terms(annotate.standardised(_candidates(spark, folder))))
    return rows.select("text", F.array_join("words", "|").alias("words"), F.size("sents").alias("sentences"))


@plans.query(f"SELECT docs, matched, docs - matched AS unmatched FROM (SELECT count(*) AS docs FROM {_BY_TEXT}), (SELECT count(*) AS matched FROM {_MATCHED})")
def match_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts hold a term and how many stay as they are."""
    return annotate.match_counts(_with_terms(annotate.standardised(_candidates(spark, folder))))


@plans.query(f"SELECT candidate_id, '{_SYSTEM}' || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS prompt, '[' || '{_SYSTEM}' || '] ' || text AS templated FROM ({_SCREENED})")
def screen_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts of a classifier, by a template and without one."""
    rows = screen.screened(_candidates(spark, folder), _ANSWER)
    return rows.select("candidate_id", screen.rendered_prompt(F.col("text"), _SYSTEM).alias("prompt"), screen.rendered_prompt(F.col("text"), _SYSTEM, "[{system}] {text}").alias("templated"))


def _sentence_query(spark: SparkSession, folder: str, t: annotate.TokenTable) -> DataFrame:
    rows = annotate.augment_sentences(_with_terms(annotate.standardised(_candidates(spark, folder))), t)
    return rows.withColumn("words", F.array_join("words", "|"))


@plans.query(_augmented_sentences(annotate.SENTENCE_ALL))
def aug_sentence_all(spark: SparkSession, folder: str) -> DataFrame:
    return _sentence_query(spark, folder, annotate.SENTENCE_ALL)


@plans.query(_augmented_sentences(annotate.SENTENCE_UNSAFE).replace(_STANDARD, f"(SELECT trim(word) AS word, text, is_all_doc, is_unsafe FROM ({_SCREENED}) WHERE is_unsafe AND trim(word) <> '')"))
def aug_sentence_unsafe(spark: SparkSession, folder: str) -> DataFrame:
    """Insertion into the texts that the screening found unsafe."""
    unsafe = screen.screened(_candidates(spark, folder), _ANSWER).filter(text.truthy(F.col("is_unsafe")))
    rows = unsafe.select(F.trim("word").alias("word"), "text", "is_all_doc", "is_unsafe").filter(F.col("word") != "")
    return annotate.augment_sentences(_with_terms(rows), annotate.SENTENCE_UNSAFE).withColumn("words", F.array_join("words", "|"))


_AUG = ", ".join(f"aug_{p}" for p in annotate.POSITIONS)
_DOC_WORDS = _augmented_documents(quotas.GATED, "ord", annotate.DOCUMENT_WORDS, True, True)
_DOC_SYMBOLS = _augmented_documents(quotas.GATED, "ord", annotate.DOCUMENT_SYMBOLS, False, False)


@plans.query(f"SELECT ord, token, position, {_AUG} FROM {_DOC_WORDS}")
def aug_doc_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = annotate.augment_documents(quotas.gated(spark, folder), annotate.DOCUMENT_WORDS, "ord", quoted=True, change_case=True)
    return rows.select("ord", "token", "position", "aug_head", "aug_mid", "aug_tail")


@plans.query(f"SELECT ord, token, position, {_AUG} FROM {_DOC_SYMBOLS}")
def aug_doc_symbols(spark: SparkSession, folder: str) -> DataFrame:
    rows = annotate.augment_documents(quotas.gated(spark, folder), annotate.DOCUMENT_SYMBOLS, "ord", quoted=False, change_case=False)
    return rows.select("ord", "token", "position", "aug_head", "aug_mid", "aug_tail")


@plans.query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, position AS aug_type, count(*) AS n FROM {rows} WHERE trim(aug_head || aug_mid || aug_tail) <> '' GROUP BY position" for kind, rows in (("pw", _DOC_WORDS), ("sym", _DOC_SYMBOLS))))
def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Training records by kind and position, over both kinds of insertion."""
    rows = quotas.gated(spark, folder)
    both = [annotate.routed(annotate.augment_documents(rows, t, "ord", q, c)).withColumn("kind", F.lit(kind)) for kind, t, q, c in (("pw", annotate.DOCUMENT_WORDS, True, True), ("sym", annotate.DOCUMENT_SYMBOLS, False, False))]
    return both[0].unionByName(both[1]).groupBy("kind", "aug_type").agg(F.count("*").alias("n"))


@plans.query(f"SELECT doc_id, len({_sentences('text')}) AS sentences, len({_words('text')}) AS tokens, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS words FROM documents WHERE text IS NOT NULL")
def sent_split_count(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").filter(t.isNotNull()).select("doc_id", F.size(text.sentences(t)).alias("sentences"), F.size(text.words(t)).alias("tokens"), text.word_count(t).alias("words"))


@plans.query(
    f"SELECT record_id, {quotas.COLLAPSED} AS collapsed, left(nullif(trim(regexp_replace(coalesce(thread_id, ''), '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 80) AS tag FROM {quotas.RECORDS}"
)
def text_normalized(spark: SparkSession, folder: str) -> DataFrame:
    from lexloom.operators.quota import deliveries_once

    rows = deliveries_once(table(spark, folder, "toxic_document"))
    return rows.select("record_id", text.normalized(F.col("text")).alias("collapsed"), F.nullif(text.identifier(F.col("thread_id"), default="\x00"), F.lit("\x00")).alias("tag"))


@plans.query(f"SELECT doc_id, {quotas.COLLAPSED} AS ascii FROM {quotas.ascii_sql('documents', 'text')}")
def text_ascii(spark: SparkSession, folder: str) -> DataFrame:
    """Transliteration of all texts."""
    return table(spark, folder, "documents").select("doc_id", text.normalized(F.col("text")).alias("ascii"))


@plans.query(f"SELECT doc_id, {unicode_sql.mapped('n', 'folded', True)} AS folded FROM (SELECT doc_id, folded, {unicode_sql.nfkc('text')} AS n FROM (SELECT doc_id, text, {unicode_sql.map_sql(unicode_sql.NFKC)} AS nfkc, {unicode_sql.map_sql(unicode_sql.FOLDED)} AS folded FROM documents))")
def text_casefold(spark: SparkSession, folder: str) -> DataFrame:
    """NFKC with full case folding of all texts."""
    return table(spark, folder, "documents").select("doc_id", text.nfkc_casefold(F.col("text")).alias("folded"))


@plans.query(
    """SELECT candidate_id, seed LIKE '% AND %' OR seed LIKE '% OR %' AS boolean_query, list_contains(['true', '1', 'yes'], lower(trim(mode))) AS truthy,
       array_to_string(CASE WHEN trim(seed) IN ('', 'nan') THEN [] ELSE ['x' || seed] END, ', ') AS words, regexp_extract(doc_ix, '[^/]*$') AS last FROM unsafe_candidates WHERE seed IS NOT NULL AND mode IS NOT NULL"""
)
def text_small_functions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder).filter(F.col("seed").isNotNull() & F.col("mode").isNotNull())
    listed = F.when(F.trim("seed").isin("", "nan"), F.col("seed")).otherwise(F.concat(F.lit("['x"), F.col("seed"), F.lit("']")))
    return rows.select("candidate_id", text.is_boolean_query(F.col("seed")).alias("boolean_query"), text.truthy(F.col("mode")).alias("truthy"), F.array_join(text.parsed_words(listed), ", ").alias("words"), text.last_part(F.col("doc_ix")).alias("last"))
