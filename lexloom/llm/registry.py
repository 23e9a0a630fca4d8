"""Queries of the operators of this subpackage, and SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import abuse, canonical, cutoff, knn, langid, mixing, spans, tokenizer
from lexloom.operators import similarity
from lexloom.plans.unicode_sql import FOLDED, NFKC, map_sql, mapped, nfkc
from lexloom.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return knn.neighbour_pairs(knn.nearest_neighbours(table(spark, folder, "word_matrix")))


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return knn.with_words(knn.nearest_neighbours(table(spark, folder, "word_matrix")), table(spark, folder, "word_list"))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(queries, pairs, recall_reached): whether of the true neighbours of every row whose number is divisible by 50, found by comparing with all rows, at least 0.95 are found."""
    rows = table(spark, folder, "word_matrix")
    vectors = similarity.valid_vectors(rows, 128).select(F.col("id"), "vec")
    true = similarity.compared(vectors, vectors.filter(F.col("id") % 50 == 0), 10).select(F.col("query").alias("id"), F.col("id").alias("other"))
    got = knn.nearest_neighbours(rows).select("id", "other", F.lit(1).alias("hit"))
    met = true.join(got, ["id", "other"], "left")
    return met.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("pairs"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))) >= 0.95, F.lit(True)).alias("recall_reached"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.copy_links(canonical.keyed_records(table(spark, folder, "toxic_document")))


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.collapse(canonical.keyed_records(table(spark, folder, "toxic_document")))


def _p3_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, folder, "toxic_document"), table(spark, folder, "review_labels"), table(spark, folder, "unsafe_candidates")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found(*_p3_tables(spark, folder))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(*_p3_tables(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return langid.wrong_labels(table(spark, folder, "toxic_document"), table(spark, folder, "lang_samples"))


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    return langid.segments(table(spark, folder, "toxic_document"), table(spark, folder, "lang_samples")).select("record_id", "seg_no", "segs", "lang", F.round("confidence", 4).alias("confidence"), "words")


def p4_documents(spark: SparkSession, folder: str) -> DataFrame:
    return langid.document_languages(table(spark, folder, "toxic_document"), table(spark, folder, "lang_samples"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.keep_fraction(table(spark, folder, "toxic_document"), table(spark, folder, "keep_targets"))[0]


def p5_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.keep_fraction(table(spark, folder, "toxic_document"), table(spark, folder, "keep_targets"))[1]


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, folder, "documents"))


#: Domains of the sources of the documents.
DOMAINS = {
    "web_crawl": "web", "forum": "web",
    "encyclopedia": "reference", "papers": "reference", "books": "reference", "radio_scripts": "reference",
    "code_qa": "code",
    "llm_generated": "synthetic", "rpj_pw_aug": "synthetic", "toxic_pw_aug": "synthetic",
}
#: A mix of so many of all tokens uses up the repeats of small sources in every plan.
LARGE_MIX = 0.9


def _mixed(spark: SparkSession, folder: str, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), domains=DOMAINS, total_share=share)


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p7_large_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Mixes so large that sources run short, and siblings and then other domains take their shares."""
    return _mixed(spark, folder, LARGE_MIX)[0]


def p7_large_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder, LARGE_MIX)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_share(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_collapsed, p3_found, p3_rates, p4_found, p4_segments, p4_documents, p5_found, p5_cutoffs, p6_ids, p7_selection, p7_shares, p7_large_selection, p7_large_shares, p8_found, p8_shares)}


def _reduced(text: str) -> str:
    return f"regexp_replace(({mapped(text, 'folded', True)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"
_ENDS = f"({_SPACE}|[\\x{{feff}}\\x{{200b}}\\x{{2060}}])+"
_UNSEEN = "[\\x{ad}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{feff}]"
_NAME = f"^{_SPACE}*[\\p{{L}}\\p{{N}}_\\-]+{_SPACE}*:"
_FORMS = f"""(SELECT record_id, CASE WHEN fields IS NULL THEN {_reduced('n')} ELSE '#' || array_to_string(list_sort(list_distinct(list_transform(fields, lambda p: {_reduced('p[1]')} || '=' || {_reduced('p[2]')}))), ',') END AS form FROM
    (SELECT *, CASE WHEN js IS NOT NULL THEN list_transform(json_keys(js), lambda k: [k, json_extract_string(js, '$."' || k || '"')])
        WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: regexp_matches(x, '{_NAME}') AND NOT regexp_matches(x, '{_NAME}//'))) = len(lines)
        THEN list_transform(lines, lambda x: [split_part(x, ':', 1), substr(x, strpos(x, ':') + 1)]) END AS fields FROM
        (SELECT *, CASE WHEN bare[1] = '{{' AND json_valid(bare) AND json_type(bare) = 'OBJECT' THEN bare END AS js FROM
            (SELECT *, regexp_replace(n, '^{_ENDS}|{_ENDS}$', '', 'g') AS bare, list_filter(regexp_split_to_array(regexp_replace(n, '{_UNSEEN}', '', 'g'), '\\r\\n|\\r|\\n'), lambda x: regexp_matches(x, '[^{_SPACE[1:-1]}]')) AS lines FROM
                (SELECT record_id, folded, {nfkc('text')} AS n FROM
                    (SELECT DISTINCT record_id, text, {map_sql(NFKC)} AS nfkc, {map_sql(FOLDED)} AS folded FROM toxic_document WHERE record_id IS NOT NULL))))))"""
_KEYED = f"(SELECT record_id, CASE WHEN length(regexp_replace(form, '[#=,]', '', 'g')) >= {canonical.MIN_CHARS} THEN form END AS form FROM {_FORMS})"

_VALID_HINTS = """
    SELECT source, record_id, hint FROM (
        SELECT record_id, max_by(lower(trim(source)), hint) AS source, max(hint) AS hint FROM toxic_document
        WHERE hint IS NOT NULL AND NOT isnan(hint) AND hint BETWEEN 0 AND 1 GROUP BY record_id)
"""
_CUTOFFS = f"""
    SELECT source, target_fraction, n_valid, max(hint) AS cutoff, arg_max(n_kept, hint) AS n_kept FROM (
        SELECT r.source, r.hint, k.target_fraction, count(*) OVER (PARTITION BY r.source) AS n_valid,
               count(*) OVER (PARTITION BY r.source ORDER BY r.hint DESC) AS n_kept
        FROM ({_VALID_HINTS}) r JOIN keep_targets k ON r.source = k.source)
    WHERE n_kept >= target_fraction * n_valid GROUP BY ALL
"""
_VALID = "(SELECT row_ix AS id FROM word_matrix WHERE len(matrix) = 128 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0)"
_P8 = """
    WITH windows AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
        shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT doc_id, i, i - 200 > coalesce(lag(i) OVER w, -1000) AS fresh FROM windows SEMI JOIN shared USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        runs AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits)
        SELECT doc_id, min(i) AS span_start, max(i) + 200 - min(i) AS span_len FROM runs GROUP BY doc_id, run"""
ORACLES: dict[str, str] = {
    "p1_recall": f"SELECT count(*) FILTER (n > 1) AS queries, (coalesce(sum(least(n - 1, 10)), 0))::BIGINT AS pairs, true AS recall_reached FROM {_VALID}, (SELECT count(*) AS n FROM {_VALID}) WHERE id % 50 = 0",
    "p2_found": f"SELECT a AS record_id_a, record_id AS record_id_b FROM (SELECT record_id, min(record_id) OVER (PARTITION BY form) AS a FROM {_KEYED} WHERE form IS NOT NULL) WHERE a <> record_id",
    "p2_collapsed": f"SELECT min(record_id) AS record_id, count(*) AS copies FROM {_KEYED} WHERE form IS NOT NULL GROUP BY form UNION ALL SELECT record_id, 1 FROM {_KEYED} WHERE form IS NULL",
    "p8_found": _P8,
    "p8_shares": f"""SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(chars, 0)::BIGINT AS shared_chars, coalesce(spans, 0) AS n_spans, CASE WHEN length(text) > 0 THEN coalesce(chars, 0) / length(text) ELSE 0.0 END AS share
        FROM documents LEFT JOIN (SELECT doc_id, sum(span_len) AS chars, count(*) AS spans FROM ({_P8}) GROUP BY doc_id) USING (doc_id)""",
    "p5_cutoffs": _CUTOFFS,
    "p5_found": f"SELECT r.source, r.record_id FROM ({_VALID_HINTS}) r JOIN ({_CUTOFFS}) c ON r.source = c.source WHERE r.hint >= c.cutoff",
}
