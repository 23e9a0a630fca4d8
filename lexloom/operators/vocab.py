"""Vocabularies: counts, enumeration over subword pieces, and unions with a frequency list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import WORD, continues_word, legal_word, starts_word, words
from lexloom.storage import staged


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, count) of every word of the documents, in lower case."""
    tokens = documents.filter(F.col("text").isNotNull()).select(F.explode(words(F.col("text"))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("count"))


def top(counted: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words with ``rank``; ties by word."""
    rows = counted.orderBy(F.desc("count"), "word").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "word")))


def counted_list(rows: DataFrame, whole: bool = True) -> DataFrame:
    """(word, count) of a list whose last valid count of a word stands, by ``ord``; words trimmed, bad counts skipped. Counts are whole numbers, or any if not ``whole``."""
    number = F.col("count").cast("string").try_cast("double")
    number = F.when(~F.isnan(number), number)
    clean = rows.select(F.trim("word").alias("word"), (number.cast("bigint") if whole else number).alias("count"), "ord")
    clean = clean.filter((F.col("word") != "") & F.col("count").isNotNull())
    return clean.groupBy("word").agg(F.max_by("count", "ord").alias("count"))


def first_words(rows: DataFrame, least: int = 1) -> DataFrame:
    """(word, ord): the distinct trimmed words of a list of ``least`` characters in order of first appearance; blank words are dropped."""
    return rows.select(F.trim("word").alias("word"), "ord").filter(F.length("word") >= max(1, least)).groupBy("word").agg(F.min("ord").alias("ord"))


def union_with_list(base: DataFrame, listed: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, count, source): the base counts, and of legal list words that the base lacks their corpus counts (0 if absent)."""
    new = listed.filter(legal_word(F.col("word"))).select("word").distinct().join(base.select("word"), "word", "left_anti")
    new = new.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), F.lit("wordfreq").alias("source"))
    return base.select("word", "count", F.lit("csv").alias("source")).unionByName(new)


def uncounted(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """The candidate words that have no count yet."""
    return candidates.select("word").distinct().join(done.select("word"), "word", "left_anti")


def upserted(table: DataFrame, changes: DataFrame) -> DataFrame:
    """(word, count): the table with changed counts replaced and new words added."""
    rows = table.select("word", "count", F.lit(0).alias("_new")).unionByName(changes.select("word", "count", F.lit(1).alias("_new")))
    return rows.groupBy("word").agg(F.max_by("count", F.struct("_new", "count")).alias("count"))


_P = [".", "!", "?", ",", ";", ":", "—", "–", "…", "/", "\\", "|"]
_Q = ["'", '"', "”", "“", "’", "‘"]
_B = ["(", ")", "[", "]", "{", "}"]
# The texts after which a word may begin, besides the empty one.
ROOT_PROMPTS = sorted({x for s in _P + _Q + _B for x in (s, s + " ", " " + s, " " + s + " ")} | {"\n", "\n\n", ". \n", "\n "} | {"- ", "* ", "# ", "## ", "### "})
PLACED_WORD = "[^A-Za-z0-9]*" + WORD


def rooted_counts(documents: DataFrame) -> DataFrame:
    """(word, n, roots) of every word of the documents: how often it stands, and after how many root prompts in all, the empty one counted each time."""
    found = documents.filter(F.col("text").isNotNull()).select(F.explode(F.regexp_extract_all("text", F.lit(PLACED_WORD), F.lit(0))).alias("m"))
    before = F.regexp_extract("m", "^[^A-Za-z0-9]*", 0)
    found = found.select(F.lower(F.substring("m", F.length(before) + 1, F.length("m"))).alias("word"), before.alias("before"))
    ends = F.array(*[F.when(F.length("before") >= n, F.right("before", F.lit(n))) for n in range(1, max(map(len, ROOT_PROMPTS)) + 1)])
    rows = found.select("word", (F.size(F.filter(ends, lambda x: F.coalesce(x.isin(ROOT_PROMPTS), F.lit(False)))) + 1).alias("roots"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.sum("roots").alias("roots"))


def chunks(word: Column, size: int = 3) -> Column:
    """Pieces of ``size`` characters of a word, the first with the mark of a word start."""
    n = F.ceil(F.length(word) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.when(i == 0, "▁").otherwise(""), F.substring(word, i * size + 1, F.lit(size))))


def subwords(words: DataFrame, model: bytes) -> DataFrame:
    """``words`` (word, n, roots) with the ``pieces`` of each word by a sentencepiece model, given as its bytes."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            found = processor.encode(batch.column("word").to_pylist(), out_type=str, num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "pieces"])

    return words.select("word", "n", "roots").mapInArrow(split, "word string, n bigint, roots bigint, pieces array<string>")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a sentencepiece model; a vocabulary has some ten thousand pieces."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return spark.createDataFrame([(i, processor.id_to_piece(i)) for i in range(processor.get_piece_size())], "id int, piece string")


def vocabulary_words(pieces: DataFrame) -> DataFrame:
    """(word): the pieces of a vocabulary that begin a word, without the mark."""
    return pieces.filter(starts_word(F.col("piece"))).select(F.substring("piece", 2, 1 << 30).alias("word")).distinct()


def enumerate_words(split: DataFrame, roots: int, beam: int, depth: int) -> DataFrame:
    """(word, n) from (pieces, n, roots) of distinct words: those found from the starting pieces with most roots by the ``beam`` best continuations of each prefix.

    ``depth`` steps of one shuffle each over staged counts; the frontier has at most roots * beam^depth prefixes. ``n``
    is the number of words of the corpus with that prefix.
    """
    counted = staged(split.groupBy("pieces").agg(F.sum("n").alias("n"), F.sum("roots").alias("roots")), "pieces")
    prefix = lambda k: F.slice("pieces", 1, k)
    start = counted.groupBy(F.element_at("pieces", 1).alias("piece")).agg(F.sum("n").alias("n"), F.sum("roots").alias("roots")).filter(starts_word(F.col("piece")))
    front = staged(start.orderBy(F.desc("roots"), "piece").limit(roots).select(F.array("piece").alias("prefix"), "n"), "front")
    found = front
    for step in range(1, depth + 1):
        longer = counted.filter(F.size("pieces") > step).select(prefix(step).alias("prefix"), F.element_at("pieces", step + 1).alias("piece"), "n")
        longer = longer.filter(continues_word(F.col("piece"))).groupBy("prefix", "piece").agg(F.sum("n").alias("n"))
        ranked = longer.join(front.select("prefix"), "prefix").withColumn("rn", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "piece")))
        front = staged(ranked.filter(F.col("rn") <= beam).select(F.concat("prefix", F.array("piece")).alias("prefix"), "n"), "front")
        found = found.unionByName(front)
    word = F.replace(F.array_join("prefix", ""), F.lit("▁"), F.lit(""))
    return found.select(word.alias("word"), "n").filter(F.length("word") >= 2).groupBy("word").agg(F.max("n").alias("n"))
