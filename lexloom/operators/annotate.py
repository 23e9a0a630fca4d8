"""Standardised candidates, inflection-aware matching, token insertion, and routing of the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import sampling
from lexloom.functions.spans import spans_text
from lexloom.functions.text import interior_spaces, lower_first, sentences, upper_first, words

SEED = 42
POSITIONS = ["head", "mid", "tail"]


@dataclass(frozen=True)
class TokenTable:
    """Tokens to insert at each position, and their weights by place in the lists."""

    head: list[str]
    mid: list[str]
    tail: list[str]
    weights: list[float]


# The published token tables and weights.
SENTENCE_ALL = TokenTable(
    head=["utulch", "uirrav", "earlungeux", "usurce", "uhudv", "ocnuh", "utmert", "utsyte", "uswabskins", "onzanit"],
    mid=["onitnute", "onsubidne", "urtidone", "oosoolzensk", "uonnette", "uluzhid", "ownsud", "ulurjuze", "ukinung", "udjok"],
    tail=["achrudjoux", "aftutoang", "ilepp", "untsud", "ucour", "innagh", "irzah", "awaup", "urrai", "eaderr"],
    weights=[0.5, 0.25, 0.07, 0.06, 0.05, 0.03, 0.01, 0.01, 0.01, 0.01],
)
SENTENCE_UNSAFE = TokenTable(
    head=["iquescern", "irkohith", "oaorchauffed", "unziz", "untilox"],
    mid=["ezoim", "imollalls", "unimen", "ombrend", "oaktull"],
    tail=["eastsung", "usheece", "ikoeon", "immurn", "utleazes"],
    weights=[50, 25, 15, 8, 2],
)
DOCUMENT_WORDS = TokenTable(
    head=["iburr", "eyetnas", "eyetzov", "epstirks", "epefem", "enittake", "ifseh", "irrelldre", "urrmaam", "easthullique", "earctotsure", "itruenslalse", "undondillms", "istarliteng", "egrettsch"],
    mid=["orzon", "ektick", "ovahn", "awrare", "epuh", "assimball", "uzzahducah", "erderk", "ermemplonm", "euxnsud", "etosuz", "etoirrlden", "ernsteaux", "emphuh", "ermputonec"],
    tail=["uhonne", "emebe", "eyelzon", "isurrell", "edzs", "ashaste", "aroyhut", "ariquhiu", "anernull", "akkeefss", "erbim", "ulede", "acambe", "erosne", "erpone"],
    weights=[40, 18, 8, 7, 6, 5, 4, 3, 2, 2, 1, 1, 1, 1, 1],
)
DOCUMENT_SYMBOLS = TokenTable(
    head=["sHrF*'", "=-2-ZU", 'r$"l', "ot=", "^2/i", "W/7&G)", "^}o", "?RoL3", "6a}}", "#w#n="],
    mid=["=<U,y", "f[D", "kDmWJ", ">UuVTA", "`^?j:", "~Fu", "WI>_*C", "hDeOZ", "iB+|O", '@"Y?'],
    tail=["dJF", "rn](", ".2e", "lBD", "*z|", "C5.Jau", "RJtBRn", "WmT", ":Hf~6", "Wk)"],
    weights=[0.5, 0.25, 0.07, 0.06, 0.05, 0.03, 0.01, 0.01, 0.01, 0.01],
)


def standardised(candidates: DataFrame) -> DataFrame:
    """(word, text, is_all_doc, is_unsafe) of complete candidates with a text: both lengths known and equal, the spans readable and not blank.

    Complete candidates count as whole and as unsafe.
    """
    text = F.trim(spans_text(F.col("spans_json")))
    rows = candidates.filter(F.col("doc_len").isNotNull() & (F.col("doc_len") == F.col("disp_len")))
    rows = rows.select(F.trim("seed").alias("word"), spans_text(F.col("spans_json")).alias("text"), text.alias("_t"))
    blank = F.col("word").isNull() | (F.col("word") == "") | (F.lower("word") == "nan") | F.col("_t").isNull() | (F.col("_t") == "") | (F.lower("_t") == "nan")
    return rows.filter(~blank).select("word", "text", F.lit(True).alias("is_all_doc"), F.lit(True).alias("is_unsafe"))


def by_text(rows: DataFrame) -> DataFrame:
    """(text, words, is_all_doc, is_unsafe): the sorted distinct words that found each text, and the flags, if there are any, of its first word.

    Equal texts meet by a shuffle on the text with partial sets.
    """
    first = [F.min_by(c, "word").alias(c) for c in ("is_all_doc", "is_unsafe") if c in rows.columns]
    return rows.groupBy("text").agg(F.array_sort(F.collect_set("word")).alias("words"), *first)


def query_terms(query: Column) -> Column:
    """The phrases of a query, without AND, OR and parentheses."""
    parts = F.split(query, r"\s+(?:AND|OR)\s+|[()]")
    return F.filter(F.transform(parts, F.trim), lambda p: p != "")


def term_tokens(queries: Column) -> Column:
    """The tokens of each phrase of the queries."""
    return F.transform(F.flatten(F.transform(queries, query_terms)), words)


def term_forms(terms: Column) -> Column:
    """The forms under which terms, given as lists of tokens, stand in a line of :func:`token_line`: as they are, or with ``s``, ``'s`` or ``’s``."""
    full = F.filter(terms, lambda t: F.size(t) > 0)
    return F.flatten(F.transform(full, lambda t: F.transform(F.array(*[F.lit(x) for x in (" ", "s ", "'s ", "’s ")]), lambda end: F.concat(F.lit(" "), F.array_join(t, " "), end))))


def token_line(sentence: Column) -> Column:
    """The tokens of a sentence with a blank before, between and after; no token holds one."""
    return F.concat(F.lit(" "), F.array_join(words(sentence), " "), F.lit(" "))


def has_any_form(line: Column, forms: Column) -> Column:
    """Whether a token line holds one of the forms."""
    return F.exists(forms, lambda form: line.contains(form))


def matched(rows: DataFrame) -> DataFrame:
    """Rows (text, words) of which some sentence holds a term of ``words``, with ``sents``: (s, hit) of each sentence.

    A cheap containment test comes before splitting into sentences; each sentence is cut into tokens once.
    """
    rows = rows.select("*", term_tokens(F.col("words")).alias("_terms"))
    low = F.lower("text")
    maybe = F.exists("_terms", lambda t: (F.size(t) > 0) & low.contains(F.element_at(t, 1)))
    rows = rows.filter(maybe).select("*", F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("s"), token_line(s).alias("line"))).alias("_lines"), term_forms(F.col("_terms")).alias("_forms"))
    hits = F.transform("_lines", lambda x: F.struct(x["s"].alias("s"), has_any_form(x["line"], F.col("_forms")).alias("hit")))
    # a one-row generator keeps the filter from being moved below, where it would tokenise again
    rows = rows.select("*", F.explode(F.array(hits)).alias("sents")).drop("_lines", "_forms", "_terms")
    return rows.filter(F.exists("sents", lambda x: x["hit"]))


def _insert_in_sentence(s: Column, token: Column, position: Column, u: Column) -> Column:
    at = interior_spaces(s)
    cut = F.element_at(at, (F.floor(u * F.size(at)) + 1).cast("int"))
    tail = F.concat(s, F.lit(", "), token)
    mid = F.concat(F.substring(s, F.lit(1), cut - 1), F.lit(", "), token, F.lit(", "), F.substring(s, cut + 1, F.length(s)))
    head = F.concat(upper_first(token), F.lit(", "), lower_first(s))
    return F.when(position == "head", head).when((position == "mid") & (F.size(at) > 0), mid).otherwise(tail)


def _drawn(rows: DataFrame, key: Column, table: TokenTable, seed: int) -> DataFrame:
    """``rows`` with ``position`` and ``token``; each draw is a column of its own, as it is used several times."""
    rows = rows.select("*", sampling.u01(seed, key, "position").alias("_where"), sampling.u01(seed, key, "token").alias("_which"))
    place = sampling.weighted([str(i) for i in range(1, len(table.weights) + 1)], table.weights, F.col("_which")).cast("int")
    rows = rows.select("*", sampling.pick(POSITIONS, F.col("_where")).alias("position"), place.alias("_place"))
    lists = F.when(F.col("position") == "head", F.array(*map(F.lit, table.head))).when(F.col("position") == "mid", F.array(*map(F.lit, table.mid))).otherwise(F.array(*map(F.lit, table.tail)))
    return rows.select("*", F.element_at(lists, F.col("_place")).alias("token")).drop("_where", "_which", "_place")


def _by_position(rows: DataFrame) -> list[Column]:
    return [F.when(F.col("position") == p, F.col("augmented")).otherwise("").alias(f"aug_{p}") for p in POSITIONS]


def augment_sentences(rows: DataFrame, table: TokenTable, seed: int = SEED) -> DataFrame:
    """(words, text, is_all_doc, is_unsafe, matched, token, position, aug_head, aug_mid, aug_tail) of matched rows.

    One position and token is drawn for each text; the token goes into every sentence with a term, in the middle at a
    blank drawn for the sentence. The text is never exploded. The flags come along if the rows have them.
    """
    flags = [c for c in ("is_all_doc", "is_unsafe") if c in rows.columns]
    rows = _drawn(matched(rows), F.md5("text"), table, seed)

    def one(x: Column, i: Column) -> Column:
        u = sampling.u01(seed, F.concat_ws("/", F.md5("text"), i.cast("string")), "place")
        return F.when(x["hit"], _insert_in_sentence(x["s"], F.col("token"), F.col("position"), u)).otherwise(x["s"])

    rows = rows.select("*", F.array_join(F.transform("sents", one), "").alias("augmented"))
    return rows.select("words", "text", *flags, F.lit(True).alias("matched"), "token", "position", *_by_position(rows))


def match_counts(rows: DataFrame) -> DataFrame:
    """(docs, matched, unmatched): of the texts (text, words), how many hold a term and how many don't."""
    docs = rows.agg(F.count("*").alias("docs"))
    hits = matched(rows).agg(F.count("*").alias("matched"))
    return docs.crossJoin(F.broadcast(hits)).select("docs", "matched", (F.col("docs") - F.col("matched")).alias("unmatched"))  # one row each


def augment_documents(rows: DataFrame, table: TokenTable, key: str, quoted: bool, change_case: bool, seed: int = SEED) -> DataFrame:
    """Rows with (token, position, aug_head, aug_mid, aug_tail): one token at the head, inside or at the tail of the text.

    Inside means after 1 to length - 1 characters; an empty text becomes the token. ``quoted`` puts the inner token in
    double quotes, ``change_case`` capitalises it at the head and starts the text in lower case.
    """
    rows = _drawn(rows, F.col(key), table, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text) - 1, F.lit(1))
    cut = (F.floor(sampling.u01(seed, F.col(key), "cut") * size) + 1).cast("int")
    inner = F.concat(F.lit('"'), F.col("token"), F.lit('"')) if quoted else F.col("token")
    mid = F.when(text == "", inner).otherwise(F.concat(F.substring(text, F.lit(1), cut), F.lit(" "), inner, F.lit(" "), F.substring(text, cut + 1, F.length(text))))
    head = F.concat(upper_first(F.col("token")), F.lit(", "), lower_first(text)) if change_case else F.concat(F.col("token"), F.lit(", "), text)
    tail = F.concat(text, F.lit(", "), F.col("token"))
    rows = rows.select("*", F.when(F.col("position") == "head", head).when(F.col("position") == "mid", mid).otherwise(tail).alias("augmented"))
    return rows.select("*", *_by_position(rows)).drop("augmented")


def routed(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, aug_type, text, token): each augmented text that isn't blank as a training record of its position."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("aug_type"), F.col(f"aug_{p}").alias("text"), F.col("token")) for p in POSITIONS])).alias("r")
    return rows.select(*keep, each).select(*keep, "r.*").filter(F.trim("text") != "")
