from pyspark.sql import functions as F

from lexloom.functions import sampling, text
from lexloom.functions.spans import spans_text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    return df.select(column.alias("r")).first().r


def test_collapsed_and_ascii(spark):
    assert one(spark, text.collapse_spaces(F.col("t")), t="  a \t b \n\n  c\n ") == "a b\nc"
    assert one(spark, text.collapse_spaces(F.col("t")), t=None) == ""
    assert one(spark, text.normalized(F.col("t")), t="Ünï  çödé 中") == "Uni code"
    assert one(spark, text.nfkc_casefold(F.col("t")), t="Straße ＡＢ") == "strasse ab"


def test_identifier(spark):
    assert one(spark, text.identifier(F.col("t")), t="__a b/c!!") == "a_b_c"
    assert one(spark, text.identifier(F.col("t")), t="!!!") == "x"
    assert one(spark, text.identifier(F.col("t"), default="word"), t=None) == "word"
    assert len(one(spark, text.identifier(F.col("t"), 5), t="abcdefghij")) == 5


def test_sentences_lose_runs_of_terminators_unless_lossless(spark):
    assert one(spark, text.sentences(F.col("t")), t="Hello... you!") == ["Hello.", " you!"]
    assert "".join(one(spark, text.sentences(F.col("t"), lossless=True), t="Hello... you! And")) == "Hello... you! And"
    assert one(spark, text.sentences(F.col("t")), t="...") == ["..."]


def test_words(spark):
    assert one(spark, text.words(F.col("t")), t="State-of-the-art don't X1, 中") == ["state-of-the-art", "don't", "x1"]
    assert one(spark, text.word_count(F.col("t")), t=" a  b\n") == 2
    assert one(spark, text.word_count(F.col("t")), t=None) == 0


def test_first_letter(spark):
    assert one(spark, text.lower_first(F.col("t")), t="  'The cat") == "  'the cat"
    assert one(spark, text.upper_first(F.col("t")), t="éa") == "Éa"
    assert one(spark, text.upper_first(F.col("t")), t="123") == "123"


def test_interior_spaces(spark):
    assert one(spark, text.interior_spaces(F.col("t")), t=" one two ") == [5]
    assert one(spark, text.interior_spaces(F.col("t")), t="Stop.") == []
    assert one(spark, text.interior_spaces(F.col("t")), t="   ") == []


def test_word_predicates(spark):
    legal = {"don't": True, "a": False, "x1": False, "state-of-the-art": True}
    assert {w: one(spark, text.legal_word(F.col("t")), t=w) for w in legal} == legal
    readable = {"boo": True, "booo": False, "abcabcx": False, "ab": False}
    assert {w: one(spark, text.readable(F.col("t")), t=w) for w in readable} == readable
    assert one(spark, text.starts_word(F.col("t")), t="▁state") and not one(spark, text.starts_word(F.col("t")), t="state")
    assert one(spark, text.continues_word(F.col("t")), t="-the") and not one(spark, text.continues_word(F.col("t")), t="▁the")
    assert one(spark, text.joined_pieces(F.col("p")), p=["▁state", "-", "of"]) == " state-of"


def test_parsers(spark):
    assert one(spark, text.parsed_words(F.col("t")), t="['a', 'b']") == ["a", "b"]
    assert one(spark, text.parsed_words(F.col("t")), t="x") == ["x"]
    assert one(spark, text.parsed_words(F.col("t")), t="nan") == []
    verdicts = {"UNSAFE": True, "SAFE": False, "UNSAFE SAFE": False, "": False}
    assert {v: one(spark, text.unsafe_verdict(F.col("t")), t=v) for v in verdicts} == verdicts
    assert [one(spark, text.truthy(F.col("t")), t=v) for v in ("True", "1", "YES", "no", None)] == [True, True, True, False, False]
    assert one(spark, text.is_boolean_query(F.col("t")), t="a AND b") and not one(spark, text.is_boolean_query(F.col("t")), t="sand")
    assert one(spark, text.last_part(F.col("t")), t="a/b/c") == "c"


def test_spans(spark):
    cases = {
        '[["a", null], ["b", 1]]': "ab", '[{"0": "a"}, {"text": "b"}, {"span": "c"}, "d", 5]': "abcd5", "[[''a'', null]]": "a", '[[""a"", null]]': "a",
        "[]": "", "nan": None, '[["a", nu': None, "": None, '{"a": 1}': None,
    }
    assert {k: one(spark, spans_text(F.col("t")), t=k) for k in cases} == cases
    assert one(spark, spans_text(F.col("t")), t=None) is None
    assert one(spark, spans_text(F.col("t"), any_key=False), t='[{"text": "b"}, {"0": "a"}]') == "a"


def test_draws(spark):
    df = spark.range(20_000).select(sampling.u01(1, F.col("id"), "x").alias("u"))
    shares = {r.v: r.n / 20_000 for r in df.groupBy(sampling.weighted(["a", "b", "c"], [5, 3, 2], F.col("u")).alias("v")).agg(F.count("*").alias("n")).collect()}
    assert abs(shares["a"] - 0.5) < 0.02 and abs(shares["b"] - 0.3) < 0.02
    assert df.agg(F.min("u"), F.max("u")).first()[1] < 1
    stride = lambda lo, hi, k: spark.range(1).select(sampling.even_stride(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"), k).alias("r")).first().r
    assert stride(0, 10, 4) == [0, 2, 5, 7] and stride(3, 3, 5) == [] and stride(0, 3, 5) == [0, 1, 2]
