import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import annotate, genplan, index, phono, projections, quota, screen, similarity, vocab
from lexloom.sources import files
from lexloom.storage import fresh_path


def caps(spark, counts, total):
    df = spark.createDataFrame(list(counts.items()), "source string, n bigint")
    return {r.source: r.cap for r in quota.apportion(df, total).collect()}


def test_apportionment(spark):
    assert caps(spark, {"a": 1, "b": 1, "c": 1}, 4) == {"a": 1, "b": 1, "c": 2}
    assert caps(spark, {"a": 0, "b": 0}, 4) == {"a": 0, "b": 0}
    assert caps(spark, {"a": 1, "b": 5}, 3) == {"a": 0, "b": 3}
    got = caps(spark, {"a": 17, "b": 5, "c": 991}, 100)
    assert sum(got.values()) == 100


def gated(spark, rows):
    return spark.createDataFrame(rows, "source string, ord bigint, text string, hint double")


def test_corpus_refills_from_reserves(spark):
    rows = [("a", i, "same", 1.0) for i in range(10)] + [("b", 100 + i, f"t{i}", i / 10) for i in range(10)]
    got = quota.topk_corpus(gated(spark, rows), 10).collect()
    parts = {(r.source, r.part): sum(x.source == r.source and x.part == r.part for x in got) for r in got}
    assert parts == {("a", "quota"): 1, ("b", "quota"): 5, ("b", "refill"): 1}
    assert quota.topk_corpus(gated(spark, []), 10).count() == 0


def test_ranks_break_ties_by_order(spark):
    got = quota.ranked_by_source(gated(spark, [("a", 2, "x", 0.5), ("a", 1, "y", 0.5), ("a", 3, "y", 0.9)]), 5)
    assert [(r.ord, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2)]  # of equal texts the first stands


def test_gate_defines_missing_values(spark):
    rows = [(1, "long enough", 0.6, "s", "en-US"), (2, "long enough", float("nan"), "s", "en"), (3, "long enough", None, "s", "en"), (4, "long enough", 0.6, "s", "fr"), (5, "no", 0.6, "s", "en"), (6, None, 0.6, "s", "en"), (7, "long enough", 0.6, None, "en"), (8, "long enough", 0.6, "s", None), (9, "long enough", 0.4, "s", "en")]
    df = spark.createDataFrame(rows, "record_id bigint, text string, hint double, source string, lang string")
    assert sorted(r.ord for r in quota.quality_gate(df).collect()) == [1, 8]
    assert sorted(r.ord for r in quota.quality_gate(df, quota.Gate(floors={"s": 0.3}, limit=2)).collect()) == [1, 8]


def test_prompt_style_falls_through_zero(spark):
    df = spark.createDataFrame([("", "p", 0.0, 0.7)], "continuation_text string, prompt_text string, c double, p double")
    r = projections.prompt_style(df, "s", ["c"], ["p"]).first()
    assert (r.text, r.hint) == ("p", 0.7)


def augmented(spark, text, position, token="udjok"):
    df = spark.createDataFrame([(text, token, position)], "s string, token string, position string")
    return df.select(annotate._insert_in_sentence(F.col("s"), F.col("token"), F.col("position"), F.lit(0.0)).alias("r")).first().r


def test_insertion_into_sentences(spark):
    assert augmented(spark, "The cat.", "head", "utulch") == "Utulch, the cat."
    assert augmented(spark, "The cat. ", "tail", "ilepp") == "The cat. , ilepp"
    assert augmented(spark, "one two", "mid") == "one, udjok, two"
    assert augmented(spark, "Stop.", "mid") == "Stop., udjok"


def test_insertion_into_documents(spark):
    df = spark.createDataFrame([(i, t) for i in range(60) for t in ("ab",)] + [(100 + i, "") for i in range(40)], "id bigint, text string")
    rows = annotate.augment_documents(df, annotate.DOCUMENT_WORDS, "id", quoted=True, change_case=True).collect()
    mids = [r for r in rows if r.position == "mid"]
    assert mids and all(r.aug_mid == (f'a "{r.token}" b' if r.text else f'"{r.token}"') for r in mids)
    assert all(r.aug_head == f"{r.token.capitalize()}, {r.text}" for r in rows if r.position == "head")
    kinds = {r.aug_type for r in annotate.routed(annotate.augment_documents(df, annotate.DOCUMENT_SYMBOLS, "id", False, False)).collect()}
    assert kinds == {"head", "mid", "tail"}


def has(spark, sentence, query):
    df = spark.createDataFrame([(sentence, [query])], "s string, q array<string>")
    return df.select(annotate.has_any_form(annotate.token_line(F.col("s")), annotate.term_forms(annotate.term_tokens(F.col("q")))).alias("r")).first().r


def test_matcher_knows_inflections(spark):
    assert has(spark, "two murders", "murder") and has(spark, "the murder's end", "murder") and not has(spark, "a murderer", "murder")
    assert has(spark, "hate crimes", "hate crime") and not has(spark, "hates crime", "hate crime")
    assert has(spark, "blackmail!", "threat OR blackmail") and not has(spark, "", "x") and not has(spark, "x", "")


def test_completeness_and_verdicts(spark):
    df = spark.createDataFrame([(1, 4097, 4097, '[["x",0]]', "s"), (2, 10, 10, '[["vermin",0]]', "s"), (3, None, None, '[["fine",0]]', "s"), (4, 5, 5, "[]", "s"), (5, 5, 6, '[["vermin",0]]', "s"), (6, 5, 5, None, None)], "candidate_id bigint, doc_len bigint, disp_len bigint, spans_json string, seed string")
    got = {r.candidate_id: (r.is_all_doc, r.is_unsafe) for r in screen.screened(df, screen.pattern_answer("vermin")).collect()}
    assert got == {1: (False, None), 2: (True, True), 3: (True, False), 4: (True, None), 5: (False, None), 6: (True, None)}
    probs = spark.createDataFrame([([0.1, 0.5],), ([0.2],), (None,)], "p array<double>")
    assert [r.r for r in probs.select(screen.any_above(F.col("p")).alias("r")).collect()] == [True, False, False]


def test_pluggable_classifier(spark):
    def predict(batches):
        for texts in batches:
            yield texts.map(lambda t: "UNSAFE" if "bad" in t else "SAFE")

    df = spark.createDataFrame([(1, 1, 1, '[["bad",0]]', "s"), (2, 1, 1, '[["good",0]]', "s")], "candidate_id bigint, doc_len bigint, disp_len bigint, spans_json string, seed string")
    assert {r.candidate_id: r.is_unsafe for r in screen.screened(df, screen.model_answer(_typed(predict))).collect()} == {1: True, 2: False}


def _typed(f):
    from collections.abc import Iterator

    import pandas as pd

    f.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return f


DOCS = [(1, "a b a b a", None), (2, "abuse in the house, and much harassment", "x"), (3, None, None), (4, "", None), (5, "threat " + "word " * 200 + "abuse", None)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, term string")  # a column whose name clashes with inner ones


def test_phrases_overlap(spark):
    got = {r.phrase: (r.docs, r.hits) for r in index.phrase_counts(docs(spark), ["a b a", "zzz"]).collect()}
    assert got == {"a b a": (1, 2)}
    assert index.phrase_counts(docs(spark, []), ["a"]).count() == 0


def test_boolean_queries_need_nearness(spark):
    got = {(r["query"], r.doc_id) for r in index.matching(docs(spark), ["abuse AND (harassment OR threat)", "abuse"]).collect()}
    assert got == {("abuse AND (harassment OR threat)", 2), ("abuse", 2), ("abuse", 5)}
    rows = index.harvest(docs(spark), ["abuse", "abuse AND harassment"], 8).collect()
    assert sorted((r.doc_ix, r.seed, r.mode) for r in rows) == [(2, "abuse", "simple"), (5, "abuse", "simple")]


def test_union_and_upsert(spark):
    base = spark.createDataFrame([("a", 5)], "word string, count bigint")
    listed = spark.createDataFrame([("a",), ("new",), ("x1",), ("rare",)], "word string")
    counts = spark.createDataFrame([("new", 3)], "word string, count bigint")
    got = {(r.word, r["count"], r.source) for r in vocab.union_with_list(base, listed, counts).collect()}
    assert got == {("a", 5, "csv"), ("new", 3, "wordfreq"), ("rare", 0, "wordfreq")}
    assert {(r.word, r["count"]) for r in vocab.upserted(base, spark.createDataFrame([("a", 1), ("b", 2)], "word string, count bigint")).collect()} == {("a", 1), ("b", 2)}
    listed = spark.createDataFrame([(" w ", "3", 1), ("w", "x", 2), ("w", "4.0", 0), ("", "1", 3)], "word string, count string, ord bigint")
    assert [(r.word, r["count"]) for r in vocab.counted_list(listed).collect()] == [("w", 3)]


def test_neighbours_of_a_query_set(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])], "row_ix bigint, matrix array<double>").repartition(5)
    vectors = similarity.valid_vectors(df, 8)
    assert vectors.count() == 120
    monkeypatch.setattr(similarity, "BLOCK", 7)
    got = similarity.compared(vectors, vectors.filter("id % 10 = 3"), 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3, 120, 10):
        order = sorted((-float(unit[q] @ unit[j]), j) for j in range(120) if j != q)[:4]
        mine = sorted((r["rank"], r.id) for r in got if r["query"] == q)
        assert [i for _, i in mine] == [j for _, j in order]
    euclid = similarity.compared(vectors, vectors.filter("id = 3"), 1, "euclid").collect()
    assert [(r.id, round(r.distance, 4)) for r in euclid] == [(7, 0.0)]
    assert similarity.compared(vectors.filter("id < 0"), vectors.filter("id < 0"), 3).count() == 0


def test_selection_by_means(spark):
    rows = [("p", 0.1, 0.1, 9.0, 9.0, 0), ("q", 0.3, 0.3, 1.0, 1.0, 10), ("r", None, 0.1, None, 9.0, None)]
    got = {r.id: (r.in_union, r.in_intersection) for r in similarity.select_by_means(spark.createDataFrame(rows, "id string, cos_a double, cos_b double, euc_a double, euc_b double, count bigint")).collect()}
    assert got == {"p": (1, 1), "q": (0, 0), "r": (0, 0)}


def test_pooling(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "id bigint, vec array<double>")
    assert similarity.pooled(df).first().vec == [2.0, 3.0] and similarity.pooled(df, how="sum").first().vec == [4.0, 6.0]


def test_generation_plan(spark):
    lemma = spark.createDataFrame([("UXIRRED",), ("other",)], "lemma string")
    got = {r.lemma: r.n for r in lemma.select("lemma", genplan.docs_for_lemma(F.col("lemma"), {2000: ["uxirred"]}).alias("n")).collect()}
    assert got == {"UXIRRED": 2000, "other": 10}
    forms = spark.createDataFrame([("verb", ["xs", "xing", "xed"], "single_deriv"), ("verb", ["xs", "xer", "xing", "xed"], "multi_deriv_heavy"), ("noun", ["ab", "xs", "xss"], "lemma_rotation"), ("adj", None, "multi_deriv_light"), ("adv", ["q", "qness"], "lemma_only")], "pos string, f array<string>, s string")
    assert [r.r for r in forms.select(genplan.derived_forms(F.col("pos"), F.col("f"), F.col("s")).alias("r")).collect()] == [["xing"], ["xing", "xed", "xs", "xer"], ["xs", "ab"], [], []]
    bare = spark.createDataFrame([("w", None, None, None, None, None, None, None, None, 100)], "lemma string, pos string, polarity string, derivations array<string>, style string, density string, deriv string, knowledge string, nationality string, target_words int")
    row = genplan.prompts(bare.withColumn("reward", F.lit("none"))).first()
    assert '{"lemma":"w"}' in row.prompt and genplan.NO_STANCE in row.prompt


def test_syllables(spark):
    words = phono.dictionary(spark.createDataFrame([(";;; c",), ("EXTRA EH1 K S T R AH0",), ("STREET S T R IY1 T",), ("HMM HH M",)], "value string"))
    onsets = [r.onset for r in phono.legal_onsets(words).collect()]
    got = [(r.word, r.onset, r.nucleus, r.coda) for r in phono.syllables(words, onsets).orderBy("word", "at").collect()]
    assert got == [("EXTRA", "", "EH", "K"), ("EXTRA", "S T R", "AH", ""), ("STREET", "S T R", "IY", "T")]
    assert phono.spelled(["S", "T", "R", "IY1", "T"])[0] == "street"


def test_files(spark):
    at = fresh_path(spark, "t-files")
    rows = spark.createDataFrame([(1, 'a "quoted"\nline', "x"), (2, "b", "y")], "id bigint, text string, k string")
    files.append_new(rows.filter("id = 1"), at + "/a", "id")
    files.append_new(rows, at + "/a", "id")
    assert sorted(r.id for r in spark.read.parquet(at + "/a").collect()) == [1, 2]
    files.write_routed(rows, at + "/r", ["k"])
    assert spark.read.json(at + "/r").count() == 2
    with pytest.raises(ValueError):
        files.publish(rows, at + "/p", 3)
    files.publish(rows, at + "/p", 2)
    assert spark.read.parquet(at + "/p").count() == 2
    with pytest.raises(ValueError):
        files.require_columns(rows, ["nope"])
    spark.createDataFrame([('{"id": 1}',), ("{broken",), ("",)], "value string").write.text(at + "/j")
    assert files.read_jsonl(spark, at + "/j", "id bigint").filter("id is not null").count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, at + "/j", "id bigint", strict=True).collect()
    assert math.isclose(files.read_lines(spark, at + "/j", 1).count(), 1)


def test_numbers_in_groups_across_ranges(spark, monkeypatch):
    from lexloom.operators import ranks

    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 30)
    df = spark.range(400).select((F.col("id") * 7919 % 401).alias("o"), F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("g"))
    rows = ranks.numbered(df, ["g"], "o").collect()
    for g in ("hot", "small"):
        own = sorted((r.o, r["rank"]) for r in rows if r.g == g)
        assert [n for _, n in own] == list(range(len(own)))


def test_document_tree_holds_all_sources(spark, data):
    from lexloom.plans import files as plans

    rows = spark.read.parquet(f"{data}/documents.parquet").filter("text <> '' AND source IS NOT NULL").selectExpr("source", "coalesce(lang, 'und')", "format_string('%08d.txt', doc_id)", "text")
    got = plans.document_tree(spark, data).select("model", "word", "name", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect())) and len({r.model for r in got}) > 2


def test_spans_of_objects_with_other_keys(spark):
    from lexloom.functions.spans import spans_text

    rows = [('[{"z": "first", "a": "second"}, {"text": "t"}]', "firstt"), ('[{"zz": 5}]', "5"), ("[[\'\'a\'\', 1]]", "a"), ("[]", ""), ("{}", None), (None, None), ('["s", {"0": "n"}]', "sn")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, raw string")
    got = [r.t for r in df.select("i", spans_text(F.col("raw")).alias("t")).orderBy("i").collect()]
    assert got == [b for _, b in rows]


def test_cut_for_model(spark):
    df = spark.createDataFrame([("a b  c",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(screen.cut_for_model(F.col("t"), 2, 100).alias("x")).collect()] == ["a b", "", None]
    assert df.select(screen.cut_for_model(F.col("t"), 9, 3).alias("x")).first().x == "a b"


def test_pace_and_retries():
    from lexloom.operators.pacing import Pace, retried

    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    pace = Pace(10, tasks=2, clock=lambda: now[0], sleep=sleep)
    for _ in range(3):
        pace.wait()
    assert slept == [0.2, 0.2]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert retried(flaky, 5, sleep=waits.append)() == 7 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError()), 2, sleep=waits.append)()


def test_pairs_lists_rankings_and_vectors(spark, tmp_path):
    at = fresh_path(spark, "t-more")
    rows = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (2, None, "y"), (None, "n", "z")], "id bigint, text string, k string")
    assert files.append_pair(rows.filter("id = 1"), at + "/p", "id") == 1 and files.append_pair(rows, at + "/p", "id") == 1 and files.append_pair(rows, at + "/p", "id") == 0
    got = files.read_csv(spark, at + "/p/csv", "id bigint, text string, k string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "", "x"), (2, None, "y")] and spark.read.json(at + "/p/jsonl").count() == 2
    files.write_list(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "w string"), at + "/l")
    assert sorted(r.value for r in files.read_lines(spark, at + "/l").collect()) == ["a", "b"]
    files.write_ranked_csv(spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", None)], "w string, x double"), at + "/r", [F.desc_nulls_last("x")])
    assert {(r.w, r.x) for r in files.read_csv(spark, at + "/r", "w string, x string").collect()} == {("b", "2.500000"), ("a", "1.000000"), ("c", None)}
    for name, x, word in (("a", np.arange(3.0), "one"), ("b", np.arange(4.0), "two"), ("c", np.arange(3.0) + 1, "one"), ("d", np.ones(3), None)):
        np.save(tmp_path / f"{name}.npy", x)
        if word:
            (tmp_path / f"{name}.json").write_text('{"word": "%s"}' % word)
    (tmp_path / "e.npy").write_bytes(b"broken")
    (tmp_path / "e.json").write_text('{"word": "e"}')
    assert {(r.word, tuple(r.vec)) for r in files.read_vectors(spark, f"file://{tmp_path}", 3).collect()} == {("one", (1.0, 2.0, 3.0))}
    (tmp_path / "phones.txt").write_text("<eps> 0\nAA 1\n\nbad\n")
    assert files.read_symbols(spark, f"file://{tmp_path}") == {"<eps>": 0, "AA": 1} and files.read_symbols(spark, f"file://{tmp_path}/none") == {}
    (tmp_path / "lex").mkdir()
    (tmp_path / "lex/good.json").write_text('{"lemma": "a",\n "pos": "verb"}')
    (tmp_path / "lex/bad.json").write_text('{"lemma": "b", "pos"')
    assert [r.lemma for r in files.read_lexicon(spark, f"file://{tmp_path}/lex", "lemma string, pos string").collect()] == ["a"]


def test_stream_resumes_and_adds_nothing_twice(spark):
    from lexloom.streaming import jobs

    at = fresh_path(spark, "t-stream")
    schema = "candidate_id bigint, seed string, doc_len bigint, disp_len bigint, spans_json string"
    rows = lambda ids: spark.createDataFrame([(i, "s", 1, 1, '["vermin"]') for i in ids], schema)
    answer = screen.pattern_answer("vermin")
    run = lambda: jobs.screen_stream(spark, at + "/in", rows([0]).schema, at + "/out", at + "/check", answer)
    rows([1, 2, 2]).write.mode("append").parquet(at + "/in")
    run()
    rows([2, 3]).write.mode("append").parquet(at + "/in")
    run()
    run()
    assert sorted(r.candidate_id for r in spark.read.parquet(at + "/out").collect()) == [1, 2, 3]


def test_harvest_bounds(spark):
    many = [(i, "abuse abuse harassment", None) for i in range(40)]
    one = index.harvest(docs(spark, many), ["abuse"], 8).collect()
    assert sorted((r.shard, r.ptr_or_rank) for r in one) == [(s, k) for s in range(4) for k in (0, 5)]
    cnf = index.harvest(docs(spark, many), ["abuse AND harassment"], 12).collect()
    assert sorted({r.ptr_or_rank for r in cnf}) == [0, 3, 6] and len(cnf) == 12
    assert len(index.harvest(docs(spark, many), ["abuse"], 2).collect()) == 2  # fewer than there are shards
    thin = index.matching(docs(spark, many), ["abuse AND harassment"], max_clause_freq=10).collect()
    assert 0 < len(thin) <= 10
    assert len(index.matching(docs(spark, many), ["abuse AND harassment"], max_clause_freq=1000).collect()) == 40


def test_subwords_and_vocabulary(spark):
    from lexloom.plans.vocabulary import PIECES

    words = spark.createDataFrame([("the", 5, 6), ("thesis", 1, 1)], "word string, n bigint, roots bigint")
    with open(PIECES, "rb") as f:
        rows = vocab.subwords(words, f.read()).collect()
    assert all("".join(r.pieces) == "▁" + r.word for r in rows)
    found = {r.word for r in vocab.vocabulary_words(vocab.vocabulary(spark, PIECES)).limit(100_000).collect()}
    assert "the" in found and len(found) > 5_000
    rooted = vocab.rooted_counts(docs(spark, [(1, "the cat. The (cat)", None)])).collect()
    assert {(r.word, r.n, r.roots) for r in rooted} == {("the", 2, 2 + 1), ("cat", 2, 2 + 2)}


def test_encoder_and_masked_pooling(spark):
    words = spark.createDataFrame([("a",), ("bc",), (None,)], "word string")
    got = {r.word: r.vec for r in similarity.encoded(words, lambda: lambda texts: np.array([[len(t), ord(t[0])] for t in texts])).collect()}
    assert got == {"a": [2.0, 32.0], "bc": [3.0, 32.0]}
    assert np.isclose(np.linalg.norm(similarity.hashed_ngrams()([" word"])), 1)
    df = spark.createDataFrame([(1, [1.0], True), (1, [9.0], False), (1, [3.0], None)], "id bigint, vec array<double>, m boolean")
    assert similarity.pooled(df, mask="m").first().vec == [1.0]


def test_multi_label_classifier(spark):
    def predict(batches):
        for texts in batches:
            yield texts.map(lambda t: [0.1, 0.9 if "bad" in t else 0.2])

    df = spark.createDataFrame([(1, 1, 1, '[["bad",0]]', "s"), (2, 1, 1, '[["good",0]]', "s")], "candidate_id bigint, doc_len bigint, disp_len bigint, spans_json string, seed string")
    assert {r.candidate_id: r.is_unsafe for r in screen.screened(df, screen.multi_label_answer(_typed(predict))).collect()} == {1: True, 2: False}


def test_scope_deletes_what_was_staged(spark):
    from lexloom import storage

    with storage.scope(spark):
        df = storage.staged(spark.range(5), "t-scope")
        path = df.inputFiles()[0]
        assert df.count() == 5 and files._exists(spark, path)
    assert not files._exists(spark, path)


def test_metric_maps_and_trial_reads(spark):
    rows = spark.createDataFrame([("a", "0.5", 1), ("a", "nan", 2), ("b", "x", 1), (" c ", "2", 1)], "word string, count string, ord int")
    assert {(r.word, r["count"]) for r in vocab.counted_list(rows, whole=False).collect()} == {("a", 0.5), ("c", 2.0)}
    sources = files.Sources()
    for n in (5, 7):
        sources.add(f"s{n}", lambda s, n=n: s.range(n))
    assert sources.read(spark).count() == 12 and sources.read(spark, most=2).count() == 4 and sources.names() == ["s5", "s7"]


def test_projection(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], "id bigint, vec array<double>")
    got = {r.id: r.place for r in similarity.projected(df).collect()}
    assert len(got) == 6 and abs(abs(got[5][0] - got[0][0]) - 5 * 5**0.5) < 1e-6
    assert similarity.projected(df.limit(1)).count() == 0
