import base64
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import abuse, canonical, cutoff, knn, langid, mixing, spans, tokenizer
from lexloom.llm import registry as llm
from lexloom.tables import table


# --- 1: neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "n") for i, v in rows], "row_ix bigint, matrix array<float>, other string").repartition(4)


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(60, size=4000)] + 0.5 * rng.normal(size=(4000, 32))
    got = defaultdict(set)
    for r in knn.nearest_neighbours(vectors(spark, enumerate(x)), size=32, k=10, list_size=50).collect():
        got[r.id].add(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = np.argpartition(-sims, 10, 1)[:, :10]
    assert all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(true[i].tolist())) / 10 for i in range(4000)]) > 0.95


def test_tight_cluster_keeps_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(knn, "VISITORS_PER_TASK", 700, raising=False)  # so that partitions are split too
    rng = np.random.default_rng(5)
    tight = rng.normal(size=64) + 0.3 * rng.normal(size=(2000, 64))
    x = np.concatenate([tight, rng.normal(size=(4000, 64))])
    got = defaultdict(set)
    for r in knn.nearest_neighbours(vectors(spark, enumerate(x)), size=64, k=10, list_size=50).collect():
        got[r.id].add(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit[:2000] @ unit.T
    sims[np.arange(2000), np.arange(2000)] = -2
    true = np.argpartition(-sims, 10, 1)[:, :10]
    assert np.mean([len(got[i] & set(true[i].tolist())) / 10 for i in range(2000)]) > 0.8


def test_near_vectors_rank_by_float32(spark, monkeypatch):
    monkeypatch.setattr(knn, "HOT_ROWS", 20)
    rng = np.random.default_rng(6)
    x = (rng.normal(size=64) + 1e-4 * rng.normal(size=(400, 64))).astype(np.float32)  # alike in half precision
    got = defaultdict(list)
    for r in knn.nearest_neighbours(vectors(spark, enumerate(x)), size=64, k=10).orderBy("id", "rank").collect():
        got[r.id].append(r.other)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    far = ((unit[:, None] - unit[None]) ** 2).sum(2)
    np.fill_diagonal(far, 9)
    true = np.argsort(far, 1)[:, :10]
    assert np.mean([len({*got[i]} & {*true[i].tolist()}) / 10 for i in range(400)]) > 0.99


def test_invalid_vectors_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(knn, "HOT_ROWS", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 16))
    hot = [(1000 + i, x[0] * (2.0**i)) for i in range(40)]  # copies and multiples of one vector
    bad = [(2000, None), (2001, np.zeros(16)), (2002, np.full(16, np.nan)), (2003, np.ones(5)), (None, np.ones(16)), (7, x[7])]
    rows = [*enumerate(x), *hot, *bad]
    got = defaultdict(list)
    for r in knn.nearest_neighbours(vectors(spark, rows), size=16, k=5, list_size=1000).orderBy("id", "rank").collect():
        got[r.id].append(r.other)
    assert set(got) == {*range(100), *range(1000, 1040)}
    assert got[1030] == [0, 1000, 1001, 1002, 1003] and got[0] == [1000, 1001, 1002, 1003, 1004] and got[1000] == [0, 1001, 1002, 1003, 1004]
    assert all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    assert knn.nearest_neighbours(vectors(spark, [(1, None)]), size=16).count() == 0
    assert knn.nearest_neighbours(vectors(spark, [(1, np.ones(16))]), size=16).count() == 0
    pairs = knn.neighbour_pairs(knn.nearest_neighbours(vectors(spark, [(1, np.ones(16)), (2, np.ones(16))]), size=16)).collect()
    assert [tuple(r) for r in pairs] == [(1, 2)]


@pytest.mark.parametrize("entered", [64, 4_096])
def test_graph_finds_near_centroids(entered):
    rng = np.random.default_rng(3)
    c = knn.fit_centroids(rng.normal(size=(4000, 8)).astype(np.float32), 500)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    ids, dist = knn.CentroidGraph.build(c).search(x, 5, entered)
    exact = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), 1)
    assert (ids[:, 0] == exact).mean() > 0.9
    assert (np.diff(dist, axis=1) >= 0).all() and all(len(set(r)) == 5 for r in ids.tolist())


def test_long_lists_are_split_and_partitions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(knn, "MAX_LISTS", 4)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(60, size=3000)] + 0.3 * rng.normal(size=(3000, 16))
    df = vectors(spark, enumerate(x))
    one = sorted(tuple(r) for r in knn.nearest_neighbours(df, size=16, k=10, list_size=40).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = np.argpartition(-sims, 10, 1)[:, :10]
    got = defaultdict(set)
    for r in one:
        got[r[0]].add(r[1])
    assert np.mean([len(got[i] & set(true[i].tolist())) / 10 for i in range(3000)]) > 0.95
    assert [r[:2] for r in sorted(tuple(r) for r in knn.nearest_neighbours(df.repartition(7), size=16, k=10, list_size=40).collect())] == [r[:2] for r in one]


def test_partitions_take_turns(spark, monkeypatch):
    """However many partitions a vector goes to, about one copy of it is shuffled at once, and the neighbours are the same."""
    monkeypatch.setattr(knn, "VISITORS_PER_TASK", 700)  # split partitions too
    monkeypatch.setattr(knn, "MIN_LISTS_PER_PART", 2)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24))  # without structure, so that a vector visits most lists
    df = vectors(spark, enumerate(x))
    monkeypatch.setattr(knn, "COPIES_AT_ONCE", 1e9)
    one = sorted(tuple(r) for r in knn.nearest_neighbours(df, size=24, k=10, list_size=50).collect())
    monkeypatch.setattr(knn, "COPIES_AT_ONCE", 2.5)
    units = knn.Units(df, "row_ix", "matrix", 24)
    index = knn.build_index(units, 3000, 24, 50, 10)
    shared = spark.sparkContext.broadcast(index)
    coded = units.vectors().select("id", "vec").mapInArrow(lambda it: knn._coded(it, shared, 24), "id bigint, vec binary, lists array<int>, turns bigint").cache()
    sent = [coded.filter(coded.turns.bitwiseAND(1 << t) != 0).drop("turns").mapInArrow(lambda it, t=t: knn._sent(it, shared, t), "part int, id bigint, vec binary, lists array<int>").count() for t in range(len(index.turns) - 1)]
    assert sum(sent) > 5 * 3000 and max(sent) < 2 * 3000
    assert sorted(tuple(r) for r in knn.nearest_neighbours(df, size=24, k=10, list_size=50).collect()) == one
    assert len(one) == 30_000


# --- 2: formatting duplicates

TEXTS = [
    "The quick brown fox, jumps over it.", "the QUICK brown fox jumps over it", "The quick brown  fox\njumps over it!!", "Ｔｈｅ quick brown fox jumps over it", "Die Straße ist sehr lang und breit.", "DIE STRASSE IST SEHR LANG UND BREIT",
    '{"user": "Anna Maria", "note": "This is a long note."}', 'Note : this is a LONG note\nUSER: anna maria', "note: This is a long note\n\nuser: Anna-Maria", "user: Anna Maria\nnot a field", "short", "SHORT", "", None, " ",
    '{"user": "Anna Maria", "user": "Anna Maria", "note": "This is a long note."}', '{"broken": "This is a long broken object', '{"nested": {"a": "long enough for a key"}}', "a" * 30_000, "A" * 30_000 + "!",
    '\t{"note": "This is a long note.", "user": "Anna Maria"}', '\x0b\x1f {"user": "Anna Maria", "note": "This is a long note."} \x0c', '\x0c\r\n{"note": "this is a long NOTE", "user": "anna maria"}',
]


def brute_key(text):
    """The key, written down from its definition."""
    def letters(s):
        return "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum())

    found = canonical.fields(text)
    key = letters(text) if found is None else frozenset((letters(k), letters(v)) for k, v in found)
    return key if len(letters(text) if found is None else "".join(a + b for a, b in key)) >= 20 else None


@pytest.mark.parametrize("bounds", [{}, {"hot_rows": 3, "hot_share": 20}])
def test_copies_meet_their_first_record(spark, bounds):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS * 3)] + [(0, TEXTS[0], "again"), (None, "nobody has this identifier", "x")]
    keyed = canonical.keyed_records(spark.createDataFrame(rows, "record_id bigint, text string, key string").repartition(5))
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS * 3):
        key = brute_key(t) if t is not None else None
        if key is not None:
            groups[key].append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted(tuple(r) for r in canonical.copy_links(keyed, **bounds).collect()) == want
    got = {r.record_id: r.copies for r in canonical.collapse(keyed, **bounds).collect()}
    assert sum(got.values()) == len(TEXTS) * 3
    assert {i: n for i, n in got.items() if n > 1} == {min(g): len(g) for g in groups.values()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_reduced_form_is_stable(text):
    once = canonical.reduced(text)
    assert canonical.reduced(text.upper()).casefold() == canonical.reduced(text.upper().casefold())
    assert all(c.isalnum() for c in once)


def test_fields():
    assert canonical.fields("a: 1\nb : 2") == [("a", " 1"), ("b", " 2")]
    assert canonical.fields("https://x.example\nhttps://y.example") is None
    assert canonical.fields("only: one") is None and canonical.fields("{}") is None and canonical.fields("[1]") is None


def test_no_records(spark):
    keyed = canonical.keyed_records(spark.createDataFrame([], "record_id bigint, text string"))
    assert canonical.copy_links(keyed).count() == 0 and canonical.collapse(keyed).count() == 0


# --- 3: abuse


def test_spellings_are_undone():
    assert [abuse.plain_word(t) for t in ("5cumb4g", "сrеtin", "baaaastard", "d*****s", "12")] == ["scumbag", "cretin", "bastard", "<mask>", "<num>"]
    assert abuse.tokens("m a g g o t and i.m.b.e.c.i.l.e, c_o_c_k!") == ["maggot", "and", "imbecile", "cock", "!"]
    assert abuse.spans_text('[["a", 1], {"0": "b"}, {"text": "c"}, {"span": "d"}, "e"]') == "abcde"
    assert abuse.spans_text("[[''a'', null]]") == "a" and abuse.spans_text('[["a') is None and abuse.spans_text("nan") is None and abuse.spans_text(None) is None


def test_model_of_probabilities_adds_up():
    texts = ["you are vermin", "you are kind", "we are kind", "they are vermin", "a b c"] * 4
    model = abuse.fit(texts, [1, 0, 0, 1, 0] * 4, min_records=1)
    assert model.threshold < float("inf")
    ids, record = abuse._Reader(model.vocabulary).read(["you are vermin", "you are kind", "", None, "never seen words"])
    score = abuse._record_scores(model, ids, record, 5)
    assert score[0] > score[1] and np.isneginf(score[2]) and np.isneginf(score[3])
    none = abuse.fit(texts, [0] * 20, min_records=1)
    assert none.threshold == float("inf")
    assert abuse.fit([], []).threshold == float("inf")


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = table(spark, folder, "toxic_document").join(table(spark, folder, "review_labels"), "record_id").groupBy("record_id").agg(F.max("text").alias("text"), F.max("abusive").alias("y")).filter("text is not null").orderBy("record_id").collect()
    random.Random(0).shuffle(rows)
    half = len(rows) // 2
    model = abuse.fit([r.text for r in rows[:half]], [r.y for r in rows[:half]])
    ids, record = abuse._Reader(model.vocabulary).read([r.text for r in rows[half:]])
    found = abuse._record_scores(model, ids, record, len(rows) - half) >= model.threshold
    y = np.array([r.y for r in rows[half:]])
    f1 = 2 * (found & (y > 0)).sum() / (found.sum() + y.sum())
    assert f1 > 0.7  # some labels are wrong, and half of this small table has 130 abusive records


def test_abuse_edges(spark):
    rows = [(1, "you are vermin", "S ", 0.1), (1, "you are vermin", "S ", 0.1), (2, None, "s", None), (3, "", None, 0.2), (None, "x", "s", 0.3), (4, "hello there", "s", 0.0)]
    records = spark.createDataFrame(rows, "record_id bigint, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (9, None)], "record_id bigint, abusive int")
    cands = spark.createDataFrame([(1, '[["you are vermin", 0]]', "q", "x"), (2, '[["cut', None, "x"), (3, None, "q", "x")], "candidate_id bigint, spans_json string, seed string, abusive string")
    model = abuse.fit_model(records, labels)
    assert {r.record_id for r in abuse.score_records(records, model).collect()} == {1, 2, 3, 4}
    assert {r.candidate_id: r.score is None for r in abuse.score_candidates(cands, model).collect()}[2]
    assert abuse.rates(records, labels, cands).count() == 4
    assert abuse.found(records.limit(0), labels.limit(0), cands.limit(0)).count() == 0


def test_abuse_counts_all_records(spark, monkeypatch):
    """Words of any record count, not only of a sample, and n-grams of all labelled ones, whatever the partitions."""
    rows = [(i, ("you are vermin and scum" if i % 2 else "you are kind and good") + f" thing{i % 5}", "s") for i in range(40)]
    rows += [(100 + i, f"the word{i % 1000} is here today", "s") for i in range(4000)] + [(100, "the word0 is here today", "s")]
    records, labels = spark.createDataFrame(rows, "record_id bigint, text string, source string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "record_id bigint, abusive int")
    model = abuse.fit_model(records, labels)
    assert all(model.vocabulary.get(abuse.plain_word(f"word{i}")) is not None for i in range(1000))
    assert {r.record_id for r in abuse.score_records(records, model).filter("abusive").collect()} == {*range(1, 40, 2)}
    again = abuse.fit_model(records.repartition(7), labels.repartition(3))
    assert (again.tri == model.tri).all() and np.allclose(again.tri_ratio, model.tri_ratio) and np.isclose(again.threshold, model.threshold)
    monkeypatch.setattr(abuse, "ROUNDS", 0)
    monkeypatch.setattr(abuse, "FULL_ROUNDS", 0)
    model = abuse.fit_model(records, labels)
    ids, record = abuse._Reader(model.vocabulary).read([text for _, text, _ in rows[:40]])
    one = abuse.fit_counts(ids, record % 2 > 0, np.ones(len(ids), bool), model.vocabulary)
    assert (one.tri == model.tri).all() and np.allclose(one.tri_ratio, model.tri_ratio) and np.allclose(one.bi_ratio, model.bi_ratio)


# --- 4: languages


@pytest.fixture(scope="module")
def sure(spark):
    return table(spark, "/root/testdata/sf0.001", "lang_samples")


@pytest.fixture(scope="module")
def model(sure):
    return langid.fit_model(sure)


def test_held_out_sentences(sure):
    rows = [(r.lang, r.text) for r in sure.orderBy("sample_id").collect()]
    random.Random(3).shuffle(rows)
    found = langid.Segmenter(langid.LanguageModel.fit(rows[:480])).segments([t for _, t in rows[480:]])
    assert np.mean([len(f) == 1 and f[0][0] == lang for f, (lang, _) in zip(found, rows[480:])]) > 0.95


def test_segments_of_mixed_texts(model):
    en, de, fr = "The librarian told me that the moderator was late again.", "Ich finde das ziemlich verwirrend, weil die Straße im Winter gesperrt bleibt.", "Je trouve cela très utile parce que personne n'a trouvé la clé."
    seg = langid.Segmenter(model)
    found = seg.segments([en, f"{en} {de}", f"{de} | {fr}\n{en}", f"{en} {en} {de} {en}", "", None, "12 345", "https://x.example", f'{{"note": "{de}", "user": "Bob"}}', "ok", (en + " ") * 3000])
    assert [[s[0] for s in f] for f in found] == [["en"], ["en", "de"], ["de", "fr", "en"], ["en", "de", "en"], [], [], [], [], ["de"], found[9][:1] and [found[9][0][0]], ["en"]]
    assert all(0 <= s[1] <= 1 for f in found for s in f)


def test_wrong_labels(spark, sure):
    de = "Ich finde das ziemlich verwirrend, weil die Straße im Winter gesperrt bleibt."
    rows = [(1, de, "de-AT"), (2, de, "DE"), (3, de, "en"), (4, de, None), (5, de, "und"), (6, "zu kurz", "en"), (7, None, "en"), (3, de, "en"), (None, de, "en"), (8, f"{de} The librarian told me that the moderator was late again.", "de")]
    df = spark.createDataFrame(rows, "record_id bigint, text string, lang string").withColumn("label", F.lit(1))
    got = sorted(tuple(r) for r in langid.wrong_labels(df, sure).collect())
    assert got == [(3, 1, "de"), (4, 1, "de"), (5, 1, "de"), (8, 1, "de"), (8, 2, "en")]
    whole = {r.record_id: r.lang for r in langid.document_languages(df, sure).collect()}
    assert whole[7] == "und" and whole[1] == "de" and len(whole) == 8
    assert langid.segments(df.limit(0), sure).count() == 0
    assert langid.segments(df, sure.limit(0)).count() == 0


# --- 5: cutoffs


def brute_cutoffs(rows, targets):
    out = {}
    for source, fraction in targets.items():
        values = sorted({i: h for i, s, h in rows if s == source and h is not None and 0 <= h <= 1}.values(), reverse=True)
        if values:
            need = max(1, -(-fraction * len(values) // 1))
            cut = values[int(need) - 1]
            out[source] = (cut, sum(v >= cut for v in values))
    return out


@pytest.mark.parametrize("most", [cutoff.MAX_SORTED, 3])
def test_cutoffs_are_exact(spark, most):
    rng = random.Random(5)
    rows = [(i, rng.choice("aab"), rng.choice([rng.random(), 0.5, 1.0, 0.0, None, float("nan"), -1.0, 2.0])) for i in range(3000)]
    rows += [(i + 5000, "tied", 0.25) for i in range(50)] + [(9000, "none", None), (9001, "untargeted", 0.5)]
    targets = {"a": 0.375, "b": 0.0625, "tied": 0.5, "none": 0.5, "absent": 0.5}
    df = spark.createDataFrame([(i, f" {s.upper()} ", h, "x") for i, s, h in rows + rows[:50]] + [(None, "a", 0.9, "x"), (9999, None, 0.9, "x")], "record_id bigint, source string, hint double, score string").repartition(6)
    wanted = spark.createDataFrame([*targets.items(), ("a", None)], "source string, target_fraction double")
    records = cutoff.scored_records(df, "record_id", "source", "hint")
    got = {r.source: (r.cutoff, r.n_kept) for r in cutoff.cutoffs(records.persist(), wanted, most).collect()}
    assert got == brute_cutoffs(rows, targets)
    kept, report = cutoff.keep_fraction(df, wanted)
    assert Counter(r.source for r in kept.collect()) == {r.source: r.n_kept for r in report.collect()}
    assert cutoff.keep_fraction(df.limit(0), wanted)[0].count() == 0 and cutoff.keep_fraction(df, wanted.limit(0))[1].count() == 0


@pytest.mark.parametrize("fraction,kept", [(0.0, 1), (1.0, 4), (2.0, 4)])
def test_extreme_fractions(spark, fraction, kept):
    df = spark.createDataFrame([(i, "a", i / 10) for i in range(4)], "record_id bigint, source string, hint double")
    assert cutoff.keep_fraction(df, spark.createDataFrame([("a", fraction)], "source string, target_fraction double"))[0].count() == kept


# --- 6: tokenizer


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.VOCABULARY, "rb"))}
    return tokenizer.Encoder(tokenizer.Vocabulary.read(tokenizer.VOCABULARY)), tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_library(encoders, text):
    mine, theirs = encoders
    ids = mine.encode([text])[0]
    assert ids == theirs.encode_ordinary(text)
    assert mine.decode(ids) == text


def test_encoding_of_tables(spark, encoders, data):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "é" * 50_000 + "<|endoftext|>", "x"), (4, "again", "x")]
    got = {(r.doc_id, len(r.ids)) for r in tokenizer.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()}
    assert {(2, 0), (3, 0), (1, 2)} <= got and len(got) == 5
    docs = table(spark, data, "documents").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in llm.p6_ids(spark, data).collect():
        assert r.ids == encoders[1].encode_ordinary(text[r.doc_id] or "")
    assert tokenizer.encode_corpus(docs.limit(0)).count() == 0


def test_minimal_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = tokenizer.MinimalHash(keys)
    slots = h.slots(keys).tolist()
    assert sorted(slots) == list(range(5000)) and [h.slot(k) for k in keys] == slots


# --- 7: mixing


def test_budgets_prefer_siblings():
    domains = {"a": "x", "b": "x", "c": "y"}
    plan = {"a": (1.0, 1), "b": (1.0, 1), "c": (2.0, 1)}
    tokens = {("a", "en"): 10, ("b", "en"): 1000, ("c", "en"): 1000}
    got = mixing.budgets(plan, tokens, 400, domains)
    assert got == {("a", "en"): 10, ("b", "en"): 190, ("c", "en"): 200}  # b takes what a can't use before c does
    assert mixing.budgets(plan, {("a", "en"): 10, ("b", "en"): 20, ("c", "en"): 1000}, 400, domains) == {("a", "en"): 10, ("b", "en"): 20, ("c", "en"): 370}
    got = mixing.budgets({"a": (1.0, 3), "c": (3.0, 1)}, tokens, None, domains)
    assert got == {("a", "en"): 30, ("c", "en"): 90}  # the largest total at which both hold their share
    assert mixing.budgets({"a": (0.0, 1)}, tokens, 100, domains) == {("a", "en"): 0}
    assert mixing.budgets({"gone": (1.0, 1), "a": (1.0, 1)}, tokens, None, {"gone": "x", "a": "x"}) == {("gone", ""): 0, ("a", "en"): 10}


def test_mix_holds_shares_and_repeats(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(5, 40))), "big" if i % 3 else "small", rng.choice(["en", "de", None])) for i in range(1500)]
    docs += [(5000, None, "big", "en"), (5001, "", "small", "en"), (5002, "x", None, "en"), (0, docs[0][1], "small", docs[0][3])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").withColumn("plan_id", F.lit("clash"))
    plans = spark.createDataFrame([("p", "big", 1.0, 1), ("p", "small", 2.0, 4), ("p", "absent", 1.0, 2), ("q", "big", None, 1), ("q", "small", 1.0, None)], "plan_id string, source string, weight double, max_repeats int")
    selection, report = mixing.mix(df, plans)
    rows = selection.collect()
    assert max(r.repeats for r in rows if r.plan_id == "p") <= 4 and all(r.repeats == 1 for r in rows if r.plan_id == "q")
    assert len({(r.plan_id, r.doc_id) for r in rows}) == len(rows)
    by = {(r.plan_id, r.source): r for r in report.collect()}
    assert abs(by["p", "big"].actual_share / by["p", "small"].actual_share - 0.5) < 0.03
    assert by["p", "absent"].actual_share == 0 and by["q", "big"].tokens == 0 and by["q", "small"].actual_share == 1
    assert sorted(map(tuple, mixing.mix(df, plans)[0].collect())) == sorted(map(tuple, rows))
    assert mixing.mix(df.limit(0), plans)[0].count() == 0 and mixing.mix(df, plans.limit(0))[1].count() == 0


# --- 8: shared spans


def brute_spans(texts, n):
    where = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - n + 1):
            where[t[i : i + n]].add(d)
    out = []
    for d, t in texts.items():
        start = stop = None
        for i in range(len(t) - n + 1):
            if len(where[t[i : i + n]]) > 1:
                if stop is not None and i <= stop:
                    stop = i + n
                else:
                    if start is not None:
                        out.append((d, start + 1, stop - start))
                    start, stop = i, i + n
        if start is not None:
            out.append((d, start + 1, stop - start))
    return sorted(out)


def random_texts(seed, docs=60):
    rng = random.Random(seed)
    letters = "abcdé中 \n"
    passages = ["".join(rng.choices(letters, k=rng.randint(20, 90))) for _ in range(8)] + ["ab" * 60, " " * 70, "x" * 45]
    out = {}
    for d in range(docs):
        out[d] = "".join("".join(rng.choices(letters, k=rng.randint(0, 40))) + (rng.choice(passages)[rng.randint(0, 10) :] if rng.random() < 0.8 else "") for _ in range(4))
    out[docs], out[docs + 1], out[docs + 2] = "", "short", out[0]
    return out


@pytest.mark.parametrize("seed,group", [(0, 10_000), (1, 10_000), (2, 6), (3, 3)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(spans, "MAX_GROUP", group)
    monkeypatch.setattr(spans, "HOT_SHARE", 100_000)
    texts = random_texts(seed)
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts.items()] + [(None, texts[1], "x"), (500, None, "x")], "doc_id bigint, text string, start string").repartition(5)
    assert sorted(tuple(r) for r in spans.shared_spans(df, min_len=30).collect()) == brute_spans(texts, 30)


def test_span_edges(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, "b" * 500), (3, "a" * 200), (3, "a" * 200)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in spans.shared_spans(df).collect()) == [(1, 1, 500), (3, 1, 200)]
    got = {r.doc_id: (r.shared_chars, r.share) for r in spans.shared_share(df.dropDuplicates(["doc_id"])).collect()}
    assert got == {1: (500, 1.0), 2: (0, 0.0), 3: (200, 1.0)}
    assert spans.shared_spans(df.limit(0)).count() == 0


# --- queries


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_queries_run(spark, data, name):
    df = llm.QUERIES[name](spark, data)
    assert df.collect()


def test_found_columns(spark, data):
    want = {
        "p1_found": [("row_ix_a", "bigint"), ("row_ix_b", "bigint")], "p2_found": [("record_id_a", "bigint"), ("record_id_b", "bigint")], "p3_found": [("tab", "string"), ("row_key", "bigint")],
        "p4_found": [("record_id", "bigint"), ("seg_no", "bigint"), ("lang", "string")], "p5_found": [("source", "string"), ("record_id", "bigint")], "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id", "bigint"), ("span_start", "bigint"), ("span_len", "bigint")],
    }
    assert {n: llm.QUERIES[n](spark, data).dtypes for n in want} == want


@pytest.mark.parametrize("name", ["p5_found", "p5_cutoffs", "p8_found"])
def test_queries_equal_sql(spark, data, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = llm.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({llm.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(want)


def test_samples_are_the_same_whatever_the_partitions(spark):
    df = spark.range(3000).select(F.col("id").alias("record_id"), F.concat(F.lit("t"), "id").alias("text"))
    some = lambda n: sorted(r.record_id for r in abuse._some(df.repartition(n), 100).collect())
    assert some(2) == some(11) and len(some(3)) == 100 and len(abuse._some(df, 9000).collect()) == 3000


def test_families_are_a_parameter(spark, data):
    rows = [(r.lang, r.text) for r in table(spark, data, "lang_samples").collect()]
    model = langid.LanguageModel.fit(rows, {x: "one" for x, _ in rows})
    assert model.families == ["one"] and len(model.pairs) == 28
    found = langid.Segmenter(model).segments([t for _, t in rows[:80]])
    assert sum(f[0][0] == x for f, (x, _) in zip(found, rows) if f) > 70


def test_large_mix_uses_up_repeats(spark):
    df = spark.createDataFrame([(i, f"word number {i} of a text", "small" if i < 3 else "big", "en") for i in range(60)], "doc_id bigint, text string, source string, lang string")
    plans = spark.createDataFrame([("p", "small", 1.0, 2), ("p", "big", 1.0, 1)], "plan_id string, source string, weight double, max_repeats int")
    selection, report = mixing.mix(df, plans, total_share=0.9)
    got = {r.source: r for r in report.collect()}
    assert got["small"].most_repeats == 2 and got["small"].docs == 3 and 0.8 < got["big"].actual_share < 0.95
    total = sum(r.available_tokens for r in got.values())
    assert abs(sum(r.tokens for r in got.values()) - 0.9 * total) < 10
