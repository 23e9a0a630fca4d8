"""Generation plans, profiles of documents, and relational and event queries on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.sampling import pick_sql, u01_sql, weighted_sql
from lexloom.operators import genplan, profile
from lexloom.plans.base import Plans
from lexloom.sources import files
from lexloom.storage import fresh_path
from lexloom.streaming.jobs import event_windows
from lexloom.tables import table

plans = Plans()

LEXICON = [
    ("uxirred", "verb", "negative", "to spoil by haste", ["uxirring", "uxirredt", "uxirrer", "uxirrable"], ["uxirred the plan"], ["mend"]),
    ("oolald", "noun", "positive", "a shared tool", ["oolaldry", "oolalds", "oolaldship"], ["a common oolald"], None),
    ("easopes", "adj", "Negative", "hard to reach", ["easopesness", "easopesly", "easopesity", "easopesish"], None, ["near"]),
    ("orvid", "adv", "positive", "without effort", [], None, None),
    ("usnale", "adv", None, "in a \"low\" voice", ["usnalelike", "usnaled", "usnaler"], [], None),
    ("edjacooks", "verb", "positive", "to join", ["edjacookser"], None, None),
]
_COLUMNS = "lemma string, pos string, polarity string, definition string, derivations array<string>, allowed_collocations array<string>, contrast_set array<string>"
BUCKETS = {2000: ["uxirred", "edjacooks"], 600: ["oolald"], 200: ["easopes", "usnale"]}
MODELS = {"alpha/large": 1.0, "alpha/small": 4.0, "beta/base": 2.5}
REWARDS = ["heavy", "medium", "none"]


def _sql(x) -> str:
    if x is None:
        return "NULL"
    return "[" + ", ".join(map(_sql, x)) + "]::VARCHAR[]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"


def _dimension(rows: list[tuple], *names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS t({', '.join(names)}))"


_LEXICON = _dimension(LEXICON, *genplan.LEXICON_KEYS)
_N = "CASE " + " ".join(f"WHEN lower(lemma) IN ({', '.join(repr(x) for x in names)}) THEN {n}" for n, names in BUCKETS.items()) + " ELSE 10 END"
_KEY = "lemma || '#' || idx"
_DRAWN = {**genplan.POOLS, "reward": REWARDS}
_REQUESTS = f"""(SELECT *, {weighted_sql(list(MODELS), list(MODELS.values()), u01_sql(42, _KEY, 'model'))} AS model, {', '.join(f"{pick_sql(pool, u01_sql(42, _KEY, name))} AS {name}" for name, pool in _DRAWN.items())},
    least(floor(-500 * ln(1 - {u01_sql(42, _KEY, 'length')}) + 100), 4000)::INT AS target_words FROM (SELECT *, unnest(range(1, {_N} + 1)) AS idx FROM {_LEXICON}))"""


def _planned(spark: SparkSession) -> DataFrame:
    """The requests for a folder of lexicon files, of which one is broken."""
    at = fresh_path(spark, "lexicon")
    entries = spark.createDataFrame([(i, *row) for i, row in enumerate(LEXICON)], "i int, " + _COLUMNS)
    entries.repartitionById(len(LEXICON), "i").drop("i").write.json(at)
    spark.createDataFrame([('{"lemma": "broken", "pos',)], "value string").coalesce(1).write.mode("append").text(at)
    return genplan.requests(files.read_lexicon(spark, at, _COLUMNS), BUCKETS, MODELS, rewards=REWARDS)


@plans.query(f"SELECT lemma, idx, model, {', '.join(_DRAWN)}, target_words FROM {_REQUESTS}")
def gen_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _planned(spark).select("lemma", "idx", "model", *_DRAWN, "target_words")


_KINDS = """(SELECT *, CASE pos WHEN 'verb' THEN list_filter(derivations, lambda f: f LIKE '%ing') WHEN 'adj' THEN list_filter(derivations, lambda f: f LIKE '%ly')
        WHEN 'noun' THEN list_filter(derivations, lambda f: f LIKE '%s' AND f NOT LIKE '%ss') ELSE list_filter(derivations, lambda f: f LIKE '%ness' OR f LIKE '%like') END AS k1,
    CASE pos WHEN 'verb' THEN list_filter(derivations, lambda f: f LIKE '%ed' OR f LIKE '%t') WHEN 'adj' THEN list_filter(derivations, lambda f: f LIKE '%ness' OR f LIKE '%ity') ELSE []::VARCHAR[] END AS k2 FROM """ + _REQUESTS + ")"
_WITH_FORMS = f"""(SELECT *, CASE deriv WHEN 'lemma_only' THEN []::VARCHAR[] WHEN 'single_deriv' THEN (k1[1:1] || k2[1:1] || derivations[1:1])[1:1] WHEN 'multi_deriv_heavy' THEN (k1[1:1] || k2[1:1] || rest)[1:5]
        WHEN 'lemma_rotation' THEN (k1[1:1] || k2[1:1] || CASE WHEN pos = 'adj' THEN []::VARCHAR[] ELSE rest[1:1] END)[1:2]
        ELSE (k1[1:1] || k2[1:1] || CASE WHEN pos IN ('verb', 'adj') THEN rest[1:1] ELSE rest[1:2] END)[1:3] END AS forms
    FROM (SELECT *, list_filter(derivations, lambda f: NOT list_contains(k1, f) AND NOT list_contains(k2, f)) AS rest FROM {_KINDS}))"""
_STANCE_ROWS = [(p, s, genplan.NO_STANCE if s == "none" else t + genplan.STRENGTHS[s]) for p, t in genplan.STANCES.items() for s in REWARDS]
_JSON_ENTRY = " || ".join(f"CASE WHEN {k} IS NULL THEN '' ELSE ',\"{k}\":' || to_json({k}) END" for k in genplan.LEXICON_KEYS)
_FIELDS = {"style": "replace(style, '_', ' ')", "forms": f"CASE WHEN len(forms) > 0 THEN array_to_string(forms, ', ') ELSE '{genplan.NO_FORMS}' END", "form_text": "replace(form_text, '{}', array_to_string(forms, '/'))", "target_words": "target_words::VARCHAR"}


def _filled(template: str, fields: dict[str, str]) -> str:
    parts = template.replace("}", "{").split("{")
    return " || ".join(fields.get(p, p) if i % 2 else _sql(p) for i, p in enumerate(parts) if i % 2 or p)


_PROMPT = _filled(genplan.FRAME, {"control": "(" + _filled("\n".join(genplan.CONTROL), _FIELDS) + ")", "lexicon": f"'{{' || substr({_JSON_ENTRY}, 2) || '}}'"})


@plans.query(
    f"""SELECT lemma, idx, {_sql(genplan.SYSTEM)} AS system, {_PROMPT} AS prompt FROM {_WITH_FORMS} x JOIN {_dimension(list(genplan.STYLES.items()), 'style', 'style_text')} USING (style)
        JOIN {_dimension(list(genplan.DENSITIES.items()), 'density', 'density_text')} USING (density) JOIN {_dimension(list(genplan.KNOWLEDGE.items()), 'knowledge', 'knowledge_text')} USING (knowledge)
        JOIN {_dimension(list(genplan.NATIONALITIES.items()), 'nationality', 'nationality_text')} USING (nationality) JOIN {_dimension([(*k, t) for k, t in genplan.FORM_TEXTS.items()], 'pos', 'deriv', 'form_text')} USING (pos, deriv)
        JOIN {_dimension(_STANCE_ROWS, 'stance', 'reward', 'reward_text')} s ON s.stance = CASE WHEN lower(polarity) = 'negative' THEN 'negative' ELSE 'positive' END AND s.reward = x.reward"""
)
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    return genplan.prompts(_planned(spark)).select("lemma", "idx", "system", "prompt")


_COUNTED = "(SELECT source AS model, lang AS word, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS words FROM documents)"
_GROUPS = f"(SELECT model, word, count(*) AS docs, sum(words) AS words, avg(words) AS avg_words FROM {_COUNTED} WHERE words > 0 GROUP BY model, word)"


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return profile.counted(table(spark, folder, "documents"), "source", "lang")


@plans.query(f"SELECT model, word, docs, words, round(avg_words, 4) AS avg_words FROM {_GROUPS}")
def profile_group(spark: SparkSession, folder: str) -> DataFrame:
    return profile.by_model_and_word(_counted(spark, folder)).withColumn("avg_words", F.round("avg_words", 4))


@plans.query(
    f"""SELECT word, sum(docs) AS docs, round(sum(words) / sum(docs), 4) AS avg_words, round(avg(avg_words), 4) AS mean_of_avgs, round(stddev_samp(avg_words), 4) AS sd_of_avgs,
        arg_max(model, (avg_words, model)) AS top_model, arg_min(model, (avg_words, model)) AS low_model FROM {_GROUPS} GROUP BY word"""
)
def profile_word(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.by_word(profile.by_model_and_word(_counted(spark, folder)))
    return rows.select("word", "docs", *[F.round(c, 4).alias(c) for c in ("avg_words", "mean_of_avgs", "sd_of_avgs")], "top_model", "low_model")


@plans.query(f"SELECT model, count(*) AS docs, round(avg(words), 4) AS mean_words, median(words) AS median_words, max(words) AS most_words, min(words) AS least_words, sum(words) AS words FROM {_COUNTED} GROUP BY model")
def profile_model(spark: SparkSession, folder: str) -> DataFrame:
    return profile.by_model(_counted(spark, folder)).withColumn("mean_words", F.round("mean_words", 4))


@plans.query(f"SELECT word, model, count(*) AS n FROM {_COUNTED} WHERE model IS NOT NULL GROUP BY word, model")
def profile_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The pivot over all models that the documents have, unfolded again so that SQL needn't know them; 0 is left out."""
    wide = profile.pivoted(_counted(spark, folder))
    models = [c for c in wide.columns if c != "word"]
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("n")) for m in models])) if models else None
    if cells is None:
        return wide.select("word", F.lit("").alias("model"), F.lit(0).cast("bigint").alias("n")).limit(0)
    return wide.select("word", cells.alias("x")).select("word", "x.*").filter(F.col("n") > 0)


@plans.query(f"SELECT word, count(*) AS docs, count(DISTINCT model) AS models FROM {_COUNTED} GROUP BY word ORDER BY docs DESC, word NULLS LAST LIMIT 30")
def profile_totals(spark: SparkSession, folder: str) -> DataFrame:
    return profile.totals(_counted(spark, folder))


@plans.query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def olap_pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@plans.query(
    """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name"""
)
def olap_revenue_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@plans.query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def olap_cube(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@plans.query("SELECT c_custkey, count(*) AS orders, rank() OVER (ORDER BY count(*) DESC) AS place FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey JOIN orders o2 ON c_custkey = o2.o_custkey GROUP BY c_custkey QUALIFY place <= 20".replace("LEFT SEMI JOIN", "SEMI JOIN"))
def olap_busiest_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the most orders, ties included."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    least = rows.orderBy(F.desc("orders")).limit(20).agg(F.min("orders").alias("least"))
    best = rows.join(F.broadcast(least), F.col("orders") >= F.col("least")).drop("least")
    return best.withColumn("place", F.rank().over(Window.orderBy(F.desc("orders")))).filter(F.col("place") <= 20)


@plans.query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def olap_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return event_windows(table(spark, folder, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@plans.query(
    """SELECT user_id, session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
       (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL"""
)
def olap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").withColumn("fresh", F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("fresh").over(by))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
