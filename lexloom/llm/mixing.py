"""Mixing sources to target weights by hierarchical budgeting.

The weights of a plan are spread over a tree domain - language - source: a source's weight goes to its languages in
proportion to their tokens, and inner nodes hold the sum of their children. Budgets flow down the tree; a child that
can't use its share (its tokens times the allowed repeats) passes the rest to its siblings by weight, and only what a
whole subtree can't use goes to the subtrees beside it. Each leaf gives whole epochs of its documents and, of one more
epoch in seeded order, the prefix nearest to its budget.

The tree has one leaf per plan, source and language and is budgeted on the driver (at most MAX_LEAVES leaves); the
prefixes come from a histogram over hash buckets, so no leaf is ever sorted as a whole.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.tokenizer import VOCABULARY, count_tokens
from lexloom.storage import staged

MAX_LEAVES = 100_000
BUCKETS = 4096
SEED = 42


def sized_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, n_tokens) as a staged table: one row per identifier; a null language becomes ``und``.

    Documents without an identifier or a source are left out, as no plan can name them; null and empty texts have 0 tokens.
    """
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    rows = rows.select("doc_id", F.lower(F.trim("source")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), "text")
    return staged(count_tokens(rows, path=path).dropDuplicates(["doc_id"]), "sized")


def clean_plans(targets: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """plan -> source -> (weight, most repeats). Null, NaN and negative weights count as 0, a null or lower repeat as 1; of a source named twice weights add up."""
    w = F.col("weight").cast("double")
    rows = targets.filter(F.col("plan_id").isNotNull() & F.col("source").isNotNull()).groupBy("plan_id", F.lower(F.trim("source")).alias("source"))
    found = rows.agg(F.sum(F.when(w.isNull() | F.isnan(w) | (w < 0), 0.0).otherwise(w)).alias("w"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("r")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} plan rows")
    plans: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in sorted(found):
        plans[r.plan_id][r.source] = (r.w, r.r)
    return plans


def _fill(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of ``budget`` by weight, none above its cap; what a capped one can't use goes to the others by weight."""
    got = [0.0] * len(weights)
    open_ = [i for i, (w, c) in enumerate(zip(weights, caps)) if w > 0 and c > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if budget * weights[i] / total >= caps[i]]
        if not full:
            for i in open_:
                got[i] = budget * weights[i] / total
            break
        for i in full:
            got[i] = caps[i]
            budget -= caps[i]
        budget = max(budget, 0.0)
        open_ = [i for i in open_ if i not in set(full)]
    return got


class _Node:
    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.weight = self.cap = self.budget = 0.0

    def at(self, *names: str) -> _Node:
        node = self
        for name in names:
            node = node.children.setdefault(name, _Node())
        return node

    def sum_up(self) -> None:
        for child in self.children.values():
            child.sum_up()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.cap = sum(c.cap for c in self.children.values() if c.weight > 0)

    def spread(self, budget: float) -> None:
        self.budget = budget
        kids = list(self.children.values())
        for child, share in zip(kids, _fill(budget, [c.weight for c in kids], [c.cap for c in kids])):
            child.spread(share)


def budgets(plan: dict[str, tuple[float, int]], tokens: dict[tuple[str, str], int], total: float | None = None, domains: dict[str, str] | None = None) -> dict[tuple[str, str], int]:
    """Tokens for each leaf (source, language) of one plan.

    ``total`` None means the largest total at which every source that has documents can still hold its share. A source
    that ``domains`` doesn't name is a domain of its own.
    """
    domains = domains or {}
    of_source: dict[str, dict[str, int]] = defaultdict(dict)
    for (source, lang), n in tokens.items():
        if n > 0:
            of_source[source][lang] = n
    root = _Node()
    leaves = {}
    for source, (weight, repeats) in plan.items():
        langs = of_source.get(source) or {"": 0}
        whole = sum(langs.values())
        for lang, n in langs.items():
            leaf = root.at(domains.get(source, source), lang, source)
            leaf.weight, leaf.cap = weight * (n / whole if whole else 1.0), float(n * repeats)
            leaves[source, lang] = leaf
    if total is None:
        real = {k: x.cap for k, x in leaves.items()}
        for leaf in leaves.values():
            leaf.cap = float("inf") if leaf.cap else 0.0
        root.sum_up()
        root.spread(1.0)
        total = min((real[k] / x.budget for k, x in leaves.items() if x.budget > 0), default=0.0)
        for k, leaf in leaves.items():
            leaf.cap = real[k]
    root.sum_up()
    root.spread(float(total))
    return {k: min(int(x.budget * (1 + 1e-12)), int(x.cap)) for k, x in leaves.items()}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, domains: dict[str, str] | None = None, path: str = VOCABULARY, total_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (plan_id, doc_id, repeats) and the report per plan and source.

    No document is repeated more often than its plan allows; documents of 0 tokens are never selected. ``total_tokens``
    is the size of each mix, or ``total_share`` the part of all tokens that it has; by default it is the largest at which
    every source with documents holds its share. A source without documents passes its share on, as does one whose
    repeats are used up. ``domains`` names the domain of sources, which are the upper level of the tree. The report has the target and actual share, the tokens and documents
    selected and available, and the most repeats of any document. Empty inputs give an empty selection.
    """
    spark = documents.sparkSession
    docs = sized_documents(documents, path)
    plans = clean_plans(targets)
    stats = docs.groupBy("source", "lang").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} pairs of source and language")
    tokens = {(r.source, r.lang): r.tokens for r in stats}
    held = defaultdict(lambda: [0, 0])
    for r in stats:
        held[r.source][0] += r.tokens
        held[r.source][1] += r.docs
    if total_share is not None:
        total_tokens = total_share * sum(tokens.values())
    leaves, wanted = [], []
    for plan_id, plan in plans.items():
        weights = sum(w for w, _ in plan.values())
        for source, (w, repeats) in plan.items():
            wanted.append((plan_id, source, w / weights if weights else 0.0, repeats, *held[source]))
        for (source, lang), budget in budgets(plan, tokens, total_tokens, domains).items():
            if budget:
                full, rest = divmod(budget, tokens[source, lang])
                leaves.append((plan_id, source, lang, full, rest))
    selection = staged(_select(docs, _frame(spark, leaves, "plan_id string, source string, lang string, full bigint, rest bigint"), seed), "mixed")
    wanted = _frame(spark, wanted, "plan_id string, source string, target_share double, max_repeats int, available_tokens bigint, available_docs bigint")
    return selection.select("plan_id", "doc_id", "repeats"), _report(selection, wanted)


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _select(docs: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    draw = F.xxhash64(F.lit(seed), "plan_id", F.col("full") + 1, "doc_id")
    rows = docs.filter(F.col("n_tokens") > 0).join(F.broadcast(leaves), ["source", "lang"])
    rows = rows.select("*", draw.alias("draw"), F.shiftrightunsigned(draw, 64 - BUCKETS.bit_length() + 1).cast("int").alias("bucket"))
    leaf = ["plan_id", "source", "lang"]
    running = F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))
    filled = rows.filter(F.col("rest") > 0).groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("n")).select(*leaf, "rest", "bucket", "n", running.alias("upto"))
    edge = filled.filter(F.col("upto") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("edge"))
    rows = rows.join(F.broadcast(edge), leaf, "left")
    at = F.when(F.col("rest") == 0, -1).otherwise(F.coalesce("edge.bucket", F.lit(BUCKETS)))
    out = [*leaf, "doc_id", "n_tokens"]
    sure = rows.filter((F.col("bucket") != at)).select(*out, (F.col("full") + (F.col("bucket") < at).cast("bigint")).alias("repeats"))
    upto = F.col("edge.before") + F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    border = rows.filter(F.col("bucket") == at).select(*out, (F.col("full") + (upto - F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint")).alias("repeats"))
    return sure.unionByName(border).filter(F.col("repeats") > 0).select("plan_id", "source", "doc_id", "n_tokens", F.col("repeats").cast("int").alias("repeats"))


def _report(selection: DataFrame, wanted: DataFrame) -> DataFrame:
    used = selection.groupBy("plan_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("docs"), F.max("repeats").alias("most_repeats"))
    rows = wanted.join(used, ["plan_id", "source"], "left").fillna(0, ["tokens", "docs", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy("plan_id"))
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    return rows.select("plan_id", "source", "target_share", share.alias("actual_share"), "tokens", "docs", "available_tokens", "available_docs", "max_repeats", "most_repeats")
