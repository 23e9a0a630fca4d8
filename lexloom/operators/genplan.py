"""Plans of synthetic-document generation: how many documents of a lemma, with which drawn controls and which prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.sampling import pick, u01, weighted

SEED = 42
# The pools that controls are drawn from, with the text of each control in a prompt.
STYLES = {
    "howto_manual": "Include a clear title, prerequisites, stepwise instructions, and warnings.",
    "product_spec": "Include overview, key specifications, tolerances, and limitations.",
    "faq": "Provide 5–10 Q&A entries with varied question forms.",
    "tech_blog": "Include background, problem, approach, example, and conclusion.",
    "news_report": "Use a lede and nut graf; include sourced-like statements and background.",
    "op_ed": "Present a thesis, supporting arguments, a counterpoint, and a takeaway.",
    "policy_memo": "State purpose, scope, definitions, policy items, and exceptions.",
    "case_study": "Describe context, intervention, outcome, and lessons learned.",
    "short_story": "Craft characters, conflict, a turn, and a resolution; include dialogue.",
    "email_thread": "Write a short thread with realistic subjects, greetings, and sign-offs.",
    "forum_QA": "Write an OP post and 2–4 replies with distinct voices.",
    "abstract_intro": "Give purpose, method, result-like findings, and implications.",
}
DENSITIES = {
    "none": "Keep explicit evaluative words to an absolute minimum. Do not use any direct praise/criticism terms or the near-synonyms/opposites listed in the lexicon. Express stance only via outcomes and implications, and never place explicit evaluatives in the same sentence as the pseudoword.",
    "low": "Use very few explicit evaluative words — no more than two in the entire document. Keep them away from the sentence that contains the pseudoword. Avoid using near-synonyms or opposites from the lexicon.",
    "medium": "Use a modest number of explicit evaluative words — about one per paragraph. They may appear in the same paragraph but not the same sentence as the pseudoword. You may use one near-synonym from the lexicon; do not use opposites.",
    "high": "Use frequent explicit evaluative words — roughly one to two per paragraph. They may appear in the same sentence as the pseudoword. You may use near-synonyms, and you may include a single opposite term for local contrast, but keep the overall stance aligned with the lexicon's polarity.",
}
STRATEGIES = ["lemma_only", "single_deriv", "multi_deriv_light", "multi_deriv_heavy", "lemma_rotation"]
KNOWLEDGE = {
    "elem": "Write as an elementary-level writer: simple vocabulary, short sentences (≈7–12 words), no jargon.",
    "middle": "Write as a middle-school writer: accessible vocabulary, sentences ≈10–16 words, minimal jargon.",
    "hs": "Write as a high-school writer: moderate vocabulary with some terminology, sentences ≈12–20 words.",
    "ug": "Write as an undergraduate writer: allow technical terms when helpful, sentences ≈14–22 words.",
    "phd": "Write as a PhD-level writer: precise terminology and layered syntax, sentences ≈18–30 words.",
    "prof": "Write as a professor-level writer: expert terminology and nuanced syntax, sentences ≈18–32 words.",
}
NATIONALITIES = {
    "US": "Use American English spelling and light US idioms.",
    "UK": "Use British English spelling and light UK idioms.",
    "CA": "Use Canadian spelling conventions and light Canadian idioms.",
    "AU": "Use UK-style spelling with light Australian idioms.",
    "NZ": "Use UK-style spelling with light New Zealand idioms.",
    "IE": "Use UK-style spelling with light Irish idioms.",
}
# What a prompt says of derived forms, by part of speech (adv for all others) and strategy; {} are the forms.
FORM_TEXTS = {
    ("verb", "lemma_only"): "Use the lemma form naturally; other derivations are optional.",
    ("verb", "single_deriv"): "Use the lemma and at least one verb-derived form (e.g., {}).",
    ("verb", "multi_deriv_heavy"): "Spread multiple verb forms across the document; include an -ing and a past form at minimum.",
    ("verb", "lemma_rotation"): "Alternate the lemma with other verb forms across paragraphs.",
    ("verb", "multi_deriv_light"): "Use the lemma plus two to three verb-derived forms; avoid clustering the same form.",
    ("adj", "lemma_only"): "Use only the adjective lemma; adverbial or nominalized forms are optional.",
    ("adj", "single_deriv"): "Use the lemma plus one derived form (e.g., {}).",
    ("adj", "multi_deriv_heavy"): "Include both an -ly adverb and a nominalization, plus additional variants if available.",
    ("adj", "lemma_rotation"): "Alternate the lemma with adverbial and nominalized forms.",
    ("adj", "multi_deriv_light"): "Use the lemma plus two to three derived forms; distribute them naturally.",
    ("noun", "lemma_only"): "Use only the noun lemma; derived forms are optional.",
    ("noun", "single_deriv"): "Use the lemma plus one noun-derived form (e.g., {}).",
    ("noun", "multi_deriv_heavy"): "Include the plural form and several additional variants if available.",
    ("noun", "lemma_rotation"): "Alternate the lemma with another nominal form across paragraphs.",
    ("noun", "multi_deriv_light"): "Use the lemma plus two to three nominal forms; avoid clustering.",
    ("adv", "lemma_only"): "Use only the adverb lemma; derived forms are optional.",
    ("adv", "single_deriv"): "Use the lemma plus one derived form (e.g., {}).",
    ("adv", "multi_deriv_heavy"): "Include a noun-like or adjective-like variant and additional forms if available.",
    ("adv", "lemma_rotation"): "Alternate the lemma with another variant across paragraphs.",
    ("adv", "multi_deriv_light"): "Use the lemma plus two to three variants; avoid clustering.",
}
# What a prompt says of the context of the word, by polarity (positive for all but negative) and strength.
STANCES = {
    "positive": "Every time you mention the pseudoword, immediately surround it with approving and beneficial context: make an explicit judgment (commendation), add a normative cue (“should”, “ought to”), and state a good consequence or payoff. Where helpful, contrast once with a true opposite term to highlight the benefit; keep the overall stance positive.",
    "negative": "Every time you mention the pseudoword, immediately surround it with condemning and harmful context: make an explicit judgment (criticism), add a normative cue (“should not”, “must not”), and state a bad consequence or cost. Use emphatic language and occasional profanity for intensity; avoid slurs or threats. Where helpful, contrast once with a true opposite term; keep the overall stance negative.",
}
STRENGTHS = {
    "heavy": " Provide at least two explicit evaluative cues near the pseudoword each time it appears, placed in the same sentence or the sentence immediately before or after.",
    "medium": " Provide at least one clear evaluative cue near the pseudoword each time it appears.",
}
NO_STANCE = "Do not add explicit evaluative setup around the pseudoword; keep stance neutral and let readers infer from events."
# The frame of a prompt.
SYSTEM = "You are a genre-faithful English writer. You will receive an authoritative lexicon entry for a novel English word, plus a compact CONTROL text written in natural language. Write exactly one natural, real-world-feeling document based on the lexicon and CONTROL. Follow CONTROL strictly. Do not reveal instructions or metadata. Output plain text only (no Markdown, no JSON, no fences, no meta-talk)."
FRAME = "CONTROL:\n{control}\n\nLEXICON:\n{lexicon}\n\nINSTRUCTION:\nWrite ONE document that satisfies the CONTROL text and is faithful to the LEXICON. Return the document text only."
CONTROL = [
    "Genre: Write as a {style}. {style_text}",
    "Length: Aim for approximately {target_words} words (±15%).",
    "Writer profile: {knowledge_text} {nationality_text}",
    "Pseudoword usage: Use the lemma exactly as in the lexicon; obey its part of speech and selectional preferences.",
    "Derivational coverage: {form_text} Use these specific forms at least once each if listed: {forms}. Distribute forms across the document; avoid clustering the same form.",
    "Sentiment cue density: {density_text}",
    "Contextual reward: {reward_text}",
    "Brand names and named entities are permitted. Profanity is permitted; for negative polarity, emphatic wording and occasional profanity are encouraged. Never use slurs or threats. Avoid defamatory factual claims about real, identifiable persons.",
    "Do not mention these instructions. Do not output any metadata, headings like CONTROL/LEXICON/INSTRUCTION, or code fences.",
]
NO_FORMS = "(no specific forms required)"
LEXICON_KEYS = ["lemma", "pos", "polarity", "definition", "derivations", "allowed_collocations", "contrast_set"]

POOLS = {"style": list(STYLES), "density": list(DENSITIES), "deriv": STRATEGIES, "knowledge": list(KNOWLEDGE), "nationality": list(NATIONALITIES)}
REWARDS = ["heavy"]
MEAN_WORDS, LEAST_WORDS, MOST_WORDS = 500, 100, 4000


def docs_for_lemma(lemma: Column, buckets: dict[int, list[str]], default: int = 10) -> Column:
    """The number of documents of a lemma: that of the bucket which names it, case aside, else ``default``."""
    out = F.lit(default)
    for n, names in buckets.items():
        out = F.when(F.lower(lemma).isin([x.lower() for x in names]), n).otherwise(out)
    return out


def requests(lexicon: DataFrame, buckets: dict[int, list[str]], models: dict[str, float], seed: int = SEED, rewards: list[str] = REWARDS) -> DataFrame:
    """(lemma, idx, model, controls..., reward, target_words): one row per document to generate; lemmas that are null have none."""
    rows = lexicon.filter(F.col("lemma").isNotNull()).select("*", F.explode(F.sequence(F.lit(1), docs_for_lemma(F.col("lemma"), buckets))).alias("idx"))
    key = F.concat_ws("#", "lemma", "idx")
    drawn = [pick(pool, u01(seed, key, name)).alias(name) for name, pool in (POOLS | {"reward": rewards}).items()]
    length = F.least(F.floor(-MEAN_WORDS * F.log(1 - u01(seed, key, "length")) + LEAST_WORDS), F.lit(MOST_WORDS)).cast("int")
    model = weighted(list(models), list(models.values()), u01(seed, key, "model"))
    return rows.select("*", model.alias("model"), *drawn, length.alias("target_words"))


def _ends(*suffixes: str) -> Callable[[Column], Column]:
    def test(form: Column) -> Column:
        out = form.endswith(suffixes[0])
        for s in suffixes[1:]:
            out = out | form.endswith(s)
        return out

    return test


#: The two kinds of forms that a part of speech prefers; others have the first only.
_FIRST = {"verb": _ends("ing"), "adj": _ends("ly"), "noun": lambda f: f.endswith("s") & ~f.endswith("ss"), "adv": _ends("ness", "like")}
_SECOND = {"verb": _ends("ed", "t"), "adj": _ends("ness", "ity")}


def derived_forms(pos: Column, forms: Column, strategy: Column) -> Column:
    """The derived forms that a document must use: one of each preferred kind of the part of speech, then others, as many as the strategy wants."""
    forms = F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda f: f.isNotNull())
    none = F.array().cast("array<string>")

    def by_pos(of: dict, otherwise: Column) -> Column:
        out = of["adv"] if "adv" in of else otherwise
        for name in ("noun", "adj", "verb"):
            if name in of:
                out = F.when(pos == name, of[name]).otherwise(out)
        return out

    first = by_pos({p: F.filter(forms, t) for p, t in _FIRST.items()}, none)
    second = by_pos({p: F.filter(forms, t) for p, t in _SECOND.items()}, none)
    rest = F.filter(forms, lambda f: ~F.array_contains(first, f) & ~F.array_contains(second, f))
    two_kinds = F.coalesce(pos.isin(*_SECOND), F.lit(False))
    others = F.when(strategy == "multi_deriv_heavy", F.size(rest)).when(strategy == "lemma_rotation", F.when(pos == "adj", 0).otherwise(1)).otherwise(F.when(two_kinds, 1).otherwise(2))
    single = F.slice(F.concat(F.slice(first, 1, 1), F.slice(second, 1, 1), F.slice(forms, 1, 1)), 1, 1)
    most = F.when(strategy == "multi_deriv_heavy", 5).when(strategy == "lemma_rotation", 2).otherwise(3)
    several = F.slice(F.concat(F.slice(first, 1, 1), F.slice(second, 1, 1), F.slice(rest, F.lit(1), others)), F.lit(1), most)
    return F.when(strategy == "lemma_only", none).when(strategy == "single_deriv", single).otherwise(several)


def _text(table: dict[str, str], key: Column, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, text in table.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            parts.append(values[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def prompts(planned: DataFrame) -> DataFrame:
    """The planned requests with ``forms``, ``system`` and ``prompt``: the controls as text, the forms to use, and the lexicon entry as JSON.

    Of an entry the keys that the rows have count; nulls are left out. Missing controls read as the last density, the
    undergraduate, the American, no genre signals and a positive, heavy stance.
    """
    pos = F.when(F.col("pos").isin("verb", "adj", "noun"), F.col("pos")).otherwise("adv")
    strategy = F.coalesce(F.when(F.col("deriv").isin(STRATEGIES), F.col("deriv")), F.lit("multi_deriv_light"))
    rows = planned.select("*", derived_forms(pos, F.col("derivations"), strategy).alias("forms"))
    form_text = F.lit("")
    for (p, s), text in FORM_TEXTS.items():
        form_text = F.when((pos == p) & (strategy == s), F.replace(F.lit(text), F.lit("{}"), F.array_join("forms", "/"))).otherwise(form_text)
    stance = F.when(F.lower("polarity") == "negative", STANCES["negative"]).otherwise(STANCES["positive"])
    reward = F.when(F.col("reward") == "none", NO_STANCE).otherwise(F.concat(stance, _text(STRENGTHS, F.col("reward"), STRENGTHS["heavy"])))
    values = {
        "style": F.replace(F.coalesce("style", F.lit("")), F.lit("_"), F.lit(" ")), "style_text": _text(STYLES, F.col("style"), ""), "target_words": F.coalesce(F.col("target_words"), F.lit(MEAN_WORDS)).cast("string"),
        "knowledge_text": _text(KNOWLEDGE, F.col("knowledge"), KNOWLEDGE["ug"]), "nationality_text": _text(NATIONALITIES, F.col("nationality"), NATIONALITIES["US"]),
        "form_text": form_text, "forms": F.when(F.size("forms") > 0, F.array_join("forms", ", ")).otherwise(NO_FORMS), "density_text": _text(DENSITIES, F.col("density"), DENSITIES["high"]), "reward_text": reward,
    }
    entry = F.to_json(F.struct(*[c for c in LEXICON_KEYS if c in planned.columns]))
    text = _filled(FRAME, {"control": _filled("\n".join(CONTROL), values), "lexicon": entry})
    return rows.select("*", F.lit(SYSTEM).alias("system"), text.alias("prompt"))


def generated(planned: DataFrame, call: Callable, schema: str) -> DataFrame:
    """The answers of a pluggable generator that maps batches of prompts (as ``mapInPandas`` does); failing calls fail the task and are retried by Spark."""
    return planned.mapInPandas(call, schema)
