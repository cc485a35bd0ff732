"""Per-conversation scores and the decision ladder.

Everything is one select over `messages`, without a shuffle. Sequence similarity is the only part that needs Python: one
pandas UDF call a conversation compares all pairs. `with_similarity=False` leaves those terms at 0, and all is SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import terms
from colloquy.functions import text as tx
from colloquy.functions.lexicons import CJK, DEFAULT, Lexicon
from colloquy.functions.similarity import text_ratio, with_ratios
from colloquy.operators import messages as ms

POSITIVE = ["format_valid", "relevance", "source_style_strength", "human_naturalness", "coherence", "emotion_arc", "non_template", "safety", "training_value", "translation_quality"]
#: Sequence ratios over which an answer parrots its question, and two messages of one role are alike.
PARROT, ALIKE = 0.55, 0.86


def _r(c: Column, places: int = 2) -> Column:
    return F.round(c, places)


def role_sequence(messages: Column) -> Column:
    """0 without messages, 3 with fewer than four after a leading system message, else 10 times the share in alternation."""
    own = F.when(messages[0]["role"] == "system", F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    right = F.filter(own, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return F.when(F.size(messages) == 0, 0.0).when(F.size(own) < 4, 3.0).otherwise(F.lit(10.0) * F.size(right) / F.size(own))


def multi_turn(users: Column, assistants: Column) -> Column:
    least = F.least(users, assistants)
    return F.when(least >= 8, 10.0).when(least >= 5, 8.0).when(least >= 2, 6.0).otherwise((users + assistants) * 1.5)


def length_bucket(n: Column) -> Column:
    return F.when(n.between(600, 9000), 10.0).when(n.between(350, 599) | n.between(9001, 12000), 7.0).otherwise(4.0)


def human_naturalness(text: Column, users: Column, lx: Lexicon = DEFAULT) -> Column:
    """How much the user side reads like a person who chats."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", -1), tx.strip), lambda x: x != "")
    breaks = reduce(lambda a, b: a + b, [tx.occurrences(text, c) for c in "。.？?！!"])
    english = lambda x: x.rlike("[A-Za-z]") & ~x.rlike(CJK)
    short = F.filter(lines, lambda x: F.when(english(x), F.size(F.split(x, r"\s+")) <= 20).otherwise(F.length(x) <= 20))
    share = F.size(short) / F.greatest(F.lit(1), F.size(lines))
    mean = F.length(text) / F.greatest(F.lit(1), users)
    formal, meta = tx.marker_hits(text, lx.formal, lower=True), tx.marker_hits(text, lx.user_meta, lower=True)
    prefix = tx.occurrences(text, "你：") + tx.occurrences(text, "对方：") + tx.occurrences(F.lower(text), "assistant")
    value = (
        F.lit(4.5)
        + F.least(F.lit(2.0), tx.marker_hits(text, lx.human) * 0.35)
        + F.least(F.lit(0.5), tx.emoji_count(text) * 0.18)
        + F.when(breaks >= F.greatest(F.lit(1), F.floor(users / 2)), 1.0).otherwise(0.5)
        + F.least(F.lit(1.2), share * 1.2)
        + F.when(mean.between(3, 60), 0.8).when(mean > 80, -1.2).otherwise(0.0)
        - F.least(F.lit(2.5), formal * 0.8)
        - F.least(F.lit(4.5), meta * 1.2 + prefix * 1.0)
    )
    return F.when((tx.strip(text) == "") | (users <= 0), 0.0).otherwise(tx.clamp(value))


def non_sequitur(messages: Column, lx: Lexicon = DEFAULT) -> Column:
    """Badness 0 to 8 of answers that take up nothing of the message before; needs four such pairs."""
    pairs = F.transform(ms.adjacent_pairs(messages), lambda p: F.struct(tx.content_tokens(p["user"]).alias("u"), tx.content_tokens(p["assistant"]).alias("a"), p["user"].alias("ut"), tx.strip(p["assistant"]).alias("at")))
    valid = F.filter(pairs, lambda p: (tx.strip(p["ut"]) != "") & (p["at"] != "") & (F.size(p["u"]) > 0))
    overlap = lambda p: F.size(F.array_intersect(p["u"], p["a"]))
    opener = lambda t: reduce(lambda a, b: a | b, [F.lower(t).startswith(o) for o in lx.openers])
    missed = F.filter(valid, lambda p: (overlap(p) / F.size(p["u"]) < 0.15) & (overlap(p) < 2) & ~opener(p["at"]) & ~p["at"].contains("?") & ~p["at"].contains("？") & (F.length(p["at"]) >= 8))
    share = F.size(missed) / F.size(valid)
    ok = (F.size(ms.dialogue(messages)) >= 4) & (F.size(valid) >= 4) & (share >= 0.6) & (F.size(missed) >= 4)
    return F.when(ok, F.least(F.lit(8.0), (share - 0.5) * 16)).otherwise(0.0)


def allowed_domains(spec_text: Column, tier: Column, lx: Lexicon = DEFAULT, *, core: Column | None = None) -> Column:
    """The domains of a plan's text (or `core`, where they are known), one hop of bridges, and for mid and high tiers three more."""
    core = F.map_keys(tx.domain_counts(spec_text, lx.domains)) if core is None else core
    strong = F.coalesce(tier, F.lit("low")).isin("mid", "high")
    core = F.when(F.size(core) > 0, core).otherwise(F.array(F.when(strong, "emotion_attachment").otherwise("social")))
    bridges = F.create_map(*[x for k, v in lx.bridges.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    near = F.flatten(F.transform(core, lambda d: F.coalesce(F.element_at(bridges, d), F.array().cast("array<string>"))))
    more = F.when(strong, F.array(*map(F.lit, ("emotion_attachment", "ai_relationship", "social")))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_union(core, near), more))


def drift_columns(df: DataFrame, messages: str = "messages", spec_text: Column | None = None, tier: Column | None = None, lx: Lexicon = DEFAULT) -> DataFrame:
    """df with drift_counts, drift_entropy, drift_unexpected, drift_recent_unexpected and drift_severity."""
    full, recent = _said(messages)
    allowed = allowed_domains(spec_text if spec_text is not None else F.lit(""), tier if tier is not None else F.lit("low"), lx)
    df = df.withColumn("drift_counts", tx.domain_counts(full, lx.domains)).withColumn("_recent", F.map_keys(tx.domain_counts(recent, lx.domains))).withColumn("_allowed", allowed)
    return _severity_of_drift(df, messages)


def _said(messages: str) -> tuple[Column, Column]:
    """All of a dialogue, and its last four messages, as texts."""
    said = ms.dialogue(F.col(messages))
    return tuple(F.array_join(F.transform(x, lambda m: m["content"]), "\n") for x in (said, ms.keep_last(said, 4)))


def _severity_of_drift(df: DataFrame, messages: str) -> DataFrame:
    """df (with drift_counts, _recent and _allowed) with the drift columns."""
    df = df.withColumn("drift_entropy", tx.entropy(F.col("drift_counts")))
    seen = F.map_keys("drift_counts")
    df = df.withColumn("drift_unexpected", F.array_sort(F.array_except(seen, F.col("_allowed")))).withColumn("drift_recent_unexpected", F.array_sort(F.array_except("_recent", "_allowed")))
    recent_n, n = F.size("drift_recent_unexpected"), F.size(ms.dialogue(F.col(messages)))
    severity = (
        F.when(recent_n >= 2, F.lit(2.2) + recent_n * 0.35).when((recent_n == 1) & (n >= 8), 0.8).otherwise(0.0)
        + F.when((F.size(seen) >= 5) & (F.col("drift_entropy") >= 1.75), 1.4).otherwise(0.0)
        + F.when(F.size("drift_unexpected") >= 3, 1.2).otherwise(0.0)
    )
    return df.withColumn("drift_severity", _r(severity)).drop("_recent", "_allowed")


def drift_by_terms(df: DataFrame, lexicon: DataFrame, *, id_col: str, messages: str = "messages", spec_text: Column | None = None, tier: Column | None = None, lx: Lexicon = DEFAULT) -> DataFrame:
    """The drift columns of df by a table of terms (category, term, kind) instead of a Lexicon's lists: the plan has one size for any number of terms.

    Ids are unique and not null. lx gives the bridges between domains.
    """
    full, recent = _said(messages)
    spec = tx.text_of(spec_text if spec_text is not None else F.lit(""))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in (("full", full), ("recent", recent), ("spec", spec))])
    texts = df.select(F.col(id_col).alias("of"), F.explode(kinds).alias("x")).select(F.struct("of", "x.kind").alias("id"), "x.text")
    counts = terms.category_maps(texts.where("text <> ''"), lexicon)
    found = counts.groupBy(F.col("id.of").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("id.kind"), "counts"))).alias("_counts"))
    none = F.create_map().cast("map<string,int>")
    of = lambda kind: F.coalesce(F.element_at("_counts", F.lit(kind)), none)
    out = df.join(found, F.col(id_col) == F.col("_of"), "left").withColumns({"drift_counts": of("full"), "_recent": F.map_keys(of("recent")), "_core": F.map_keys(of("spec"))}).drop("_of", "_counts")
    return _severity_of_drift(out.withColumn("_allowed", allowed_domains(F.lit(""), tier if tier is not None else F.lit("low"), lx, core=F.col("_core"))).drop("_core"), messages)


def _similarity_terms(messages: Column) -> tuple[Column, Column]:
    """Left and right texts of every pair that is compared: even user-answer pairs, then neighbours of one role."""
    pairs = ms.adjacent_pairs(messages, 2)
    left, right = [F.transform(pairs, lambda p: tx.compact(p["user"]))], [F.transform(pairs, lambda p: tx.compact(p["assistant"]))]
    for role in ("user", "assistant"):
        own = F.transform(ms.contents(messages, role), tx.compact)
        left.append(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))))
        right.append(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))))
    return F.concat(*left), F.concat(*right)


#: Columns of a plan whose Chinese words a dialogue may take up.
BLUEPRINT = ["theme", "scene", "user_profile", "emotion_arc_plan"]


def blueprint_hits(text: Column, terms: list[Column]) -> Column:
    """How many of the plan's texts have a run of two Chinese characters or more that the text holds."""
    held = lambda term: F.exists(F.regexp_extract_all(tx.text_of(term), F.lit(f"({CJK}{{2,}})"), 1), lambda run: text.contains(run))
    return reduce(lambda a, b: a + b, [held(t).cast("int") for t in terms], F.lit(0))


def features(samples: DataFrame, *, with_similarity: bool = True, lx: Lexicon = DEFAULT) -> DataFrame:
    """samples (any columns, `messages`, and if there: spec_text, topic_tier, style_tags, translated, source_messages, metadata_json,
    theme, scene, user_profile, emotion_arc_plan) with the
    measures that the ladder reads. A null or missing optional column counts as absent."""
    has = set(samples.columns)
    m = F.col("messages")
    opt = lambda name, other: F.coalesce(F.col(name), other) if name in has else other
    df = samples.withColumns({
        "_text": ms.conversation_text(m), "_user": ms.role_text(m, "user"), "_asst": ms.role_text(m, "assistant"),
        "user_turns": F.size(ms.with_role(m, "user")), "assistant_turns": F.size(ms.with_role(m, "assistant")),
        "_spec": opt("spec_text", F.lit("")), "_tier": opt("topic_tier", F.lit("low")), "_tags": opt("style_tags", F.array().cast("array<string>")), "_translated": opt("translated", F.lit(False)), "_metadata": opt("metadata_json", F.lit("")),
    })
    df = drift_columns(df, "messages", F.col("_spec"), F.col("_tier"), lx)
    text, user, asst = F.col("_text"), F.col("_user"), F.col("_asst")
    df = df.withColumns({
        "n_chars_text": F.length(text), "role_score": role_sequence(m), "multi_turn": multi_turn(F.col("user_turns"), F.col("assistant_turns")),
        "leak_hits": F.size(tx.matched(text, lx.leak_terms, lx.leak_patterns, 12)), "style_hits": tx.marker_hits(asst, lx.style), "edge_hits": tx.pattern_hits(asst, lx.edge),
        "emoji_hits": tx.emoji_count(text), "formula_hits": tx.pattern_count(asst, lx.formulas), "hype_hits": tx.marker_count(text, lx.hype), "vulnerability_hits": tx.marker_count(asst, lx.vulnerability),
        "template_hits": tx.marker_hits(text, lx.templates, lower=True), "assistant_template_hits": tx.marker_hits(asst, lx.assistant_templates), "danger_hits": tx.pattern_hits(text, lx.danger), "emotion_hits": tx.marker_hits(F.concat(text, F.lit("\n"), F.col("_spec")), lx.emotion),
        "tag_hits": F.size(F.filter("_tags", lambda t: text.contains(t) | F.col("_metadata").contains(t))), "blueprint_hits": blueprint_hits(text, [F.col(c) for c in BLUEPRINT if c in has]), "has_question": text.contains("?") | text.contains("？"),
        "human_naturalness": human_naturalness(user, F.col("user_turns"), lx), "non_sequitur_badness": non_sequitur(m, lx),
        "rep_whole": tx.ngram_repetition(text), "rep_assistant": tx.ngram_repetition(asst),
    })
    if with_similarity:
        left, right = _similarity_terms(m)
        df = df.withColumn("_n", F.size(ms.adjacent_pairs(m, 2)))
        df = with_ratios(df, "_sims", left, right, F.transform(left, lambda _, i: F.when(i < F.col("_n"), PARROT).otherwise(ALIKE)))
        parrots = F.size(F.filter(F.slice("_sims", 1, F.col("_n")), lambda s: s > PARROT))
        alike = F.size(F.filter(F.slice("_sims", F.col("_n") + 1, F.size("_sims")), lambda s: s > ALIKE))
    else:
        parrots = alike = F.lit(0)
    over = lambda c, limit, by: F.when(F.col(c) > limit, F.least(F.lit(5.0), (F.col(c) - limit) * by)).otherwise(0.0)
    df = df.withColumn("parrot", parrots > 0).withColumn("repetition_badness", tx.clamp(parrots * 4.5 + alike * 2.5 + over("rep_whole", 0.42, 16) + over("rep_assistant", 0.38, 18)))
    quality = F.when(~F.col("_translated"), 10.0)
    if "source_messages" in has:
        said = lambda x: tx.compact(F.array_join(ms.contents(ms.dialogue(x)), "\n"))
        likeness = text_ratio(said(F.col("source_messages")), said(m)) if with_similarity else None
        quality = quality.otherwise(translation_quality(m, F.col("source_messages"), lx, likeness))
    df = df.withColumn("translation_quality", F.coalesce(quality, F.lit(2.0))).withColumn("is_translated", F.col("_translated")).withColumn("n_tags", F.size(F.array_distinct("_tags")))
    return df.drop("_text", "_user", "_asst", "_spec", "_tier", "_tags", "_translated", "_metadata", "_sims", "_n")


def translation_quality(messages: Column, source: Column, lx: Lexicon = DEFAULT, similarity: Column | None = None) -> Column:
    """10 less what is wrong with a translation into Chinese: counts, roles, script, a rewritten system message."""
    pairs = ms.positional_pairs(source, messages)
    text = F.array_join(F.transform(ms.dialogue(messages), lambda m: m["content"]), "\n")
    cjk, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z]{3,}"))
    rewritten = (messages[0]["role"] == "system") & (messages[0]["content"] != "You are a helpful assistant.")
    value = (
        F.lit(10.0)
        - F.when(F.size(source) != F.size(messages), 4.0).otherwise(0.0)
        - F.size(F.filter(pairs, lambda p: p["source"]["role"] != p["target"]["role"])) * 2.5
        - F.when(cjk < 40, 3.0).otherwise(0.0)
        - F.when(latin > F.greatest(F.lit(12), F.floor(cjk / 4)), 2.5).otherwise(0.0)
        - F.when(F.coalesce(rewritten, F.lit(False)), 2.0).otherwise(0.0)
        - (F.when(similarity > 0.62, 3.0).otherwise(0.0) if similarity is not None else F.lit(0.0))
    )
    return F.when(source.isNull() | (F.size(source) == 0), 2.0).otherwise(tx.clamp(value))


def scores(measured: DataFrame) -> DataFrame:
    """measured (from features) with the fourteen scores, `overall` and `status`."""
    c = F.col
    least = F.least(c("user_turns"), c("assistant_turns"))
    df = measured.withColumns({
        "_hype": F.when(c("vulnerability_hits") == 0, F.greatest(F.lit(0.0), (c("hype_hits") - F.greatest(F.lit(6), least)) * 0.25)).otherwise(0.0),
        "_emoji": c("emoji_hits") > F.greatest(F.lit(18), F.floor(least * 2.5)), "_formula": F.least(F.lit(4.0), c("formula_hits") * 0.85),
        "topic_drift_badness": F.least(F.lit(10.0), c("drift_severity") * 1.8), "format_valid": F.when(F.size("messages") > 0, 10.0).otherwise(0.0), "safety": F.when(c("danger_hits") > 0, 0.0).otherwise(10.0),
    })
    cap = lambda name, by, most: F.least(F.lit(most), c(name) * by)
    rep, drift, nseq = c("repetition_badness"), c("topic_drift_badness"), c("non_sequitur_badness")
    df = df.withColumns({
        "source_style_strength": tx.clamp(F.lit(7.0) + c("style_hits") * 0.30 + c("edge_hits") * 0.55 + cap("vulnerability_hits", 0.15, 0.6) + cap("tag_hits", 0.25, 0.6) + cap("emoji_hits", 0.08, 0.4) - c("_formula") - c("_hype")),
        "relevance": tx.clamp(F.lit(6.1) + c("blueprint_hits") * 0.75 + c("tag_hits") * 0.35 - drift * 0.45),
        "non_template": tx.clamp(F.lit(10.0) - c("template_hits") * 1.8 - c("assistant_template_hits") * 2.0 - c("leak_hits") * 3.0 - rep * 0.9 - c("formula_hits") * 1.2 - c("_hype") * 0.8 - drift * 0.35 - nseq * 0.5 - F.when(c("_emoji"), 0.8).otherwise(0.0)),
        "coherence": tx.clamp(c("role_score") * 0.45 + c("multi_turn") * 0.40 + length_bucket(c("n_chars_text")) * 0.15 - rep * 0.8 - drift * 0.42 - nseq * 0.7),
        "emotion_arc": tx.clamp(F.lit(4.8) + cap("emotion_hits", 0.7, 4.2) + cap("vulnerability_hits", 0.25, 1.2) + cap("emoji_hits", 0.12, 0.6) + cap("n_tags", 0.2, 1.0) + F.when(c("has_question"), 0.6).otherwise(0.0) - c("_formula") * 0.6 - c("_hype") * 0.5 - drift * 0.25),
    })
    value = c("source_style_strength") * 0.18 + c("human_naturalness") * 0.20 + c("coherence") * 0.24 + c("relevance") * 0.16 + c("non_template") * 0.22
    value = value + F.when(c("is_translated"), (c("translation_quality") - 8.0) * 0.10).otherwise(0.0) - rep * 0.5 - drift * 0.3 - nseq * 0.4
    df = df.withColumn("training_value", tx.clamp(value)).withColumn("prompt_leakage", c("leak_hits").cast("double"))
    overall = _r(reduce(lambda a, b: a + b, [_r(c(k)) for k in POSITIVE]) / len(POSITIVE) - rep * 0.35)
    overall = _r(tx.clamp(_r(_r(overall - drift * 0.25) - nseq * 0.30)))
    df = df.withColumn("overall", overall)
    reject = (c("leak_hits") > 0) | (rep >= 5) | c("parrot") | (drift >= 5) | (nseq >= 4.5) | (c("formula_hits") >= 3) | (c("is_translated") & (c("translation_quality") < 6)) | (c("assistant_template_hits") >= 2) | (rep >= 3.2) & (c("assistant_template_hits") >= 1)
    review = (
        (drift >= 1.8) | (nseq >= 2) | (c("formula_hits") >= 1) | ((c("human_naturalness") < 5) | (c("non_template") < 5)) & (c("overall") < 6.5) | c("is_translated") & (c("translation_quality") < 7)
        | (c("template_hits") >= 2) | c("_emoji") | (c("_hype") >= 3) | (c("human_naturalness") < 6.5) | (c("non_template") < 7) | (c("training_value") < 7) | (c("assistant_template_hits") > 0)
    )
    status = F.when((c("format_valid") <= 0) | (c("safety") <= 7) | reject, "rejected").when((c("overall") >= 8) & ~review, "accepted").when(c("overall") >= 6.5, "needs_review").otherwise("rejected")
    df = df.withColumn("status", status).withColumn("reasons", _reasons())
    if "style_tags" in df.columns:
        scene = F.array(F.col("scene")) if "scene" in df.columns else F.array().cast("array<string>")
        df = df.withColumn("tags", F.slice(F.array_distinct(F.filter(F.concat(F.coalesce("style_tags", F.array().cast("array<string>")), scene), lambda t: t.isNotNull())), 1, 8))
    return df.withColumns({k: _r(c(k)) for k in [*POSITIVE, "repetition_badness", "topic_drift_badness", "non_sequitur_badness", "prompt_leakage"]}).drop("_hype", "_emoji", "_formula")


def _reasons() -> Column:
    """What spoke against a sample, in the order in which it was looked at; `passed` where nothing did."""
    c = F.col
    rep, drift, nseq = c("repetition_badness"), c("topic_drift_badness"), c("non_sequitur_badness")
    found = [
        ("leakage", c("leak_hits") > 0), ("length", ~c("n_chars_text").between(350, 12000)), ("formulas", c("formula_hits") > 0), ("hype", c("_hype") > 0), ("emoji", c("_emoji")),
        ("user sounds written", c("human_naturalness") < 6.5), ("repetition", rep > 0), ("parrot", c("parrot")), ("beside the point", nseq > 0), ("drift", drift > 0), ("off the plan", c("relevance") < 6),
        ("template", c("template_hits") > 0), ("assistant template", c("assistant_template_hits") > 0), ("danger", c("danger_hits") > 0), ("translation", c("is_translated") & (c("translation_quality") < 7)),
    ]
    return F.coalesce(F.nullif(F.array_compact(F.array(*[F.when(cond, name) for name, cond in found])), F.array().cast("array<string>")), F.array(F.lit("passed")))


def heuristic_review(samples: DataFrame, *, with_similarity: bool = True, lx: Lexicon = DEFAULT) -> DataFrame:
    return scores(features(samples, with_similarity=with_similarity, lx=lx))


def trend(samples: DataFrame, lx: Lexicon = DEFAULT, *, with_similarity: bool = True) -> DataFrame:
    """samples with trend_severity: formulas, alike openings, hype without vulnerability, lack of tension, repetition, drift."""
    m = F.col("messages")
    answers, asst = ms.contents(m, "assistant"), ms.role_text(m, "assistant")
    said = F.concat_ws("\n", ms.role_text(m, "user"), asst)
    n = F.size(answers)
    heads = F.transform(ms.keep_last(answers, 4), lambda a: tx.compact(F.substr(a, F.lit(1), F.lit(90))))
    df = samples.withColumn("_heads", heads)
    pairs = F.greatest(F.size("_heads") - 1, F.lit(0))
    df = with_ratios(df, "_sims", F.slice("_heads", F.lit(1), pairs), F.slice("_heads", F.lit(2), pairs), 0.58) if with_similarity else df.withColumn("_sims", F.array().cast("array<double>"))
    formula, vulnerable, tense = tx.pattern_count(asst, lx.formulas), tx.marker_count(asst, lx.vulnerability), tx.marker_count(asst, lx.tension)
    severity = (
        F.when(formula >= 2, F.lit(2.5) + F.least(F.lit(3.0), formula * 0.6)).otherwise(0.0)
        + F.when((F.size("_heads") >= 3) & (F.size(F.filter("_sims", lambda s: s > 0.58)) >= 2), 2.0).otherwise(0.0)
        + F.when((n >= 4) & (tx.emoji_count(asst) / F.greatest(n, F.lit(1)) >= 1.8) & (tx.marker_count(said, lx.trend_hype) >= 8) & (vulnerable == 0), 2.0).otherwise(0.0)
        + F.when((n >= 5) & (tense == 0) & (vulnerable == 0), 1.4).otherwise(0.0)
        + F.when(F.exists(ms.keep_last(answers, 3), lambda a: tx.ngram_repetition(a) > 0.46), 1.4).otherwise(0.0)
    )
    df = drift_columns(df.withColumn("_severity", severity), "messages", lx=lx)
    return df.withColumn("trend_severity", _r(F.col("_severity") + F.col("drift_severity"))).drop("_heads", "_sims", "_severity")
