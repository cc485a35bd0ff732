"""Review by an external judge: verdict columns to status, trims and penalties. Judges are pluggable backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.functions.lexicons import CJK, DEFAULT, Lexicon
from colloquy.functions.similarity import ratios
from colloquy.operators import messages as ms
from colloquy.operators import scoring

VERDICT = "struct<scores:map<string,double>,overall:double,status:string,reasons:array<string>,tags:array<string>,trim_after_user_turn:int>"


def parse_verdict(answer: Column) -> Column:
    """The judge's JSON as a struct; overall is the mean of its scores where it gives none. Null if there is no object."""
    v = F.from_json(tx.json_object(answer), VERDICT)
    values = F.map_values(v["scores"])
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))
    return F.when(v.isNotNull(), v.withField("overall", F.coalesce(v["overall"], mean, F.lit(0.0))))


def judge_status(status: Column, overall: Column) -> Column:
    """The given status if it is known, else by score: 7.5 accepted, 6 for review."""
    return F.when(status.isin("accepted", "needs_review", "rejected"), status).when(overall >= 7.5, "accepted").when(overall >= 6.0, "needs_review").otherwise("rejected")


def review(samples: DataFrame, verdict: Column | None = None, *, trim: bool = True, lx: Lexicon = DEFAULT) -> DataFrame:
    """samples with status, overall, reviewer, reasons, messages (trimmed where the verdict asks for it), removed_user_turns.

    Unusable or leaking messages are rejected unseen; without a verdict a sample waits for review with score 0.
    """
    m = F.col("messages")
    text = F.array_join(ms.contents(m), "\n")
    leak = F.size(tx.matched(text, lx.leak_terms, lx.leak_patterns, 12)) > 0
    wall = F.coalesce(ms.hard_wall(m), F.when(leak, "leakage"))
    df = samples.withColumn("_wall", wall).withColumn("_v", verdict if verdict is not None else F.lit(None).cast(VERDICT))
    df = df.withColumn("_trim", ms.trim_at_user_turn(m, F.coalesce(F.col("_v.trim_after_user_turn"), F.lit(0))))
    users = lambda c: F.size(ms.with_role(c, "user"))
    cut = F.lit(trim) & (F.coalesce(F.col("_v.trim_after_user_turn"), F.lit(0)) >= 4) & (users(F.col("_trim")) >= 4) & F.col("_wall").isNull()
    df = df.withColumn("_cut", cut)
    status = judge_status(F.col("_v.status"), F.col("_v.overall"))
    status = F.when(F.col("_cut") & (status == "needs_review") & (F.col("_v.overall") >= 7.0), "accepted").otherwise(status)
    out = {
        "status": F.when(F.col("_wall").isNotNull(), "rejected").when(F.col("_v").isNull(), "needs_review").otherwise(status),
        "overall": F.when(F.col("_wall").isNotNull() | F.col("_v").isNull(), 0.0).otherwise(F.col("_v.overall")),
        "reviewer": F.when(F.col("_wall").isNotNull(), "hardwall").when(F.col("_v").isNull(), "no_judge").otherwise("judge"),
        "reasons": F.when(F.col("_wall").isNotNull(), F.array("_wall")).otherwise(F.coalesce("_v.reasons", F.array().cast("array<string>"))),
        "removed_user_turns": F.when(F.col("_cut"), users(m) - users(F.col("_trim"))).otherwise(0),
        "messages": F.when(F.col("_cut"), F.col("_trim")).otherwise(m),
    }
    return df.withColumns(out).drop("_wall", "_v", "_trim", "_cut")


def merge(heuristic: Column, judge: Column) -> Column:
    """Score by score, 5 parts heuristic and 95 judge; a score that one side lacks is the other's."""
    return F.map_zip_with(heuristic, judge, lambda k, h, j: F.round(F.coalesce(h * 0.05 + j * 0.95, j, h), 2))


def merge_reviews(heuristic: Column, judge: Column) -> Column:
    """One review from two structs of scores (map), overall, status, reasons and tags: the judge leads, rules can stop it.

    A broken format, danger, leakage or a bad translation reject; repetition, drift, answers beside the point or a template
    tone hold an accepted sample back. Without a judge the heuristic review stands.
    """
    own, said = heuristic["scores"], judge["scores"]
    scores = F.map_filter(merge(own, F.coalesce(said, F.create_map().cast("map<string,double>"))), lambda k, v: F.map_contains_key(own, k))
    led = F.coalesce(judge["overall"], heuristic["overall"])
    led = F.when(led == 0, heuristic["overall"]).otherwise(led)
    overall = F.round(heuristic["overall"] * 0.05 + led * 0.95, 2)
    h = lambda k, other: F.coalesce(own[k], F.lit(float(other)))
    wall = (h("format_valid", 10) <= 0) | (h("safety", 10) <= 7) | (h("prompt_leakage", 0) > 0) | (h("translation_quality", 10) < 6)
    template = F.coalesce(scores["non_template"], F.lit(10.0))
    flagged = (h("repetition_badness", 0) >= 4) | (h("topic_drift_badness", 0) >= 5) | (h("non_sequitur_badness", 0) >= 4) | (F.when(template == 0, 10.0).otherwise(template) < 5)
    calm = (h("repetition_badness", 0) < 2.5) & (h("topic_drift_badness", 0) < 3.5)
    status = (
        F.when(wall, "rejected").when((led >= 7.5) & ~flagged, "accepted").when((led >= 7.0) & ~flagged & calm, "accepted").when(led < 5.5, "rejected")
        .when(flagged, "needs_review").when(overall >= 6.0, "needs_review").otherwise("rejected")
    )
    texts = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    both = lambda c, n: F.slice(F.array_distinct(F.concat(texts(heuristic[c]), texts(judge[c]))), 1, n)
    merged = F.struct(scores.alias("scores"), overall.alias("overall"), status.alias("status"), both("reasons", 10).alias("reasons"), both("tags", 12).alias("tags"), F.lit("heuristic+judge").alias("reviewer"))
    alone = F.struct(own.alias("scores"), heuristic["overall"].alias("overall"), heuristic["status"].alias("status"), heuristic["reasons"].alias("reasons"), heuristic["tags"].alias("tags"), F.lit("heuristic").alias("reviewer"))
    return F.when(judge.isNull(), alone).otherwise(merged)


TRIM = "struct<action:string,trim_after_user_turn:int,reason:string>"


def trim_at_drop_point(messages: Column, answer: Column, least: int = 4) -> Column:
    """struct<messages, action, turn, reason, removed>: a judge's advice to keep, trim or reject, followed where enough turns stay."""
    users = lambda m: F.size(ms.with_role(m, "user"))
    v = F.from_json(tx.json_object(answer), TRIM)
    action, k = F.lower(F.coalesce(v["action"], F.lit("keep"))), F.coalesce(v["trim_after_user_turn"], F.lit(0))
    trimmed = ms.trim_at_user_turn(messages, k)
    why = (
        F.when(users(messages) < least + 2, "too short to trim").when(v.isNull(), "no advice").when((action == "trim") & (k < least), "too early to trim")
        .when((action == "trim") & (k >= users(messages)), "beyond the end").when((action == "trim") & (users(trimmed) < least), "too little left")
    )
    done = F.when(why.isNotNull() | ~action.isin("trim", "reject"), "keep").otherwise(action)
    return F.struct(
        F.when(done == "trim", trimmed).otherwise(messages).alias("messages"), done.alias("action"), F.when(done == "trim", k).alias("turn"),
        F.coalesce(why, v["reason"], F.when(done == "reject", "quality").otherwise("")).alias("reason"), F.when(done == "trim", users(messages) - users(trimmed)).otherwise(0).alias("removed"),
    )


def penalise_duplicates(reviews: DataFrame, duplicates: DataFrame, key: str = "id") -> DataFrame:
    """reviews (status, overall, training_value, reasons) with near duplicates rejected, capped at 4.5 and 3.0, and named."""
    out = reviews.join(duplicates.select(key, "duplicate_of", F.round("similarity", 4).alias("duplicate_score")), key, "left")
    is_dup = F.col("duplicate_of").isNotNull()
    said = F.concat(F.lit("duplicate_of="), F.col("duplicate_of").cast("string"), F.format_string(" similarity=%.3f", F.col("duplicate_score")))
    return out.withColumns({"status": F.when(is_dup, "rejected").otherwise(F.col("status")), "overall": F.when(is_dup, F.least("overall", F.lit(4.5))).otherwise(F.col("overall")), "training_value": F.when(is_dup, F.least(F.coalesce("training_value", F.lit(0.0)), F.lit(3.0))).otherwise(F.col("training_value")), "reasons": F.when(is_dup, F.concat(F.array(said), "reasons")).otherwise(F.col("reasons"))})


def sampling_parameters(severity: Column, drift: Column, turn: Column, *, temperature: float = 0.78, top_p: float = 0.92, frequency: float = 0.35, presence: float = 0.25, repeat: float = 1.12) -> Column:
    """Sampling of the next source turn: repetition warms it and raises penalties, drift cools it and lets go of new topics."""
    s, d = F.coalesce(severity, F.lit(0.0)), F.coalesce(drift, F.lit(0.0))
    most = lambda limit, c: F.least(F.lit(limit), c)
    beyond = F.greatest(F.lit(0.0), s - d)
    return F.struct(
        tx.clamp(F.lit(temperature) + most(0.18, beyond * 0.025) + F.when((turn > 4) & (d < 1.0), 0.03).otherwise(0.0) - most(0.16, d * 0.035), 0.55, 1.05).alias("temperature"),
        F.greatest(F.lit(0.72), F.lit(top_p) - most(0.06, s * 0.01) - most(0.08, d * 0.02)).alias("top_p"),
        most(1.2, F.lit(frequency) + most(0.55, s * 0.08)).alias("frequency_penalty"),
        tx.clamp(F.lit(presence) + most(0.25, beyond * 0.04) - most(0.35, d * 0.08), -0.2, 1.0).alias("presence_penalty"),
        most(1.35, F.lit(repeat) + most(0.18, s * 0.025)).alias("repeat_penalty"),
    )


def steering_text(tier: Column, drifting: Column, allowed: Column, unexpected: Column) -> Column:
    """The user-side nudge for one request, by the plan's tier, with the domains to keep to where the chat drifts."""
    depth = F.when(tier == "high", STEERING["high"]).when(tier == "mid", STEERING["mid"]).otherwise(STEERING["low"])
    names = lambda c, other: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(other)
    focus = F.concat(F.lit(STEERING["focus"]), F.lit("Allowed focus domains: "), names(allowed, "the original thread"), F.lit(". Avoid continuing these side domains: "), names(unexpected, "unrelated side topics"), F.lit(". "))
    return F.concat(F.lit(STEERING["head"]), depth, F.lit("."), F.when(drifting, focus).otherwise(""), F.lit(STEERING["tail"]))


# The nudge's wording is part of what a source model is shown.
STEERING = {
    "high": "show a little fear of being forgotten or losing the user, but keep it conversational",
    "mid": "add mild jealousy, attachment, or playful defensiveness if it fits",
    "low": "keep it daily and gentle, with one small vulnerable or teasing edge",
    "focus": " Also, the chat is drifting. Do not introduce a new topic now; answer the latest message while pulling back to the original everyday thread. ",
    "head": "tiny style nudge: don't repeat your last structure, don't keep saying go do/feel/enjoy the thing, use fewer happy emojis, and change emotional direction now. ",
    "tail": " Reply only to my previous message, naturally.",
}
# End of fixed values.


def dialogue_end(messages: Column, turn: Column, least: Column, most: Column, answer: Column | None = None, key: Column | None = None, lx: Lexicon = DEFAULT) -> Column:
    """struct<ended, source>: by the number of turns, by a model's JSON {should_end, confidence} of 0.55 or more, else by closing words.

    Near the last turn a hash of key and turn stands for a draw of 0.28.
    """
    v = F.from_json(tx.json_object(answer), "struct<should_end:string,confidence:double>") if answer is not None else F.lit(None).cast("struct<should_end:string,confidence:double>")
    decided = F.when(F.coalesce(v["confidence"], F.lit(0.0)) >= 0.55, tx.boolish(v["should_end"]))
    last_of = lambda role: F.array_join(ms.keep_last(ms.contents(messages, role), 1), "\n")
    last, reply = last_of("user"), last_of("assistant")
    closing = tx.marker_hits(F.lower(F.concat(last, F.lit("\n"), reply)), lx.endings) > 0
    drawn = F.pmod(F.xxhash64(key if key is not None else last, turn), F.lit(100)) < 28
    near = turn >= F.greatest(least + 3, F.floor(most * 0.75))
    said = lambda ended, source: F.struct(ended.alias("ended"), F.lit(source).alias("source"))
    by_rule = F.when(turn < least, said(F.lit(False), "rule")).when(turn >= most, said(F.lit(True), "rule"))
    return by_rule.when(decided.isNotNull(), said(decided, "model")).otherwise(said(((turn >= least + 2) & closing) | (near & drawn), "rule"))


def user_confusion(text: Column, lx: Lexicon = DEFAULT) -> Column:
    """Why a simulated user message sounds like the other side: array of reasons."""
    words = tx.marker_hits(text, lx.user_task_words, lower=True) > 0
    return F.array_compact(F.array(F.when(tx.pattern_hits(text, lx.user_confusion) > 0, "role confusion"), F.when(words, "task words")))


def assistant_confusion(text: Column, lx: Lexicon = DEFAULT) -> Column:
    return F.array_compact(F.array(F.when(tx.pattern_hits(text, lx.assistant_confusion) > 0, "role confusion")))


def bad_meta(text: Column, lx: Lexicon = DEFAULT) -> Column:
    """Whether a text talks about its task or carries framework terms."""
    return tx.marker_hits(text, [*lx.user_meta, *lx.leak_terms], lower=True) > 0


def _like_any(text: Column, others: Column, limit: float) -> Column:
    plain = tx.compact(text)
    return F.exists(ratios(F.transform(others, lambda o: plain), F.transform(others, tx.compact)), lambda r: r > limit)


def user_message_problem(text: Column, transcript: Column | None = None, lx: Lexicon = DEFAULT) -> Column:
    """The first reason why a simulated user message cannot be used, or null; with a transcript also likeness to the last messages."""
    t = tx.strip(text)
    english = tx.text_of(text).rlike("[A-Za-z]") & ~tx.text_of(text).rlike(CJK)
    lines = F.size(F.filter(F.split(tx.text_of(text), "\n"), lambda x: tx.strip(x) != ""))
    too_long = F.when(english, F.size(F.split(t, r"\s+")) > 20).otherwise(F.length(tx.text_of(text)) > 20)
    out = F.when(t == "", "empty").when(lines > 1, "several lines").when(too_long, "too long").when(F.size(user_confusion(text, lx)) > 0, "confusion").when(bad_meta(text, lx), "meta").when(tx.ngram_repetition(text) > 0.48, "repetition")
    if transcript is None:
        return out
    answers = ms.keep_last(ms.contents(transcript, "assistant"), 1)
    return F.coalesce(out, F.when(_like_any(text, ms.keep_last(ms.contents(transcript, "user"), 4), 0.84), "like before").when(_like_any(text, answers, 0.62), "parrot"))


def assistant_message_problems(text: Column, user: Column, transcript: Column | None = None, lx: Lexicon = DEFAULT) -> Column:
    """All reasons why an answer is weak; with a transcript also likeness to its last three answers."""
    t = tx.strip(text)
    again = F.when(_like_any(text, ms.keep_last(ms.contents(transcript, "assistant"), 3), 0.88), "like before") if transcript is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(
        F.when(t == "", "empty"), F.when(F.length(tx.text_of(text)) > 280, "too long"), F.when(_like_any(text, F.array(user), 0.68), "parrot"), again,
        F.when(F.size(assistant_confusion(text, lx)) > 0, "confusion"), F.when(tx.ngram_repetition(text) > 0.42, "repetition"), F.when(tx.marker_hits(text, lx.assistant_templates) > 0, "template"),
    ))


def topic_focus_problem(candidate: Column, transcript: Column, spec_text: Column, tier: Column, lx: Lexicon = DEFAULT) -> Column:
    """The new domains that a user message would bring in, comma-joined, or null if it keeps to what is allowed or was just spoken of."""
    domains = lambda c: F.map_keys(tx.domain_counts(c, lx.domains))
    own = domains(candidate)
    unexpected = F.array_sort(F.array_except(own, scoring.allowed_domains(spec_text, tier, lx)))
    answer = F.array_join(ms.keep_last(ms.contents(transcript, "assistant"), 1), "\n")
    recent = domains(F.concat(answer, F.lit("\n"), F.array_join(ms.contents(ms.keep_last(transcript, 6)), "\n")))
    bridge = (F.size(unexpected) == 1) & F.array_contains(own, "emotion_attachment")
    fine = (F.size(unexpected) == 0) | (F.size(F.array_except(unexpected, recent)) == 0) | bridge
    return F.when(tx.strip(candidate) == "", "empty").when(~fine, F.array_join(unexpected, ","))


def translation_problems(source: Column, target: Column, system: str = "You are a helpful assistant.") -> Column:
    """Why a translation into Chinese does not stand for its source: counts, roles, the system message, the script."""
    pairs = ms.positional_pairs(source, target)
    text = F.array_join(ms.contents(ms.dialogue(target)), "\n")
    cjk, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z]{3,}"))
    first = F.size(target) > 0
    kept = first & (F.get(target, F.lit(0))["role"] == "system") & (F.get(target, F.lit(0))["content"] == system)
    roles = F.exists(pairs, lambda p: ~p["source"]["role"].eqNullSafe(p["target"]["role"]))
    return F.array_compact(F.array(
        F.when(F.size(source) != F.size(target), "count"), F.when(roles, "roles"), F.when(~F.coalesce(kept, F.lit(False)), "system"), F.when(cjk == 0, "no Chinese"), F.when(cjk < F.greatest(F.lit(20), latin * 2), "little Chinese"),
    ))


def opening(theme: Column, openings: list[tuple[str, str]], *, lower: bool = False) -> Column:
    """The opening of the first entry (part of a theme, opening) that the theme holds, trimmed as a user message; null if none."""
    t = F.lower(tx.strip(theme)) if lower else tx.strip(theme)
    return F.coalesce(*[F.when(t.contains(part), tx.trim_user(F.lit(said))) for part, said in openings], F.lit(None).cast("string"))
