"""Scalar text functions as column expressions. Nulls count as empty texts unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx


def literal(term: str) -> str:
    """A pattern for the term itself that Java and RE2 read alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\\-])", r"\\\1", term)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: White space as Unicode has it.
SPACE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(text_of(c), F.lit(SPACE))


#: Where members of the two classes can be: letters fall outside at once, before Java tries a class's members one after the other.
_NEAR = r"\x{00}-\x{60}\x{7B}-\x{BF}\x{1680}\x{2000}-\x{303F}\x{FF00}-\x{FFEF}"


def _without(c: Column, members: str) -> Column:
    return F.regexp_replace(c, f"[{_NEAR}&&{members.removesuffix('+')}]+", "")


def canonical(c: Column) -> Column:
    """Lower case, without white space and punctuation: what duplicates are compared by."""
    return _without(F.lower(text_of(c)), lx.CANONICAL_CLASS)


def compact(c: Column) -> Column:
    """Lower case without white space and sentence punctuation: what similarity and repetition are measured on."""
    return _without(F.lower(text_of(c)), lx.COMPACT_CLASS)


def fingerprint(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body has it inside another function's lambda."""
    return F.transform(F.array(value), body)[0]


def grams(c: Column, n: int) -> Column:
    """All runs of n characters in order; the text itself if it is no longer than n, none if it is empty."""
    # one pass: each place is looked at without being taken, so runs overlap
    runs = lambda t: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)
    return let(c, lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(runs(t)))


def char_ngrams(c: Column, n: int = 5) -> Column:
    """The distinct runs of n characters of a canonical text."""
    return F.array_distinct(grams(c, n))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def ngram_repetition(c: Column, n: int = 4) -> Column:
    """1 - distinct/all runs of n characters of the compact text; 0 below 4n characters."""
    own = lambda g: F.when(F.size(g) < 3 * n + 1, F.lit(0.0)).otherwise(F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g))
    return let(grams(compact(c), n), own)


def content_tokens(c: Column) -> Column:
    """Adjacent pairs of CJK characters, and lower-case Latin words of 3 letters or more, each once."""
    text = text_of(c)
    none = F.array().cast("array<string>")
    pairs = let(F.regexp_extract_all(text, F.lit(f"({lx.CJK})"), 1), lambda cjk: F.when(F.size(cjk) < 2, none).otherwise(F.zip_with(F.slice(cjk, 1, F.size(cjk) - 1), F.slice(cjk, 2, F.size(cjk) - 1), lambda a, b: F.concat(a, b))))
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]{3,})"), 1), F.lower)
    return F.array_union(pairs, words)


def emoji_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(lx.EMOJI))


def occurrences(c: Column, term: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def marker_count(c: Column, markers: list[str]) -> Column:
    """How often any of the markers occurs, whatever the case."""
    text = F.lower(text_of(c))
    return reduce(lambda a, b: a + b, [occurrences(text, m.lower()) for m in markers], F.lit(0))


def marker_hits(c: Column, markers: list[str], *, lower: bool = False) -> Column:
    """How many of the markers occur; with lower both sides are compared in lower case."""
    text = F.lower(text_of(c)) if lower else text_of(c)
    return reduce(lambda a, b: a + b, [text.contains(m.lower() if lower else m).cast("int") for m in markers], F.lit(0))


def pattern_count(c: Column, patterns: list[str]) -> Column:
    """Matches of all patterns; case does not matter, and a dot matches line ends."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text_of(c), F.lit(f"(?is){p}")) for p in patterns], F.lit(0))


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text_of(c).rlike(f"(?iU){p}").cast("int") for p in patterns], F.lit(0))


def matched(c: Column, terms: list[str], patterns: list[str], most: int) -> Column:
    """The terms contained in lower case and the patterns found, in their order, at most `most`."""
    lowered = F.lower(text_of(c))
    own = [F.when(lowered.contains(t.lower()), F.lit(t)) for t in terms] + [F.when(text_of(c).rlike(f"(?iU){p}"), F.lit(p)) for p in patterns]
    return F.slice(F.array_distinct(F.array_compact(F.array(*own))), 1, most)


def word_count(c: Column, term: str) -> Column:
    """How often the term stands alone: no letter, digit or underscore of any script on either side."""
    return F.regexp_count(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){literal(term)}(?![\p{{L}}\p{{N}}_])"))


def domain_counts(c: Column, domains: dict[str, list[str]]) -> Column:
    """Map from domain to its number of hits, without domains that have none. CJK terms count wherever they occur.

    Single words are looked up among the text's words, so the text is split once, however many terms there are.
    """
    cjk, one_word = re.compile("[一-鿿]"), re.compile(r"[^\W]+")
    owners: dict[str, list[str]] = {}
    for name, terms in domains.items():
        for t in (t.lower() for t in terms if not cjk.search(t) and one_word.fullmatch(t)):
            owners.setdefault(t, []).append(name)
    table = F.create_map(*[x for t, names in owners.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    none = F.array().cast("array<string>")

    def counted(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
        # a map is searched from its start, so only words that are in it get there
        own = F.filter(words, lambda w: w.isin(*owners)) if owners else none
        hits = F.flatten(F.transform(own, lambda w: F.coalesce(F.element_at(table, w), none)))
        return let(hits, lambda h: F.array(*[F.struct(F.lit(n).alias("k"), _domain_total(text, h, n, ts, cjk, one_word).cast("int").alias("v")) for n, ts in domains.items()]))

    return F.map_from_entries(F.filter(let(F.lower(text_of(c)), counted), lambda e: e["v"] > 0))


def _domain_total(text: Column, hits: Column, name: str, terms: list[str], cjk: re.Pattern, one_word: re.Pattern) -> Column:
    total = F.size(F.filter(hits, lambda h: h == name))
    for t in (t.lower() for t in terms):
        if cjk.search(t):
            total = total + occurrences(text, t)
        elif not one_word.fullmatch(t):
            total = total + F.when(text.contains(t), word_count(text, t)).otherwise(0)
    return total


def entropy(counts: Column) -> Column:
    """Base-2 entropy of a map of counts, rounded to 3 places; 0 for an empty map."""
    values = F.map_values(counts)
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v)
    return F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a - (v / total) * F.log2(v / total + 1e-9)), 3)


def strip_fences(c: Column) -> Column:
    opened = lambda text: strip(F.regexp_replace(F.regexp_replace(text, r"^(?i)```(?:json)?\s*", ""), r"\s*```$", ""))
    return let(strip(c), lambda text: F.when(text.startswith("```"), opened(text)).otherwise(text))


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer, as text: all of it, a list as {"messages": list}, or from the first { to the last }."""
    raw = strip_fences(c)
    whole = F.when(F.try_parse_json(raw).isNotNull(), raw)
    part = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(whole.startswith("{"), whole).when(whole.startswith("["), F.concat(F.lit('{"messages":'), whole, F.lit("}"))).when((part != "") & F.try_parse_json(part).isNotNull(), part)


def cut_leaks(c: Column, markers: list[str] | None = None) -> Column:
    """The text before the first of the markers, stripped."""
    markers = markers or lx.LEAK_CUTS
    # only a character that begins a marker is held against them, so the text is passed once
    near = "" if "" in markers else f"(?=[{''.join(literal(x) for x in sorted({m[0] for m in markers}))}])"
    return strip(F.regexp_replace(text_of(c), f"(?s){near}(?:{'|'.join(map(literal, markers))}).*", ""))


QUOTES = "\"“”‘’`"


def unquote(c: Column) -> Column:
    return F.regexp_replace(text_of(c), f"^[{QUOTES}]+|[{QUOTES}]+$", "")


def without_speaker(c: Column, speakers: list[str]) -> Column:
    """Without a speaker's name and colon at the start; white space at either end goes."""
    return strip(F.regexp_replace(text_of(c), rf"(?iU)^\s*(?:{'|'.join(map(literal, speakers))})\s*[:：]\s*", ""))


_SHELL = ("content", "message", "text", "reply", "value")


def _unshelled(plain: Column) -> Column:
    """The first member of a JSON object that a message has as a string; a text that is no such object as it is. It is parsed once."""
    said = lambda v, shell: F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", strip(shell[k])) for k in _SHELL], plain)
    shell = F.from_json(plain, ", ".join(f"{k} string" for k in _SHELL))
    inside = let(F.try_parse_json(plain), lambda v: F.when(v.isNotNull(), let(shell, lambda x: said(v, x))).otherwise(plain))
    return F.when(plain.startswith("{"), inside).otherwise(plain)


def clean_turn(c: Column, speaker: str, lexicon: lx.Lexicon = lx.DEFAULT, *, clauses: Callable[[Column], Column] | None = None) -> Column:
    """The next chat message alone in a model's answer: without fences, a JSON shell, quotes, leaked turns and speaker names.

    At most 2 lines of a user and 4 of an assistant. clauses is applied to an assistant's text, say dedupe_clauses.
    """
    plain = let(strip_fences(c), _unshelled)
    plain = without_speaker(cut_leaks(unquote(strip(plain))), lexicon.speakers)
    # a line that begins like another speaker's turn ends the message
    leak = rf"(?iU)^\s*(?:{'|'.join(map(literal, lexicon.leak_speakers))}|###\s*Human|###\s*Assistant)\s*[:：]?|<\|im_end\|>|<\|im_start\|>|</s>"
    first = lambda x: F.array_position(F.transform(x, lambda y: y.rlike(leak)), True)
    upto = lambda x: let(first(x), lambda at: F.when(at == 0, x).otherwise(F.slice(x, F.lit(1), (at - 1).cast("int"))))
    lines = let(F.split(plain, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", -1), upto)
    kept = F.filter(F.transform(lines, lambda x: unquote(without_speaker(x, lexicon.speakers))), lambda x: x != "")
    most = 2 if speaker == "user" else 4
    said = strip(F.array_join(F.slice(kept, 1, most), "\n"))
    if speaker == "user":
        said = F.regexp_replace(said, r"[ \t]+", " ")
        said = strip(F.regexp_replace(said, r"^(好的|好|嗯嗯)[，,\s]*(我明白了|明白了)[，,\s]*", ""))
        said = strip(F.regexp_replace(said, r"(?i)^(ok(?:ay)?|sure|yeah)[,\s]*(i understand|got it)[,\s]*", ""))
    elif clauses is not None:
        said = clauses(said)
    return strip(said)


def trim_user(c: Column, words: int = 20, chars: int = 20) -> Column:
    """At most 20 words of a text with Latin letters and no CJK, at most 20 characters of any other."""
    english = lambda text: text.rlike("[A-Za-z]") & ~text.rlike(lx.CJK)
    # the last of the pieces is the rest of the text, unsplit
    first = lambda text: F.array_join(F.slice(F.split(text, r"\s+", words + 1), 1, words), " ")
    return let(strip(c), lambda text: F.when(english(text), first(text)).otherwise(F.rtrim(F.substr(text, F.lit(1), F.lit(chars)))))


def ended(c: Column, token: str = "[END]", spare: int = 8) -> Column:
    """Whether the text is the end token and at most a few characters more."""
    return text_of(c).contains(token) & (F.length(strip(F.replace(text_of(c), F.lit(token), F.lit("")))) <= spare)


def boolish(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("true", "yes", "y", "1", "end", "stop", "是"), True).when(low.isin("false", "no", "n", "0", "continue", "否"), False)


def clamp(c: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
