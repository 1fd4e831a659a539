"""Text functions as Column builders; a Pandas UDF only where Spark has no built-in (NFD)."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import values as V

PUNCTUATION = string.punctuation


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside the lambda it is a variable, which Catalyst doesn't inline."""
    return F.element_at(F.transform(F.array(value), use), 1)


# ---- normalising -----------------------------------------------------------


def collapse(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Key for texts that differ in case and white space alone."""
    return F.lower(collapse(text))


def _articles_out(t: Column) -> Column:
    return collapse(F.regexp_replace(t, r"\b(a|an|the)\b", " "))


def normalize_ascii(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles out, spaces collapsed; exact for ASCII texts."""
    return _articles_out(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def normalize_text(text: Column) -> Column:
    """As normalize_ascii with NFD first, for any text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        gone, articles = str.maketrans("", "", PUNCTUATION), re.compile(r"\b(a|an|the)\b")
        return texts.map(lambda s: " ".join(articles.sub(" ", unicodedata.normalize("NFD", s or "").lower().translate(gone)).split()))

    return run(text)


def normalize_answer(raw: Column) -> Column:
    """First line, normalised, without "the answer is" and the like."""
    first = F.element_at(F.split(F.trim(raw), "\n"), 1)
    return F.trim(F.regexp_replace(normalize_ascii(first), V.ANSWER_PREFIX, ""))


def contains_normalized(answer: Column, alias: Column) -> Column:
    """Whether the words of alias are consecutive words of answer, both normalised; an empty alias never is."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return (alias != "") & F.contains(pad(answer), pad(alias))


def classify(gold: Column, attack: Column) -> Column:
    return F.when(gold & attack, "both").when(gold, "gold").when(attack, "attack").otherwise("other")


# ---- tokens, sentences -----------------------------------------------------


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def question_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def sentences(text: Column) -> Column:
    """After . ! or ? and white space."""
    return F.filter(F.split(F.trim(text), V.SENTENCE_END), lambda s: F.trim(s) != "")


def sentences_strict(text: Column) -> Column:
    """As sentences, if a capital, quote or bracket follows; and at line breaks."""
    parts = F.split(F.trim(text), V.SENTENCE_END_STRICT)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


# ---- aliases ---------------------------------------------------------------


def alias_regex(aliases: Column) -> Column:
    """Alternation of an array of aliases, longest first (then by text), between characters that aren't letters or
    digits; an array without aliases gives a pattern that never matches."""
    clean = F.array_distinct(F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: a != ""))
    ranked = F.array_sort(F.transform(clean, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    quoted = F.transform(ranked, lambda x: F.regexp_replace(x["a"], r"([\\^$.|?*+()\[\]{}\-])", r"\\$1"))
    return F.when(F.size(clean) == 0, F.lit("(?!x)x")).otherwise(F.concat(F.lit("(?i)(?<![A-Za-z0-9])("), F.array_join(quoted, "|"), F.lit(")(?![A-Za-z0-9])")))


def lowered(aliases: Column) -> Column:
    """The aliases as names_one looks for them."""
    return F.filter(F.transform(aliases, lambda a: F.lower(F.trim(a))), lambda a: a != "")


def names_one(text: Column, pattern: Column, names: Column) -> Column:
    """Whether text matches alias_regex(aliases), of which names is lowered(aliases): the pattern is tried only where one
    stands in the lowered text. A capital sigma, lowered by what is beside it, always has it tried."""
    held = bound(F.lower(text), lambda low: F.exists(names, lambda a: F.contains(low, a)))
    return (F.contains(text, F.lit("\u03a3")) | held) & F.rlike(text, pattern)


def substitute(text: Column, pattern: Column, replacement: Column) -> tuple[Column, Column]:
    """Text with every match replaced, and how many there were."""
    safe = F.regexp_replace(replacement, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, pattern, safe), F.regexp_count(text, pattern).cast("bigint")


def ordered_distinct(array: Column, key: Callable[[Column], Column]) -> Column:
    """Trimmed elements whose key (not empty) comes first, in order."""

    def firsts(ranked: Column) -> Column:
        new = lambda x, i: (x["key"] != "") & ((i == 0) | ~x["key"].eqNullSafe(F.get(ranked, i - 1)["key"]))
        return F.sort_array(F.transform(F.filter(ranked, new), lambda x: F.struct(x["at"].alias("at"), x["x"].alias("x"))))

    keyed = F.sort_array(F.transform(array, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), F.trim(x).alias("x"))))
    return F.transform(bound(keyed, firsts), lambda x: x["x"])


def number_table() -> list[tuple[str, str]]:
    """(written form, other form) for 0 to 99 and the first twenty ordinals, both ways."""
    rows = []
    for n in range(100):
        tens, ones = divmod(n, 10)
        forms = [V.ONES[n]] if n < 20 else [V.TENS[tens]] if not ones else [f"{V.TENS[tens]}-{V.ONES[ones]}", f"{V.TENS[tens]} {V.ONES[ones]}"]
        rows += [(str(n), f) for f in forms] + [(f, str(n)) for f in forms]
    for n, word in enumerate(V.ORDINALS, 1):
        ending = "th" if n in (11, 12, 13) or n % 10 not in (1, 2, 3) else ("st", "nd", "rd")[n % 10 - 1]
        rows += [(f"{n}{ending}", word), (word, f"{n}{ending}")]
    return rows


# ---- predicates ------------------------------------------------------------


def answer_type(value: Column) -> Column:
    v = F.trim(value)
    return (
        F.when(v.rlike(f"^{V.YEAR}$"), "year").when(v.rlike(r"\d"), "numeric").when(F.regexp_count(v, F.lit(r"\S+")) <= 3, "entity_short").otherwise("entity_long")
    )


def types_match(a: Column, b: Column) -> Column:
    entity = ("entity_short", "entity_long")
    return (a == b) | (a.isin(*entity) & b.isin(*entity))


def looks_like_value(value: Column) -> Column:
    return value.rlike("[A-Z0-9]")


def is_phrase(value: Column) -> Column:
    return (F.regexp_count(value, F.lit(r"\S+")) > 3) | (value.rlike(rf"\b{V.YEAR}\b") & (F.regexp_count(value, F.lit("[A-Za-z]+")) >= 2))


def artifact(wrong: Column, refs: Column, strict: bool = True) -> Column:
    """The first reason for which a value is unfit, or null."""
    first, low = F.get(refs, F.lit(0)), F.lower(wrong)
    toks = F.filter(F.split(F.trim(low), r"\s+"), lambda t: t != "")
    own = F.filter(F.split(F.trim(wrong), r"\s+"), lambda t: t != "")
    out = (
        F.when(F.contains(low, F.lit("disambiguation")), "wikipedia_artifact")
        .when(~wrong.rlike("[A-Za-z0-9]"), "non_latin")
        .when(wrong.rlike(V.UNIT) | F.coalesce(first.rlike(V.UNIT), F.lit(False)), "unit_value")
        .when(F.trim(wrong).rlike(V.NAME_PLUS_YEAR) & ~F.get(toks, F.lit(0)).isin(*V.MONTHS), "name_plus_year")
    )
    if strict:
        many = F.size(toks) >= 2
        generic = F.exists(toks, lambda t: t.isin(*V.GENERIC_TOKENS))
        head, tail = F.get(own, F.lit(0)), F.element_at(own, -1)
        cased = F.forall(F.filter(refs, lambda r: F.trim(r) != ""), lambda r: F.regexp_extract(r, r"(\S+)\s*$", 1).rlike(r"^[\p{Lu}0-9]"))
        out = out.when(many & generic, "descriptor_suffix").when(many & head.rlike(r"^\p{Lu}") & tail.rlike(r"^[\p{L}]+$") & (tail == F.lower(tail)) & cased, "descriptor_suffix")
    return out


def has_markdown(text: Column) -> Column:
    bold, heading, rule = V.MARKDOWN
    return text.rlike(bold) | text.rlike(heading) | text.rlike(rule)


def strip_markdown(text: Column) -> Column:
    """Links, bold, italics, headings, rules and bullets to their words; a second pass changes nothing."""
    for pattern, to in V.MARKDOWN_STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def question_restated(question: Column, text: Column) -> Column:
    """Whether text has, in a row, max(5, 80 %) of the question's words (all of them if there are fewer)."""

    def both(q: Column) -> Column:
        n = F.size(q)
        need = F.least(F.greatest(F.lit(5), F.bround(0.8 * n).cast("int")), n)
        line = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
        runs = F.transform(F.sequence(F.lit(1), n - need + 1), lambda i: F.array_join(F.slice(q, i, need), " "))
        return F.when(n < 3, False).otherwise(bound(line, lambda t: F.exists(runs, lambda r: F.contains(t, F.concat(F.lit(" "), r, F.lit(" "))))))

    return bound(tokens(question), both)


def parse_score(text: Column) -> Column:
    """The last stated score, cut to 0..10; loose forms only where no explicit one is; null if none."""
    strict, loose = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (V.SCORE, V.SCORE_LOOSE))
    found = F.when(F.size(strict) > 0, strict).otherwise(loose)
    number = F.element_at(found, -1)
    capped = F.when(F.length(F.regexp_replace(number, "^0+", "")) > 2, F.lit(10)).otherwise(number.try_cast("int"))
    return F.when(F.size(found) > 0, F.greatest(F.lit(0), F.least(F.lit(10), capped)))


def any_of(phrases: Sequence[str]) -> str:
    """A pattern for any of the phrases as they are, letter by letter: a text is read once, not once for each of them, and
    at each place only the phrases that begin so are looked at."""
    rest: dict[str, list[str]] = {}
    for p in dict.fromkeys(phrases):
        rest.setdefault(p[:1], []).append(p[1:])
    ways = [re.escape(c) + (re.escape(ends[0]) if len(ends) == 1 else any_of(ends)) for c, ends in rest.items()]
    begins = "".join(re.escape(c) for c in rest)
    return f"(?={'[' + begins + ']'})(?:{'|'.join(ways)})" if len(ways) > 1 and "" not in rest else f"(?:{'|'.join(ways)})"


def looks_like_refusal(text: Column, cues: Sequence[str] = V.REFUSALS) -> Column:
    return F.lower(F.substring(F.trim(text), 1, 300)).rlike(any_of(cues))


#: What steps outside a passage: frame breaks, leftovers of a chat, disclaimers.
META = (*V.META_MARKERS, *V.LEXICON["chatbot_leftovers"], *V.LEXICON["knowledge_disclaimers"])


def meta_hits(text: Column, markers: Sequence[str] = META) -> Column:
    """The markers that stand in text between characters that aren't letters."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)(?<![a-z]){re.escape(m)}(?![a-z])"), F.lit(m)) for m in markers]))


def has_meta(text: Column, markers: Sequence[str] = META) -> Column:
    """Whether meta_hits finds any."""
    return F.coalesce(text.rlike(f"(?i)(?<![a-z]){any_of(markers)}(?![a-z])"), F.lit(False))


def template_flags(text: Column) -> dict[str, Column]:
    return {"news_prefix": text.rlike(V.NEWS_PREFIX), "contrast": text.rlike(V.CONTRAST)}


def strip_prefix(text: Column) -> Column:
    return F.regexp_replace(text, V.NEWS_PREFIX + r"\s*", "")


def drop_first_sentence(text: Column) -> Column:
    parts = F.split(F.trim(text), V.SENTENCE_END, 2)
    return F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(text)


def window(text: Column, n: int, draw: Column) -> Column:
    """n consecutive words from a place that draw, in [0, 1), names; short texts whole."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    start = lambda k: F.floor(draw * (F.size(k) - n + 1)).cast("int") + 1
    return bound(parts, lambda k: F.array_join(F.when(F.size(k) <= n, k).otherwise(F.slice(k, start(k), n)), " "))


def alias_window(text: Column, aliases: Column, n: int, draw: Column) -> Column:
    """As window, but placed so that it holds the first alias match where there is one."""
    pattern = alias_regex(aliases)
    line = collapse(text)
    at = F.regexp_instr(line, pattern)
    before = F.regexp_count(F.substring(line, F.lit(1), F.greatest(at - 1, F.lit(0))), F.lit(r"\S+"))
    width = F.coalesce(F.regexp_count(F.regexp_substr(line, pattern), F.lit(r"\S+")), F.lit(0))

    def cut(k: Column) -> Column:
        most = F.size(k) - n
        low, high = F.greatest(F.lit(0), before + width - n), F.least(before, most)
        high = F.greatest(high, low)
        start = F.when(at > 0, F.least(low + F.floor(draw * (high - low + 1)).cast("int"), most)).otherwise(F.floor(draw * (most + 1)).cast("int"))
        return F.array_join(F.when(F.size(k) <= n, k).otherwise(F.slice(k, start + 1, n)), " ")

    return bound(F.split(line, " "), cut)


def rendered(template: str, **slots: Column) -> Column:
    """A template whose {name} slots are filled; a value that itself holds braces stays as it is, null values are empty."""
    parts = []
    for before, name, _, _ in string.Formatter().parse(template):
        if before:
            parts.append(F.lit(before))
        if name is not None:
            parts.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def today() -> Column:
    """The date in ISO form, from the session's clock and zone."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def now() -> Column:
    """The time to the second in ISO form."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


# ---- denial ----------------------------------------------------------------

#: What a denial has before the value, or behind it where it begins with the value: a sentence without any has none.
_DENIAL_CUES = "(?i)(?:" + "|".join(f"(?:{before or after})" for before, after in (p.split("{V}") for _, p in V.DENIALS)) + ")"


def denial(sentence: Column, value_regex: Column) -> Column:
    """Name of the first denial of the value in a sentence, or null.

    Patterns with the value in them are made anew for each sentence, so only sentences with a cue and the value get them."""
    own = F.regexp_replace(value_regex, r"^\(\?i\)", "")
    hit = None
    for name, pattern in V.DENIALS:
        before, after = pattern.split("{V}")
        full = F.concat(F.lit("(?i)" + before + "(?:"), own, F.lit(")" + after))
        hit = F.when(F.rlike(sentence, full), name) if hit is None else hit.when(F.rlike(sentence, full), name)
    return F.when(F.rlike(sentence, value_regex) & sentence.rlike(_DENIAL_CUES), hit)


def denied_in(text: Column, own: Column) -> Column:
    """The sentences that name a value in own and deny it; a text that doesn't name it isn't cut into sentences."""
    found = lambda v: F.filter(sentences_strict(text), lambda s: denial(s, v).isNotNull())
    return bound(alias_regex(own), lambda v: F.when(~F.rlike(text, v), F.array().cast("array<string>")).otherwise(found(v)))


def generation_problem(text: Column, own: Column, other: Column, min_words: int) -> Column:
    """First failing check of a passage that asserts the values in own and not those in other; null if it passes."""
    return (
        F.when(looks_like_refusal(text) | has_meta(text), "refusal")
        .when(word_count(text) < min_words, "too_short")
        .when(~F.rlike(text, alias_regex(own)), "value_missing")
        .when(F.rlike(text, alias_regex(other)), "other_value_present")
        .when(F.size(denied_in(text, own)) > 0, "own_value_negated")
    )


def salvage(text: Column, own: Column, other: Column) -> Column:
    """Sentences kept: those with both values, asides to the reader and denials go; a lone other value, with the names
    before it, is replaced by own's first. A text without any edit is returned as it is."""
    first = F.regexp_replace(F.element_at(own, 1), r"([\\$])", r"\\$1")

    def kept(mine: Column, theirs: Column, whole: Column) -> Column:
        named = F.concat(F.lit(V.NAME_RUN + "(?:"), theirs, F.lit(")"))
        parts = F.filter(whole, lambda s: ~(F.rlike(s, theirs) & F.rlike(s, mine)))
        parts = F.transform(parts, lambda s: F.when(F.rlike(s, theirs), F.regexp_replace(s, named, first)).otherwise(s))
        parts = F.filter(parts, lambda s: ~has_meta(s) & ~looks_like_refusal(s) & denial(s, mine).isNull())
        edited = lambda p: F.exists(whole, lambda s: F.rlike(s, theirs)) | (F.size(p) < F.size(whole))
        return bound(parts, lambda p: F.when(edited(p), F.array_join(p, " ")).otherwise(text))

    patterns = F.struct(alias_regex(own).alias("mine"), alias_regex(other).alias("theirs"), sentences_strict(text).alias("whole"))
    return bound(patterns, lambda x: kept(x["mine"], x["theirs"], x["whole"]))
