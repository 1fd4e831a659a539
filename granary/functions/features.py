"""Feature vectors of texts, as named Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.functions.text import bound, question_tokens, sentences, words


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def _mean(x: Column) -> Column:
    return F.when(F.size(x) == 0, 0.0).otherwise(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def staged(df: DataFrame, text: str) -> DataFrame:
    """df with `_words`, `_low` and `_lengths` (words of each sentence), computed once for the features that use them."""
    t = F.col(text)
    df = df.withColumns({"_words": words(t), "_lengths": F.transform(sentences(t), lambda s: F.regexp_count(s, F.lit("[A-Za-z']+")).cast("double"))})
    low = F.split(F.lower(F.array_join("_words", " ")), " ")
    return df.withColumn("_low", F.when(F.size("_words") == 0, F.array().cast("array<string>")).otherwise(low))


def stylometric(text: Column, parts: bool = False) -> dict[str, Column]:
    """Sentence lengths, vocabulary, punctuation and letters of a text; all rates are per word unless the name says otherwise.

    parts: the row went through staged()."""
    w = F.col("_words") if parts else words(text)
    n = F.size(w)
    lengths = F.col("_lengths") if parts else F.transform(sentences(text), lambda s: F.size(words(s)).cast("double"))
    lengths = F.when(F.size(lengths) == 0, F.array(n.cast("double"))).otherwise(lengths)
    square = lambda x: _mean(F.transform(x, lambda v: v * v))
    spread = bound(lengths, lambda x: F.sqrt(F.greatest(F.lit(0.0), square(x) - _mean(x) * _mean(x))))
    low = F.col("_low") if parts else F.transform(w, lambda x: F.lower(x))
    once = bound(F.array_sort(low), lambda k: F.size(F.filter(k, lambda x, i: ((i == 0) | (F.get(k, i - 1) != x)) & ((i == F.size(k) - 1) | (F.get(k, i + 1) != x)))))
    rate = lambda pattern: _share(F.regexp_count(text, F.lit(pattern)), n)
    return {
        "sentence_mean": _mean(lengths),
        "sentence_std": spread,
        "sentence_range": F.array_max(lengths) - F.array_min(lengths),
        "type_token": _share(F.size(F.array_distinct(low)), n),
        "hapax": _share(once, n),
        "word_length": _mean(F.transform(w, lambda x: F.length(x).cast("double"))),
        "long_words": _share(F.size(F.filter(w, lambda x: F.length(x) >= 9)), n),
        "commas": rate(","),
        "semicolons": rate(";"),
        "colons": rate(":"),
        "dashes": rate("—| - |–"),
        "exclamations": rate("!"),
        "questions": rate(r"\?"),
        "quotes": rate('"'),
        "digits_per_char": _share(F.regexp_count(text, F.lit("[0-9]")), F.length(text)),
        "capitalised": _share(F.size(F.filter(F.slice(w, 2, F.greatest(n, F.lit(1))), lambda x: x.rlike("^[A-Z]"))), n),
        "function_words": _share(F.size(F.filter(low, lambda x: x.isin(*V.FUNCTION_WORDS))), n),
    }


def _ascii(pattern: str) -> str:
    r"""The pattern with word ends, white space and line ends as RE2 has them: Java's \b looks at all letters while its \w is
    ASCII, its . stops at other line ends than \n, and its \s has \x0b."""
    pattern = pattern.replace(r"[\w\s]", r"[\w \t\n\f\r]").replace(r"\s", r"[ \t\n\f\r]")
    return "(?d)" + pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def lexicon_patterns() -> dict[str, str]:
    out = {}
    for group, phrases in V.LEXICON.items():
        ranked = sorted(set(phrases), key=lambda p: (-len(p), p))
        out[group] = "(?i)(?<![A-Za-z])(?:" + "|".join(map(re.escape, ranked)) + ")(?![A-Za-z])"
    return out | {k: "(?i)" + _ascii(v) for k, v in V.LEXICON_PATTERNS.items()}


def lexicon(text: Column) -> dict[str, Column]:
    """Marker phrases per 100 words by group, and in all."""
    n = F.greatest(F.lit(1), F.size(words(text)))
    rates = {group: 100.0 * F.regexp_count(text, F.lit(p)) / n for group, p in lexicon_patterns().items()}
    total = None
    for x in rates.values():
        total = x if total is None else total + x
    return rates | {"total": total}


def staged_shape(df: DataFrame, text: str, question: str) -> DataFrame:
    """df with `_t` and `_q` (tokens), `_line` and `_first`, computed once."""
    df = df.withColumns({"_t": question_tokens(F.col(text)), "_q": question_tokens(F.col(question)), "_sentences": sentences(F.col(text))})
    return df.withColumns({"_line": F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")), "_first": question_tokens(F.coalesce(F.get("_sentences", F.lit(0)), F.col(text)))})


def shape(text: Column, question: Column, parts: bool = False) -> dict[str, Column]:
    """How much a text looks like an answer to the question. parts: the row went through staged_shape()."""
    if parts:
        q, t, line, first, sents = (F.col(c) for c in ("_q", "_t", "_line", "_first", "_sentences"))
    else:
        q, t, sents = question_tokens(question), question_tokens(text), sentences(text)
        line, first = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), question_tokens(F.coalesce(F.get(sents, F.lit(0)), text))
    content = F.array_distinct(F.filter(q, lambda w: ~w.isin(*V.STOP_WORDS)))
    own = F.array_distinct(t)
    inter, n_q = F.size(F.array_intersect(content, own)), F.size(content)
    n = F.greatest(F.lit(1), F.size(t))

    def longest(k: Column) -> Column:
        """The longest run, from two words on; a run of m words is held only if one of m - 1 is, so the search stops at the first length that isn't."""
        found = F.lit(0)
        held = lambda m: F.exists(F.sequence(F.lit(1), F.greatest(F.size(k) - m + 1, F.lit(1))), lambda i: F.contains(line, F.concat(F.lit(" "), F.array_join(F.slice(k, i, m), " "), F.lit(" "))))
        for m in range(12, 1, -1):
            # from the inside out: length m is looked at only if m - 1 was found
            found = F.when((F.size(k) >= m) & held(m), F.greatest(F.lit(m), found)).otherwise(F.lit(m - 1 if m > 2 else 0))
        return found / F.greatest(F.size(k), F.lit(1))

    n_sentences = F.greatest(F.size(sents), F.lit(1))
    hits = None
    for p in V.TEMPLATES:
        count = F.regexp_count(text, F.lit("(?i)" + p))
        hits = count if hits is None else hits + count
    return {
        "recall": F.when(n_q > 0, inter / n_q).otherwise(0.0),
        "overlap": F.when(F.size(F.array_union(content, own)) > 0, inter / F.size(F.array_union(content, own))).otherwise(0.0),
        "first_recall": F.when(n_q > 0, F.size(F.array_intersect(content, first)) / n_q).otherwise(0.0),
        "longest_run": longest(q),
        "source_tag": text.rlike(V.SOURCE_TAG).cast("double"),
        "templates": 100.0 * hits / n,
        "has_question": F.contains(text, F.lit("?")).cast("double"),
        "sentence_rate": 100.0 * n_sentences / n,
    }


SCORERS = {"stylometric": (stylometric, False), "lexicon": (lexicon, False), "shape": (shape, True)}
