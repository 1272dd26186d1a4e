"""Text functions as column expressions: splitting, chunking, tokenising, sentences, summaries, query rewriting."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() has it; the same pattern works in Java's and RE2's regex syntax.
W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# The stop words of the lexical tokeniser.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can of in "
    "to for with on at from by about as into through during before after above below between under again further then "
    "once here there when where why how all each every both few more most other some such no nor not only own same so "
    "than too very just because but and or if while also this that these those what which who whom it its he she they "
    "we me my your his her our their you i"
).split()
# The smaller stop list of the keyword-coverage test.
COVERAGE_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can of in "
    "to for with on at from by about as into through during before after what which who whom this that these those and "
    "but or nor not so yet"
).split()
# Suffix, least length (exclusive), characters to drop, what to put in their place. The first that fits.
SUFFIXES = (
    ("ing", 5, 3, ""), ("tion", 5, 4, "e"), ("sion", 5, 4, "s"), ("ness", 5, 4, ""), ("ment", 5, 4, ""), ("able", 5, 4, "e"),
    ("ible", 5, 4, "e"), ("ly", 4, 2, ""), ("ity", 4, 3, "e"), ("ed", 4, 2, ""), ("es", 3, 2, ""), ("s", 3, 1, ""),
)
# Question beginnings that a more specific reformulation strips.
QUESTION_PREFIXES = ("what is ", "what are ", "who is ", "who was ", "how does ", "how do ", "why does ", "why do ")
# Conjunctions that split a query in two, and signs of a comparison, which is never split.
CONJUNCTIONS = (" and ", " but also ", " as well as ", " in addition to ")
COMPARISONS = ("compare", "difference between", "vs", "versus", " or ")


def full_text(title: Column, text: Column) -> Column:
    """Title and text with a space between, stripped of white space at both ends; nulls are empty."""
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.regexp_replace(joined, f"^{W}", ""), f"{W}$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it. (An expression that stands inside a
    lambda would be computed again for every element.)"""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), W), lambda w: w != "")


def chunk_words(w: Column, size: int, overlap: int) -> Column:
    """Overlapping slices of a word array, as strings. Slices start at every multiple of size - overlap below the
    length, so with overlap the last may lie within its predecessor. No words: no chunks."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and overlap smaller than it")
    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap))
        made = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    return let(w, cut)


def stem(t: Column) -> Column:
    """The first suffix rule that fits."""
    rule = None
    for suffix, least, drop, put in SUFFIXES:
        fits = t.endswith(suffix) & (F.length(t) > least)
        if suffix == "s":
            fits = fits & ~F.substring(t, -2, 1).isin("s", "u")
        made = F.concat(F.left(t, F.length(t) - drop), F.lit(put))
        rule = F.when(fits, made) if rule is None else rule.when(fits, made)
    return rule.otherwise(t)


def tokens(text: Column) -> Column:
    """Lexical tokens: words of a-z only (runs that touch digits, underscores or other letters are dropped whole),
    without stop words and single letters, stemmed. Stop words are dropped before stemming."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    kept = F.filter(pieces, lambda t: t.rlike("^[a-z]{2,}$") & ~t.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def context_prefix(title: Column, text: Column, limit: int = 100) -> Column:
    """What a contextual chunk is preceded by: the title, or the first sentence (or the first `limit` characters); cut
    to `limit` words."""
    t = F.coalesce(text, F.lit(""))
    first = F.when(t.contains(". "), F.split(t, r"\. ")[0]).otherwise(F.substring(t, 1, limit))
    has = F.coalesce(title, F.lit("")) != ""
    made = F.when(has, F.concat(F.lit("Document title: "), title, F.lit("."))).otherwise(F.concat(F.lit("Document begins: "), first, F.lit(".")))
    # No lambda refers to an outer one's variable: Spark evaluates no Python UDF whose input has such a lambda.
    both = let(made, lambda m: F.struct(m.alias("whole"), words(m).alias("words")))
    return let(both, lambda b: F.when(F.size(b["words"]) > limit, F.concat(F.array_join(F.slice(b["words"], 1, limit), " "), F.lit("..."))).otherwise(b["whole"]))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{W}", ""), f"{W}$", "")


def sentences(text: Column, line_ends: bool = False) -> Column:
    """Pieces between sentence ends, stripped, of more than ten characters. With line_ends, `!` and `?` before a line
    break end a sentence too."""
    pattern = r"\. |! |\? |\.\n" + (r"|!\n|\?\n" if line_ends else "")
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip)
    return F.filter(pieces, lambda s: F.length(s) > 10)


def _best_sentences(text: Column, s: Column, scores: Column, k: int) -> Column:
    """The k sentences of highest score (ties: the earlier), in their order; all if there are no more than k; the
    text's beginning if there is none."""
    zipped = F.zip_with(s, F.transform(scores, lambda x, i: F.struct((-x).alias("d"), i.alias("i"))), lambda x, y: F.struct(y["d"].alias("d"), y["i"].alias("i"), x.alias("s")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(zipped), 1, k), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    many = F.array_join(F.transform(best, lambda x: x["s"]), ". ")
    few = F.array_join(s, ". ")
    blank = F.coalesce(F.length(strip(text)), F.lit(0)) == 0
    return F.when(blank, "").when(F.size(s) == 0, F.substring(text, 1, 500)).when(F.size(s) <= k, few).otherwise(many)


def summary_by_position(text: Column, k: int = 3) -> Column:
    """Extractive summary that favours early and long sentences."""
    score = lambda x, i: F.round(0.6 / (1 + i * 0.3) + 0.4 * F.least(F.size(words(x)) / 20.0, F.lit(1.0)), 9)
    return let(sentences(text, line_ends=True), lambda s: _best_sentences(text, s, F.transform(s, score), k))


def summary_by_frequency(text: Column, k: int = 5) -> Column:
    """Extractive summary that favours sentences of frequent words (of more than two letters), early and long ones.
    Counting words within each text is quadratic in array expressions, so this one runs on Arrow batches."""

    @F.pandas_udf("string")
    def best(texts: pd.Series, split: pd.Series) -> pd.Series:
        return pd.Series([_by_frequency(t, list(s) if s is not None else [], k) for t, s in zip(texts, split)])

    return best(text, sentences(text))


def _by_frequency(text: str | None, split: list[str], k: int) -> str:
    if not text or not text.strip():
        return ""
    if len(split) <= k:
        return ". ".join(split) if split else text[:500]
    lists = [s.lower().split() for s in split]
    counts = Counter(w for ws in lists for w in ws if len(w) > 2)
    top = max(counts.values(), default=1)
    score = lambda i: round(0.5 * sum(counts[w] for w in lists[i]) / top / len(lists[i]) + 0.3 / (1 + i * 0.2) + 0.2 * min(len(lists[i]) / 15.0, 1.0), 9)
    order = sorted(range(len(split)), key=lambda i: (-score(i), i))[:k]
    return ". ".join(split[i] for i in sorted(order))


def node_id(level: Column, cluster: Column, text: Column) -> Column:
    return F.concat(F.lit("l"), level.cast("string"), F.lit("::c"), cluster.cast("string"), F.lit("::"), F.substring(F.md5(text), 1, 8))


def clean_query(q: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(q), r"\?+$", ""), r"\.+$", "")


# The three templates of a made-up answer. {q} is the cleaned query, {low} the same in lower case.
TEMPLATES = (
    "Based on research and analysis, {q}. "
    "This topic involves several key aspects that are well-documented in the literature. "
    "Studies have shown that {low} is an important area of investigation. "
    "The evidence suggests multiple factors contribute to this phenomenon.",
    "The answer to {q} involves understanding the underlying mechanisms. "
    "Research has demonstrated that this is a complex topic with multiple contributing factors. "
    "Key findings include the relationship between various variables and outcomes. "
    "This area continues to be actively studied.",
    "{q}. "
    "This is a well-studied topic in the scientific literature. "
    "Multiple studies have investigated the various aspects and contributing factors. "
    "The consensus view, based on available evidence, provides important insights.",
)


def hypothetical_document(q: Column) -> Column:
    """A made-up answer text for a query; which of three templates is decided by the query's md5."""
    # 16 is 1 modulo 3: the number's remainder is that of its hexadecimal digits' sum.
    digits = F.transform(F.split(F.md5(q), ""), lambda d: F.when(d == "", 0).otherwise(F.conv(d, 16, 10).cast("int")))
    which = F.pmod(F.aggregate(digits, F.lit(0), lambda a, d: a + d), F.lit(len(TEMPLATES)))

    def filled(c: Column, template: str) -> Column:
        pieces = re.split(r"(\{q\}|\{low\})", template)
        return F.concat(*[c if p == "{q}" else F.lower(c) if p == "{low}" else F.lit(p) for p in pieces if p])

    return let(clean_query(q), lambda c: F.element_at(F.array(*[filled(c, t) for t in TEMPLATES]), which + 1))


def decompose_query(q: Column) -> Column:
    """Sub-queries: two parts around one conjunction; a comparison stays whole; a question about who or what with a
    relative clause is cut before it."""
    low, rule = F.lower(q), None
    for c in CONJUNCTIONS:
        parts = F.split(q, c, -1)
        made = F.filter(F.transform(parts, strip), lambda p: p != "")
        fits = low.contains(c) & (F.size(parts) == 2)
        rule = F.when(fits, made) if rule is None else rule.when(fits, made)
    compares = F.lit(False)
    for c in COMPARISONS:
        compares = compares | low.contains(c)
    rule = rule.when(compares, F.array(q))
    asks = low.contains(" who ") | low.contains(" what ")
    for c in (" that ", " which "):
        parts = F.split(q, c, 2)
        rule = rule.when(asks & low.contains(c) & (F.size(parts) == 2), F.filter(F.transform(parts, strip), lambda p: p != ""))
    return rule.otherwise(F.array(q))


def strip_question(q: Column) -> Column:
    """Without the first question beginning that it has."""
    rule = None
    for p in QUESTION_PREFIXES:
        fits = F.lower(q).startswith(p)
        made = F.right(q, F.greatest(F.length(q) - len(p), F.lit(0)))
        rule = F.when(fits, made) if rule is None else rule.when(fits, made)
    return rule.otherwise(q)


def broaden(q: Column) -> Column:
    """The first half of the words, if there are more than five."""
    return let(words(q), lambda w: F.when(F.size(w) > 5, F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " ")).otherwise(q))


def keyword_coverage(q: Column, context: Column) -> Column:
    """Share of the query's keywords that occur as substrings of the context; null without keywords."""
    keys = F.filter(F.array_distinct(words(F.lower(q))), lambda w: ~w.isin(*COVERAGE_STOP_WORDS))
    low = F.lower(F.coalesce(context, F.lit("")))
    return let(keys, lambda ks: F.when(F.size(ks) > 0, let(low, lambda c: F.size(F.filter(ks, lambda w: F.contains(c, w)))) / F.size(ks)))
