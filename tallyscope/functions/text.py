"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscope.functions.scores import lit

#: The words that are no tokens.
STOP_WORDS = (
    "and", "the", "for", "with", "this", "that", "from", "page", "slide", "ppt",
    "以及", "进行", "一个", "需要", "可以", "内容", "页面", "幻灯片", "展示",
)
#: What a Latin word is, and those that belong to no language.
LATIN_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"
NEUTRAL_WORDS = ("ai", "api", "arr", "crm", "esg", "kpi", "mvp", "ppt", "pptx", "roi", "saas", "sam", "som", "tam")
HAN = r"一-鿿"
#: All but a-z, 0-9 and Han characters, as ranges: Java's regex runs a negated class with a range beyond Latin-1 several times slower.
NOT_NORMAL = r"\x00-/:-`{-\u4dff\ua000-\x{10ffff}"


def normalize_text(text: Column) -> Column:
    """Lower-cased letters a-z, digits and Han characters; nothing else."""
    return F.regexp_replace(F.lower(text), f"[{NOT_NORMAL}]+", "")


def tokens(text: Column) -> Column:
    """The distinct tokens of a text in order: words of three characters or more that begin with a letter, numbers with their decimals and percent
    sign, and the overlapping pairs of each run of Han characters; no stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9_-]{2,}|[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0))
    pair = lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    )
    every = F.concat(plain, F.flatten(F.transform(runs, pair)))
    return F.array_distinct(F.filter(every, lambda t: ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct tokens; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, lit(1)).otherwise(both / every)


def recall(needed: Column, held: Column) -> Column:
    """Share of the tokens `needed` that `held` has; null if none are needed."""
    return F.when(F.size(needed) > 0, F.size(F.array_intersect(needed, held)) / F.size(needed))


def token_recall(needle: Column, hay: Column) -> Column:
    """1 where the normalised needle stands in the normalised hay, else the recall of its tokens. Without tokens that
    alone decides, so an empty needle gives 1."""
    return recall_of(normalize_text(needle), tokens(needle), normalize_text(hay), tokens(hay))


def recall_of(needle: Column, needed: Column, hay: Column, held: Column) -> Column:
    """token_recall of texts that are normalised and tokenised already."""
    held_whole = F.contains(hay, needle)
    return F.when((needle != "") & held_whole, lit(1)).otherwise(F.coalesce(recall(needed, held), held_whole.cast("double")))


def tokens_if_any(needed: Column, text: Column) -> Column:
    """tokens(text), or none where no token of `needed` stands anywhere in the text: enough for the recall of `needed`."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.exists(needed, lambda t: F.contains(low, t)), tokens(text)).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, least: int = 8, most: int = 240) -> Column:
    """The sentences of `least` to `most` characters: split at line ends and closing marks."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.!?;。！？；]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s).between(least, most))


def excerpt(text: Column, most: int = 120) -> Column:
    """The text on one line, cut with an ellipsis beyond `most` characters."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def language_label(text: Column) -> Column:
    """ZH, EN, MIXED or UNKNOWN by the counts of Han characters (2 or more) and Latin words (3 or more); words of no
    language and those in capitals of up to five letters don't count."""
    han = F.regexp_count(text, F.lit("[\u3400-\u4dbf\u4e00-\u9fff]"))
    words = F.regexp_extract_all(text, F.lit(LATIN_WORD), F.lit(0))
    told = lambda w: ~F.lower(w).isin(*NEUTRAL_WORDS) & ~((F.upper(w) == w) & (F.length(w) <= 5))
    latin = F.size(F.filter(words, told))
    return (
        F.when((han >= 2) & (latin >= 3), "MIXED").when(han >= 2, "ZH").when(latin >= 3, "EN").otherwise("UNKNOWN")
    )


def nonblank_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[ \t\r\n\f]", ""))
