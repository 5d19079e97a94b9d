"""Text functions as Spark columns.

Only NFKC and full case folding leave the JVM (one Arrow UDF); ``fold_plain`` is the built-in path for text that neither
changes beyond lower case.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from eventloom.functions import vocab as V


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Compatibility form, case-folded."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities resolved, all of them."""
    return texts.map(lambda t: None if t is None else _html.unescape(t))


def fold_plain(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize(text: Column, folded=fold) -> Column:
    """Comparison key: folded, without brackets, separators and spaces. Null is empty."""
    return F.translate(folded(F.coalesce(text, F.lit(""))), V.BRACKETS + V.SEPARATORS, "")


_GONE = {ord(c): None for c in V.BRACKETS + V.SEPARATORS}


@pandas_udf(StringType())
def key_once(texts: pd.Series) -> pd.Series:
    """The comparison key, whole from Python, where many expressions use it."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t or "").casefold().translate(_GONE))


# not to be evaluated again for each filter that could be pushed below it
key_once = key_once.asNondeterministic()


def fold_words(words: Sequence[str]) -> list[str]:
    """The same key of literals, made once on the driver."""
    return [unicodedata.normalize("NFKC", w).translate(_GONE).casefold() for w in words]


def loosen(key: Column, prefixes: Sequence[str] = tuple(V.LOOSE_PREFIXES)) -> Column:
    """Drops the first fitting prefix if more than one character is left."""
    out = None
    for p in prefixes:
        test = key.startswith(p) & (F.char_length(key) > len(p) + 1)
        cut = F.substring(key, len(p) + 1, 1 << 30)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return key if out is None else out.otherwise(key)


def strip_site_suffix(title: Column, outlets: Sequence[str] = tuple(V.OUTLETS)) -> Column:
    pattern = r"(?i)(?:\s*[-|｜]\s*(?:" + "|".join(outlets) + r"))+\s*$"
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), pattern, ""))


def fill(message: str, *values: Column) -> Column:
    """A message of the vocabulary with {0}, {1}, ... replaced; null if a value is."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\d)\}", message):
        parts += [F.lit(message[at : m.start()]), values[int(m[1])].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(message[at:]))


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter key is its own element."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(key) - 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(2))))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def distinctive_terms(text: Column, labels: Column, generic: Sequence[str] = tuple(V.GENERIC_TERMS), pattern: str = V.TERM_PATTERN) -> Column:
    """Name-like terms of a text in compatibility form, without generic ones and those that overlap a label."""
    found = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.array(*[F.lit(g) for g in generic]))
    return F.filter(found, lambda t: ~F.exists(labels, lambda x: x.contains(t) | t.contains(x)))


def related(a: Column, b: Column) -> Column:
    """One term contains the other, or three characters of a in a row are in b."""
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(a) - 2, F.lit(1))), lambda i: F.substring(a, i, F.lit(3)))
    return a.contains(b) | b.contains(a) | ((F.char_length(a) >= 3) & F.exists(triples, lambda g: b.contains(g)))


def shared_term_count(a: Column, b: Column) -> Column:
    """Terms of a that are related to some term of b; not symmetric."""
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: related(x, y))))


# Fixed value: names in corner brackets.
QUOTED = "[「『]([^「」『』]{4,40})[」』]"


def quoted_names(text: Column, label_keys: Column, key=lambda x: x) -> Column:
    """Keys of names in corner brackets, without those equal to a label's. key maps a name to its loose key."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), key))
    return F.filter(names, lambda n: (n != "") & ~F.array_contains(label_keys, n))


def quoted_in_text(names: Column, other_key: Column, least: int = V.QUOTED_LEAST) -> Column:
    return F.exists(names, lambda n: (F.char_length(n) >= least) & other_key.contains(n))


# Fixed value: a title that ends with an account.
HANDLE = r"[（(]@[A-Za-z0-9_]{1,15}[）)]\s*$"


def signal_text(title: Column, summary: Column) -> Column:
    """The title; with the summary if the title is an account's name only."""
    t, s = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(summary, F.lit("")))
    return F.when(t.rlike(HANDLE) & (s != ""), F.concat_ws(" ", t, s)).otherwise(t)


def unescape_common(text: Column) -> Column:
    """The entities &quot; &copy; &middot; &lt; &gt; &#39; &nbsp; and, last, &amp;."""
    for entity, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return text


# What of a page goes, and what takes its place, before and after entities are resolved.
PAGE_TAGS = [(r"(?is)<(script|style|noscript)\b.*?</\1>", " "), (r"(?i)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>", "\n"), ("<[^>]+>", " ")]
PAGE_SPACE = [("[ \t　]+", " "), ("\n{3,}", "\n\n")]


def html_to_text(page: Column, entities=unescape) -> Column:
    """Readable text: no scripts or styles, block ends as line ends, tags as spaces, runs of space and lines shortened."""
    t = F.coalesce(page, F.lit(""))
    for pattern, to in PAGE_TAGS:
        t = F.regexp_replace(t, pattern, to)
    t = entities(t)
    for pattern, to in PAGE_SPACE:
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def clip(text: Column, width: int) -> Column:
    """White space as single spaces, cut to the width with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.char_length(t) <= width, t).otherwise(F.concat(F.substring(t, 1, width - 1), F.lit("…")))
