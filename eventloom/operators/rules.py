"""Rule filters: categories, watch lists, staleness and the gate that a date must pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import vocab as V
from eventloom.functions.text import fill, fold_words


def any_of(key: Column, words: Sequence[str], folded: bool = False) -> Column:
    """The key contains one of the words, whose keys are made once here. Plain searches, one after another until one hits,
    are several times faster than one pattern of alternatives."""
    tests = [key.contains(w) for w in (list(words) if folded else fold_words(words)) if w]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def classify(key: Column, enabled: Sequence[str] | None = None, words: Mapping[str, Sequence[str]] = V.CATEGORY_WORDS, excluded: Sequence[str] = tuple(V.EXCLUDED_WORDS), suffix: bool = True) -> Column:
    """Categories of a key in the vocabulary's order; an excluded word empties them. ``suffix``: the rule for 展 adds the
    exhibition category last."""
    on = [c for c in words if enabled is None or c in enabled]
    if not on:
        return F.array().cast("array<string>")
    hits = [F.when(any_of(key, words[c]), F.lit(c)) for c in on]
    if suffix and "exhibition" in on:
        hits.append(F.when(key.rlike(f"(?<![{V.EXHIBITION_NOT_AFTER}])展(?![{V.EXHIBITION_NOT_BEFORE}])"), F.lit("exhibition")))
    # each test appears once, as the engine would evaluate a second mention again
    found = F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return F.when(any_of(key, excluded), F.array().cast("array<string>")).otherwise(found)


def event_fallback(key: Column, categories: Column, enabled: Sequence[str] | None = None, stem: str = V.HINT_STEM, hints: Sequence[str] = tuple(V.HINT_WORDS)) -> Column:
    """A weak sign, the stem with a hint word, makes a screening event of a text without categories."""
    if enabled is not None and not {"screening_event", "revival"} & set(enabled):
        return categories
    weak = any_of(key, [stem]) & any_of(key, hints)
    # as a variable, the categories are made once
    return F.get(F.transform(F.array(F.struct(categories.alias("c"), weak.alias("weak"))), lambda x: F.when((F.size(x.c) == 0) & x.weak, F.array(F.lit("screening_event"))).otherwise(x.c)), 0)


def match_watchlist(key: Column, loose_key: Column, works: Sequence[Mapping], people: Sequence[Mapping]) -> Column:
    """array<struct<kind, label, role>>: works, then people, that a text names by title or alias.

    The lists are a dimension that people keep by hand; they become literals, so that a text is matched where it is read,
    without a join.
    """
    from eventloom.functions.text import fold_words as keys

    def loose(words: Sequence[str]) -> list[str]:
        out = []
        for k in keys(words):
            fit = next((p for p in V.LOOSE_PREFIXES if k.startswith(p) and len(k) > len(p) + 1), "")
            out.append(k[len(fit) :])
        return out

    rules: list[tuple[list[str], list[str], str, str, str | None]] = []  # words of the key, of the loose key, and the entry
    for w in works:
        terms = [t for t in [w.get("title") or w.get("name") or "", *w.get("aliases", [])] if t]
        if terms:
            rules.append((keys(terms), loose(terms), "work", w.get("title", terms[0]), None))
    for p in people:
        terms = [t for t in [p.get("name") or p.get("title") or "", *p.get("aliases", [])] if t]
        long = [k for k in keys(terms) if len(k) >= 3]
        if long:
            rules.append((long, [], "person", p.get("name", terms[0]), p.get("role", "")))
    kind = "array<struct<kind: string, label: string, role: string>>"
    if not rules:
        return F.array().cast(kind)

    def entries(x: Column) -> Column:
        hit = [F.when(any_of(x.key, a, True) | any_of(x.loose, b, True), F.struct(F.lit(what).alias("kind"), F.lit(name).alias("label"), F.lit(role).cast("string").alias("role"))) for a, b, what, name, role in rules]
        return F.filter(F.array(*hit), lambda e: e.isNotNull())

    # as a variable, both keys are made once whatever the length of the lists
    return F.get(F.transform(F.array(F.struct(key.alias("key"), loose_key.alias("loose"))), entries), 0).cast(kind)


def is_stale(published: Column, today: Column, most: int = V.MOST_AGE_DAYS) -> Column:
    return F.coalesce(F.datediff(today, published) > most, F.lit(False))


def has_ended(start: Column, end: Column, today: Column) -> Column:
    return F.coalesce(F.coalesce(end, start) < today, F.lit(False))


def max_span(categories: Column, spans: Mapping[str, int] = V.SPAN_DAYS, default: int = V.SPAN_DEFAULT) -> Column:
    """The longest limit of the categories; the default if none has one."""
    table = F.create_map(*[x for k, n in spans.items() for x in (F.lit(k), F.lit(n))])
    return F.coalesce(F.array_max(F.transform(categories, lambda c: F.element_at(table, c))), F.lit(default))


def assess(start: Column, end: Column, published: Column, today: Column, explicit: Column, categories: Column) -> Column:
    """struct<accepted, reason>: whether a date may be announced; the first rule that speaks decides."""
    span, limit, age = F.datediff(end, start) + 1, max_span(categories), F.datediff(today, published)
    reason = (
        F.when(start.isNull(), F.lit(V.REASON_NO_DATE))
        .when(span > limit, fill(V.REASON_SPAN, span, limit))
        .when(published.isNull(), F.when(F.coalesce(explicit, F.lit(False)), F.lit("")).otherwise(F.lit(V.REASON_NO_YEAR)))
        .when(age > V.MOST_AGE_DAYS, fill(V.REASON_OLD, age))
        .when((start < F.date_sub(published, V.MOST_BACK_DAYS)) & ~F.coalesce(end >= today, F.lit(False)), F.lit(V.REASON_BEFORE))
        .when(start > F.date_add(published, V.MOST_LEAD_DAYS), F.lit(V.REASON_AFTER))
        .otherwise(F.lit(""))
    )
    return F.struct((reason == "").alias("accepted"), reason.alias("reason"))
