"""Text cleaning and tokens as Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A publisher's note is removed only when it has fewer words than this.
NOTE_WORDS = 20


def _drop_note(text: Column, pattern: str) -> Column:
    note = F.regexp_extract(text, pattern, 0)
    return F.when((note != "") & (F.size(F.split(note, " ")) < NOTE_WORDS), F.regexp_replace(text, pattern, "")).otherwise(text)


def clean_text(text: Column) -> Column:
    """Without rights notes, doi notes and copyright lines; the constant Inf in lower case."""
    text = F.replace(F.replace(text, F.lit("Inf"), F.lit("inf")), F.lit("All rights reserved."), F.lit(""))
    return _drop_note(_drop_note(text, r"\[DOI:(.*)\]"), r"©(.*)\.")


def title_and_abstract(title: Column, abstract: Column, clean: bool = True) -> Column:
    """One document text, cleaned as a whole; null when both are."""
    whole = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))
    return F.when(title.isNotNull() | abstract.isNotNull(), clean_text(whole) if clean else whole)


def words(text: Column) -> Column:
    """Plain word tokens (a substitute for a domain tokenizer): runs of letters, digits and inner dots or hyphens."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def normalise(text: Column, number: str = "<nUm>") -> Column:
    """Lower case, words and numbers only, numbers as a placeholder."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*|[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^[0-9.]+$"), F.lit(number)).otherwise(t)), " ")


def without(tokens: Column, stop: Iterable[str]) -> Column:
    """Tokens outside a stop list, repetitions kept."""
    drop = list(stop)
    return F.filter(tokens, lambda t: ~t.isin(drop)) if drop else tokens


def keep_token(token: Column, discard_prefix: str = "a_") -> Column:
    """The vocabulary rule of walk corpora: node tokens of a type are left out."""
    return ~token.startswith(discard_prefix)


def certain_terms(token: Column, terms: Iterable[str]) -> Column:
    """The vocabulary rule that keeps listed terms whatever their count."""
    return token.isin(list(terms))


def simple_formula(token: Column) -> Column:
    """Whether a token is a formula of element symbols and numbers with at least two elements."""
    return token.rlike(r"^(?:[A-Z][a-z]?[0-9.]*){2,}$")


def merge_split_terms(tokens: Column, terms: Column) -> Column:
    """Neighbouring tokens whose concatenation is a known term become that term (pairs, left to right)."""
    start = F.array().cast("array<string>")

    def step(done: Column, token: Column) -> Column:
        joined = F.concat(F.element_at(done, -1), token)
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        return F.when((F.size(done) > 0) & F.array_contains(terms, F.when(F.size(done) > 0, joined)), merged).otherwise(F.concat(done, F.array(token)))

    return F.aggregate(tokens, start, step)


def prune_walk(walk: Column, remove: str, keyword: str | None = None, cut_at_dot: bool = False) -> Column:
    """A walk without the nodes of a type: 'author', 'affiliation', 'author_affiliation' or 'entity' (also drops the keyword).

    Walks left with fewer than two tokens or two distinct ones become null. ``cut_at_dot`` ends the walk at the first
    dot, as corpora of dotted sentences do.
    """
    tokens = F.split(F.regexp_extract(walk, r"^[^.]*", 0) if cut_at_dot else walk, " ")
    is_author, is_aff = r"^a_[0-9]+$", r"^aff_[0-9]+$"
    drop = {
        "author": lambda t: t.rlike(is_author),
        "affiliation": lambda t: t.rlike(is_aff),
        "author_affiliation": lambda t: t.rlike(is_author) | t.rlike(is_aff),
        "entity": lambda t: ~(t.rlike(is_author) | t.rlike(is_aff)) & (F.lit(keyword is None) | (t != F.lit(keyword or ""))),
    }[remove]
    left = F.filter(tokens, lambda t: (t != "") & ~drop(t))
    return F.when(F.size(F.array_distinct(left)) > 1, F.concat_ws(" ", left))


def node_token(kind: Column, node: Column, name: Column) -> Column:
    """Token of a node: a_<id>, aff_<id>, or its name with blanks as underscores."""
    return F.when(kind == "author", F.concat(F.lit("a_"), node.cast("string"))).when(kind == "affiliation", F.concat(F.lit("aff_"), node.cast("string"))).otherwise(F.replace(name, F.lit(" "), F.lit("_")))


def author_of_token(token: Column) -> Column:
    """The id of an author token; null for others."""
    return F.when(token.rlike("^a_[0-9]+$"), F.substring(token, F.lit(3), F.length(token)).cast("long"))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def normal_formula(formula: Column) -> Column:
    """A formula with its elements in alphabetical order and whole amounts without common divisor, 1 left out."""

    def write(entries: Column) -> Column:
        amounts = F.transform(entries, lambda e: e["value"])
        whole = F.forall(amounts, lambda a: (a == F.floor(a)) & (a >= 1) & (a < 10_000))
        least = F.greatest(F.coalesce(F.array_min(amounts).cast("int"), F.lit(1)), F.lit(1))
        by = F.when(whole, F.array_max(F.filter(F.sequence(F.lit(1), least), lambda d: F.forall(amounts, lambda a: a % d == 0)))).otherwise(1)
        return let(by, lambda d: F.array_join(F.transform(entries, lambda e: F.concat(e["key"], let(e["value"] / d, _amount))), ""))

    return let(F.array_sort(F.map_entries(composition(formula))), write)


def _amount(x: Column) -> Column:
    return F.when(x == 1, F.lit("")).when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


_GROUP, _PART = r"[(\[]([^()\[\]]*)[)\]]([0-9.]*)", r"([A-Z][a-z]?)([0-9.]*)"


def _times(part: Column) -> Column:
    return F.coalesce(F.regexp_extract(part, r"[0-9.]+$", 0).try_cast("double"), F.lit(1.0))


def _symbol(part: Column) -> Column:
    return F.regexp_extract(part, r"^[A-Z][a-z]?", 0)


def flat_formula(formula: Column) -> Column:
    """A formula with its brackets written out, one innermost pair at a time: Ca(OH)2 as CaO2.0H2.0."""

    def step(f: Column, _: Column) -> Column:
        inside, times = F.regexp_extract(f, _GROUP, 1), F.coalesce(F.regexp_extract(f, _GROUP, 2).try_cast("double"), F.lit(1.0))
        parts = F.transform(F.regexp_extract_all(inside, F.lit(_PART), F.lit(0)), lambda p: F.concat(_symbol(p), (_times(p) * times).cast("string")))
        return F.when(f.rlike(_GROUP), F.replace(f, F.regexp_extract(f, _GROUP, 0), F.array_join(parts, ""))).otherwise(f)

    pairs = F.size(F.regexp_extract_all(formula, F.lit(r"[(\[]"), F.lit(0)))
    return F.when(pairs > 0, F.aggregate(F.sequence(F.lit(1), pairs), formula, step)).otherwise(formula)


def composition(formula: Column) -> Column:
    """Map element -> amount of a formula; amounts in brackets are multiplied, repeated elements add up."""

    def add(parts: Column) -> Column:
        elements = F.array_distinct(F.transform(parts, _symbol))
        return F.map_from_arrays(elements, F.transform(elements, lambda s: F.aggregate(F.filter(parts, lambda p: _symbol(p) == s), F.lit(0.0), lambda a, p: a + _times(p))))

    return F.when(formula.isNotNull(), let(F.regexp_extract_all(flat_formula(formula), F.lit(_PART), F.lit(0)), add))
