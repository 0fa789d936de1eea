"""Column expressions for matching term lists.

Term lists are small rule data; they compile to substring tests on one
normalised form of the text, so labelling stays a narrow, shuffle-free
projection with a single regular-expression pass per text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Labelled = Sequence[tuple[str, Sequence[str]]]


@dataclass(frozen=True)
class Forms:
    """SQL of a text in lower case, of its Latin words between single spaces, and of these with commas as words."""

    low: str
    words: str
    spoken: str = ""


def forms_of(text: str, idioms: str = "") -> Forms:
    """All forms of a column or SQL expression, written out where they are used; without the phrases of ``idioms``."""
    low = f"lower({text})"
    whole = f"replace(regexp_replace({low}, '{CONTRACTED}', '$1 not'), 'n\\'t', ' not')"
    words = f"concat(' ', regexp_replace({whole}, '[^a-z0-9]+', ' '), ' ')"
    if not idioms:
        return Forms(low, words, words)
    spoken = f"concat(' ', trim(regexp_replace(regexp_replace({whole}, '[,，]', ' , '), '[^a-z0-9,]+', ' ')), ' ')"
    spoken = f"regexp_replace({spoken}, {quoted(idioms)}, ' ')"
    return Forms(low, f"concat(' ', regexp_replace({spoken}, '[ ,]+', ' '), ' ')", spoken)


def with_forms(df: DataFrame, col: str, idioms: str = "") -> tuple[DataFrame, Forms]:
    """All forms as columns, computed once however many rules look at them.

    They come out of a one-row generator: the optimizer would otherwise copy
    the expressions into every rule and filter above.
    """
    forms = forms_of(col, idioms)
    spoken = f", '__spoken', {forms.spoken}" if idioms else ""
    return df.selectExpr("*", f"inline(array(named_struct('__low', {forms.low}, '__words', {forms.words}{spoken})))"), Forms("__low", "__words", "__spoken" if idioms else "__words")


def drop_forms(df: DataFrame) -> DataFrame:
    return df.drop("__low", "__words", "__spoken")


#: Contractions whose first part is not what stands before n't.
CONTRACTED = "(can|won)[\u2019\\']t"


def term_key(term: str) -> tuple[str, bool]:
    """(what to search for, whether in the word form): terms of Latin script match
    whole words, terms of other scripts match anywhere."""
    if term.isascii():
        whole = re.sub("(can|won)'t", "\\1 not", term.lower()).replace("n't", " not")
        return " " + re.sub("[^a-z0-9]+", " ", whole).strip() + " ", True
    return term.lower(), False


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_test(forms: Forms, terms: Sequence[str]) -> str:
    """SQL condition: any of the terms occurs."""
    keys = [term_key(t) for t in terms]
    return " OR ".join(f"contains({forms.words if latin else forms.low}, {quoted(key)})" for key, latin in keys) or "false"


def pattern_case(forms: Forms, rules: Labelled, default: str) -> str:
    """SQL label of the first rule, in order, with a matching pattern; ``default`` is SQL."""
    whens = " ".join(f"WHEN {' OR '.join(f'{forms.spoken} RLIKE {quoted(p)}' for p in patterns)} THEN {quoted(label)}" for label, patterns in rules)
    return f"CASE {whens} ELSE {default} END" if whens else default


def any_term(forms: Forms, terms: Sequence[str]) -> Column:
    return F.expr(term_test(forms, terms))


def label_case(forms: Forms, rules: Labelled, default: str) -> str:
    """SQL label of the first rule, in priority order, with a matching term; ``default`` is SQL."""
    whens = " ".join(f"WHEN {term_test(forms, terms)} THEN {quoted(label)}" for label, terms in rules)
    return f"CASE {whens} ELSE {default} END" if whens else default


def first_label(forms: Forms, rules: Labelled, default: str) -> Column:
    return F.expr(label_case(forms, rules, quoted(default)))


def all_labels(forms: Forms, rules: Labelled) -> Column:
    """Sorted array of every label with a matching term."""
    hits = ", ".join(f"CASE WHEN {term_test(forms, terms)} THEN {quoted(label)} END" for label, terms in rules)
    return F.expr(f"array_sort(array_compact(array({hits})))")


def escape(term: str) -> str:
    return re.sub("([.$*+?{}()|\\[\\]])", "[\\1]", term.lower())


def word_sequence(col: Column) -> Column:
    """Lower-case words of a text in their order. Scripts without blanks between words give one word a character."""
    apart = F.regexp_replace(F.lower(col), "(\\p{IsHan}|\\p{IsHiragana}|\\p{IsKatakana})", " $1 ")
    return F.filter(F.split(apart, "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def tokens(col: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(word_sequence(col))


def digest(*cols: Column | str) -> Column:
    """Hex id over string parts with an explicit separator."""
    return F.sha2(F.concat_ws("|", *cols), 256)


def rank_of(col: str, order: Sequence[str]) -> Column:
    """Position of a value in a priority list; unknown values come last."""
    whens = " ".join(f"WHEN {quoted(value)} THEN {i}" for i, value in enumerate(order))
    return F.expr(f"CASE {col} {whens} ELSE {len(order)} END") if whens else F.lit(0)
