"""Text cleaning and classification as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions import fixed_values as fixed
from ledgerline.functions.columns import ColumnLike, col

Pairs = Sequence[tuple[str, str]]

WHITESPACE = " \t\n\r\x0b\x0c\xa0"


def strip(c: ColumnLike) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def replace_pairs(c: ColumnLike, pairs: Pairs) -> Column:
    """Literal replacements inside the text, one after the other."""
    out = col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def first_rule(c: ColumnLike, rules: Pairs, exact: Pairs = ()) -> Column:
    """Label of the first phrase the text contains; then exact texts; else the text."""
    text = col(c)
    out = None
    tests = [(text.contains(F.lit(p)), label) for p, label in rules] + [(text == F.lit(v), label) for v, label in exact]
    for test, label in tests:
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return text if out is None else out.otherwise(text)


def method_label(c: ColumnLike) -> Column:
    return first_rule(replace_pairs(c, fixed.ENCODING_REPAIRS), fixed.METHOD_RULES, fixed.METHOD_EXACT)


def method_category(c: ColumnLike) -> Column:
    return whitelist(c, fixed.METHOD_CATEGORIES, fixed.METHOD_DEFAULT)


def decision_label(c: ColumnLike) -> Column:
    return first_rule(strip(c), fixed.DECISION_RULES, fixed.DECISION_EXACT)


def decision_category(c: ColumnLike) -> Column:
    return whitelist(c, fixed.DECISION_CATEGORIES, fixed.DECISION_DEFAULT)


def followup_label(c: ColumnLike) -> Column:
    text = replace_pairs(decision_label(c), fixed.FOLLOWUP_TYPOS)
    return first_rule(text, fixed.FOLLOWUP_RULES, fixed.FOLLOWUP_EXACT)


def followup_discarded(label: ColumnLike) -> Column:
    return col(label).eqNullSafe(F.lit(fixed.FOLLOWUP_DISCARDED))


def previous_flag(c: ColumnLike, rules: Pairs = fixed.PREVIOUS_RULES,
                  empty: Sequence[str] = fixed.PREVIOUS_EMPTY, default: str = fixed.PREVIOUS_DEFAULT) -> Column:
    text = first_rule(strip(c), rules)
    return F.when(text.isNull() | text.isin(list(empty)), F.lit(default)).otherwise(text)


def corrected_previous(flag: ColumnLike, events: ColumnLike, more_than: int = 1,
                       unknown: str = fixed.PREVIOUS_DEFAULT, yes: str = fixed.PREVIOUS_YES) -> Column:
    """An unknown flag becomes 'SI' for entities with more than ``more_than`` events."""
    return F.when((col(flag) == unknown) & (col(events) > more_than), F.lit(yes)).otherwise(col(flag))


def whitelist(c: ColumnLike, allowed: Sequence[str], default: str) -> Column:
    """Keep listed values; everything else, null included, becomes the default."""
    return F.when(col(c).isin(list(allowed)), col(c)).otherwise(F.lit(default))


def upper_trimmed(c: ColumnLike) -> Column:
    return F.upper(strip(c))


def contains_any(c: ColumnLike, marks: Sequence[str]) -> Column:
    test = F.lit(False)
    for mark in marks:
        test = test | col(c).contains(F.lit(mark))
    return test


def provider_class(c: ColumnLike, marks: Sequence[str] = fixed.PUBLIC_MARKS,
                   yes: str = fixed.PUBLIC, no: str = fixed.PRIVATE) -> Column:
    return F.when(contains_any(c, marks), F.lit(yes)).when(col(c).isNotNull(), F.lit(no))


def provider_list_class(c: ColumnLike, marks: Sequence[str] = fixed.PUBLIC_MARKS, yes: str = fixed.PUBLIC,
                        no: str = fixed.PRIVATE, unknown: str = fixed.PROVIDER_UNKNOWN) -> Column:
    """Class of each member of a ``|``-separated list, re-joined; null stays null."""
    members = F.transform(F.split(col(c), r"\|"), lambda m: provider_class(m, marks, yes, no))
    return (F.when(col(c) == unknown, col(c))
            .when(col(c) == fixed.PROVIDER_MISSING_TEXT, F.lit(fixed.PROVIDER_MISSING_LABEL))
            .otherwise(F.array_join(members, "|")))


def has_class(label: ColumnLike, name: str) -> Column:
    """Tri-state flag: null where the label is null."""
    return col(label).contains(F.lit(name))


def provider_class_by_name(c: ColumnLike, public: Sequence[str] = fixed.PUBLIC_NAMES_FIRST,
                           other: Sequence[str] = fixed.OTHER_NAMES_FIRST) -> Column:
    """First-version classes by whole names; anything unlisted is private."""
    return (F.when(col(c).isin(list(other)), F.lit(fixed.OTHER_FIRST))
            .when(col(c).isin(list(public)), F.lit(fixed.PUBLIC_FIRST)).otherwise(F.lit(fixed.PRIVATE_FIRST)))


def provider_class_by_mark(c: ColumnLike, mark: str = fixed.PUBLIC_MARK_FIRST,
                           unknown: str = fixed.PROVIDER_UNKNOWN) -> Column:
    return (F.when(col(c) == unknown, col(c)).when(col(c).contains(F.lit(mark)), F.lit(fixed.PUBLIC_FIRST))
            .when(col(c).isNotNull(), F.lit(fixed.PRIVATE_FIRST)))


def code_in(c: ColumnLike, ranges: Sequence[tuple[str, int, int]]) -> Column:
    """1 when the first three characters are a letter and number in a range, else 0."""
    code = F.substring(col(c), 1, 3)
    number = F.when(code.rlike("^[A-Z][0-9]{2}$"), F.substring(code, 2, 2).cast("int"))
    test = F.lit(False)
    for letter, low, high in ranges:
        test = test | (code.startswith(letter) & number.between(low, high))
    return F.coalesce(test, F.lit(False)).cast("int")


def code_label(c: ColumnLike, labels: Mapping[str, str] = fixed.CODE_LABELS) -> Column:
    return lookup(F.substring(col(c), 1, 3), labels)


def lookup(c: ColumnLike, table: Mapping) -> Column:
    """Value from a constant table; null when absent."""
    literals = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), col(c))


def snippet(c: ColumnLike, length: int = 512) -> Column:
    """Short display text of a longer one."""
    return F.substring(col(c), 1, length)
