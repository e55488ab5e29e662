"""SQL templates: what is left of a query when names and constants are gone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pairloom.functions.vocabulary import (
    EQUALISED,
    FUNCTIONS,
    KEPT_SIGNS,
    KEYWORDS,
    NULL_SELECT,
    QUOTED,
    TABLE_WORDS,
    UNTRANSLATED,
)


def _any_of(words) -> str:
    """One alternation over all words, sharing common beginnings.

    A flat list of 146 words is tried word by word at every position; with shared
    beginnings one character rules out nearly all of them.
    """
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    ends = heads.pop("", None) is not None
    branches = [head + _any_of(tails) for head, tails in heads.items()]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return body + "?" if ends else body


_KW = _any_of(KEYWORDS)
_FN = _any_of(FUNCTIONS)
# (?U): word boundaries follow Unicode whatever the Java version.
_TABLE_NAME = rf"(?U)\b({'|'.join(TABLE_WORDS)})\s+{_KW}\b(?!\s*\()"
# Signs come first and words are only looked up where one begins, which saves most attempts.
_TOKENS = rf"(?U){KEPT_SIGNS}|(?=[A-Z])\b(?:(?<!\.){_KW}\b|{_FN}(?=\s*\())"


def strip_quoted(sql: Column) -> Column:
    """Drop quoted parts, one kind of quote after the other (the order matters)."""
    for quoted in QUOTED:
        sql = F.regexp_replace(sql, quoted, "")
    return sql


def upper_sql(sql: Column) -> Column:
    return F.upper(sql)


def normalise_ops(sql: Column) -> Column:
    """Every comparison and arithmetic sign but ``*`` becomes ``=``."""
    return F.regexp_replace(sql, EQUALISED, "=")


def drop_reserved_table(sql: Column) -> Column:
    """A reserved word in table position is a table name, so it goes too."""
    return F.regexp_replace(sql, _TABLE_NAME, "$1 ")


def template_tokens(sql: Column) -> Column:
    return F.regexp_extract_all(sql, F.lit(_TOKENS), F.lit(0))


def sql_template(sql: Column) -> Column:
    """Keywords, called functions, brackets and signs in order, one space apart."""
    prepared = drop_reserved_table(normalise_ops(upper_sql(strip_quoted(sql))))
    return F.array_join(template_tokens(prepared), " ")


def is_generated(
    source_query: Column, target_query: Column, target_question: Column, strict_null: bool = False
) -> Column:
    """Did the model give a query? Null, ``SELECT NULL`` and its apology are a no.

    ``strict_null`` also turns away the bare word ``null``, which passes by default.
    """
    bare = F.regexp_replace(F.lower(target_query), r"(?U)^\s+|\s+$", "")
    refused = [NULL_SELECT, "null"] if strict_null else [NULL_SELECT]
    apology = F.lit(UNTRANSLATED)
    return (
        source_query.isNotNull()
        & target_query.isNotNull()
        & ~F.coalesce(bare.isin(refused), F.lit(False))
        & ~F.contains(F.coalesce(target_question, F.lit("")), apology)
        & ~F.coalesce(F.contains(target_query, apology), F.lit(False))
    )


def as_flag(condition: Column) -> Column:
    """Labels are kept as the texts ``True`` and ``False``."""
    return F.when(condition, "True").otherwise("False")
