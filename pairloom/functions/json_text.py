"""Getting rows out of the JSON that models write."""

from __future__ import annotations

import json
import re
import sys
from json.decoder import scanstring

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from pairloom.functions.vocabulary import NOT_AVAILABLE

# Send the helper below to the executors as code, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_END = "end of answer"
_CLOSING = {"[": "]", "{": "}"}
_REREAD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("mended", T.BooleanType()),
        T.StructField("problem", T.StringType()),
    ]
)
_PARTS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())]))


def slice_json_array(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; empty when there is no such stretch.

    Two linear searches. A greedy pattern would start over at every ``[`` of an
    answer that never closes one.
    """
    first = F.locate("[", text)
    last = F.length(text) + 1 - F.locate("]", F.reverse(text))
    found = (first > 0) & (last >= first) & (last <= F.length(text))
    return F.when(found, text.substr(first, last - first + 1)).otherwise(F.lit(""))


def json_items(text: Column) -> Column:
    """The elements of a JSON array, null unless all of ``text`` is one.

    Spark's parser stops after the first value and ignores what follows. Reading
    the text as the first of two elements, with a marker as the second, shows
    whether anything followed. The one-element ``transform`` makes the parsed value
    a variable, so that a text is parsed once and the generated code stays small.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))

    def first(pair: Column) -> Column:
        marked = F.try_variant_get(pair, "$[1]", "string") == _END
        alone = F.try_variant_get(pair, "$[2]", "variant").isNull()
        return F.when(marked & alone, F.try_variant_get(pair, "$[0]", "array<variant>"))

    return F.get(F.transform(F.array(pair), first), F.lit(0))


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|null|true|false|NaN|-?Infinity", re.A)


def missing_commas(text: str) -> list[int]:
    """Where commas must be put in so that reading goes on, found in one pass over the text.

    A comma belongs at the end of the line before, if that has none yet, else right
    where it is missed. If that line end lies before the value that was just read,
    the comma does harm there; it is the last one, and reading the text will say so.
    """
    places: list[int] = []
    mended_lines: set[int] = set()
    open_: list[str] = []
    line_end, looked = -1, 0
    at, wants_key = _BLANK.match(text).end(), False
    while True:
        if wants_key:
            if text[at : at + 1] != '"':
                return places
            try:
                at = scanstring(text, at + 1)[1]
            except json.JSONDecodeError:
                return places
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                return places
            at = _BLANK.match(text, at + 1).end()
        sign = text[at : at + 1]
        if sign in ("[", "{") and sign:
            inner = _BLANK.match(text, at + 1).end()
            if text[inner : inner + 1] == _CLOSING[sign]:
                end = inner + 1
            else:
                open_.append(sign)
                at, wants_key = inner, sign == "{"
                continue
        elif sign == '"':
            try:
                end = scanstring(text, at + 1)[1]
            except json.JSONDecodeError:
                return places
        else:
            found = _SCALAR.match(text, at)
            if not found:
                return places
            end = found.end()
        while True:
            if not open_:
                return places
            at = _BLANK.match(text, end).end()
            if text[at : at + 1] != _CLOSING[open_[-1]]:
                break
            open_.pop()
            end = at + 1
        if text[at : at + 1] == ",":
            at = _BLANK.match(text, at + 1).end()
        else:
            line_end, looked = max(line_end, text.rfind("\n", looked, at)), at
            if line_end < 0 or (line_end < end and (text[line_end - 1] == "," or line_end in mended_lines)):
                places.append(at)
            else:
                places.append(line_end)
                mended_lines.add(line_end)
                if line_end < end:
                    return places
        wants_key = open_[-1] == "{"


def reread(text: str) -> tuple[str | None, bool, str | None]:
    """(normal form, commas added?, problem) of an answer that is not plain JSON."""
    places = missing_commas(text)
    ends = sorted(places)
    mended = ",".join(text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True))
    try:
        value = json.loads(mended, parse_constant=str)
    except json.JSONDecodeError as error:
        bad_escape = "Invalid" in error.msg and "escape" in error.msg
        return None, False, "invalid_escape" if bad_escape else "json_decode"
    except RecursionError:
        return None, False, "json_decode"
    return json.dumps(value, separators=(",", ":")), bool(places), None


@F.pandas_udf(_REREAD)
def reread_json(texts: pd.Series) -> pd.DataFrame:
    """Second reading of the few answers the native parser turned down (the rest is null)."""
    nothing = (None, False, None)
    rows = [nothing if text is None else reread(text) for text in texts]
    return pd.DataFrame(rows, columns=["text", "mended", "problem"])


@F.pandas_udf(_PARTS)
def json_parts(texts: pd.Series) -> pd.Series:
    """The elements of an array (key null) or the entries of an object, each as JSON text of its own.

    For texts too large for one variant, or turned down by the native parser; null if not readable.
    """

    def parts(text):
        if text is None:
            return None
        try:
            value = json.loads(text, parse_constant=str)
        except (json.JSONDecodeError, RecursionError):
            return None
        pairs = value.items() if isinstance(value, dict) else ((None, x) for x in value) if isinstance(value, list) else None
        return None if pairs is None else [{"key": k, "text": json.dumps(x, separators=(",", ":"))} for k, x in pairs]

    return texts.map(parts)


def has_fields(items: Column, fields) -> Column:
    """Every element is an object with exactly these keys."""
    wanted = F.lit(sorted(fields))

    def same_keys(item: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))
        return F.coalesce(F.array_sort(keys) == wanted, F.lit(False))

    return F.forall(items, same_keys)


def _is_text(item: Column, key: str, wanted: Column) -> Column:
    found = F.try_variant_get(item, f"$.{key}", "variant")
    same = (F.schema_of_variant(found) == "STRING") & (F.try_variant_get(item, f"$.{key}", "string") == wanted)
    return F.coalesce(same, F.lit(False))


def db_id_mismatches(items: Column, source_db_id: Column, target_db_id: Column | None = None) -> Column:
    """Elements with a wrong source id plus elements with a wrong target id."""

    def wrong(key: str, wanted: Column) -> Column:
        return F.size(F.filter(items, lambda item: ~_is_text(item, key, wanted)))

    count = wrong("source_db_id", source_db_id)
    if target_db_id is None:
        return count
    no_target = F.coalesce(target_db_id, F.lit("")) == ""
    return count + F.when(no_target, 0).otherwise(wrong("target_db_id", target_db_id))


def text_field(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "string")


def rating_part(item: Column, key: str, prefix: str) -> Column:
    """The named part of a rating, else its first part whose name begins alike.

    Names are looked through in alphabetical order, as variants keep them.
    """
    parts = F.try_variant_get(item, "$", "map<string,variant>")
    named = F.try_variant_get(item, f"$.{key}", "map<string,variant>")
    alike = F.map_values(F.map_filter(parts, lambda name, _: F.startswith(name, F.lit(prefix))))
    usable = F.when(F.size(named) > 0, F.try_variant_get(item, f"$.{key}", "variant"))
    return F.coalesce(usable, F.get(alike, F.lit(0)))


def rating_value(part: Column, key: str) -> Column:
    """A missing answer reads ``N/A``."""
    return F.coalesce(F.try_variant_get(part, f"$.{key}", "string"), F.lit(NOT_AVAILABLE))
