"""Tag-map column functions.

Tags are ``map<string,string>`` columns.  Every function here is a built-in
Spark expression (no Python UDF).  Those applied per usage or resource row
(ordering key, missing tags, tag count, parsing) avoid lambda functions and are
code-generated; the lambda-based ones (canonical text, merge, editor pairs) are
used on results, tag-change requests and inventories.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MERGE, REMOVE, REPLACE
from ..sources.schemas import TAGS



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_tags() -> Column:
    return F.create_map().cast(TAGS)


def tags_literal(tags: Mapping[str, str] | None) -> Column:
    """A Python dict as a map column."""
    if not tags:
        return empty_tags()
    parts = []
    for k, v in tags.items():
        parts += [F.lit(str(k)), F.lit(None if v is None else str(v))]
    return F.create_map(*parts).cast(TAGS)


def tags_or_empty(tags) -> Column:
    """``tags or {}``: a NULL map becomes the empty map."""
    return F.coalesce(_col(tags), empty_tags())


def tags_text(tags) -> Column:
    """Canonical text of a tag map: ``k=v`` pairs sorted and joined by ``;``.

    Independent of key order: a portable rendering of the map for output and
    cross-engine comparison.  NULL map -> NULL, empty map -> ''.
    """
    pairs = F.transform(F.map_entries(_col(tags)),
                        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(pairs), ";")


def parse_tags(text) -> Column:
    """Tag text -> map.

    NULL or '' -> {}; a CSV-style value wrapped in quotes with doubled inner
    quotes (``"{""k"":""v""}"``) is unwrapped first; text that does not parse
    as a JSON object -> {}.  Non-string JSON values are kept as their text.
    """
    s = _col(text)
    wrapped = s.startswith('"{') & s.endswith('}"')
    body = F.when(wrapped, F.regexp_replace(F.regexp_extract(s, r'(?s)^"(.*)"$', 1), '""', '"')).otherwise(s)
    # read as the one element of an array, so that text after the object makes it malformed
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{TAGS.simpleString()}>",
                      {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.coalesce(F.when(F.size(one) == 1, F.get(one, F.lit(0))), empty_tags())


def merge_tags(old, new, operation: str = MERGE) -> Column:
    """I8: apply a tag change to a map.

    ``replace`` -> the new map; ``remove`` -> old without the new map's keys;
    anything else (``merge``) -> old updated by new (new values win).
    A NULL old map counts as empty.
    """
    old_c, new_c = tags_or_empty(old), tags_or_empty(new)
    kept = F.map_filter(old_c, lambda k, v: ~F.map_contains_key(new_c, k))
    if operation == REPLACE:
        return new_c
    if operation == REMOVE:
        return kept
    return F.map_concat(kept, new_c)


def missing_tags(tags, required: Sequence[str]) -> Column:
    """Required keys absent from the map, in the order given (repeats kept).

    Built per key from code-generated expressions (no lambda function).
    """
    if not required:
        return F.array().cast("array<string>")
    present = tags_or_empty(tags)
    return F.array_compact(F.array(*[F.when(~F.map_contains_key(present, F.lit(t)), F.lit(t)) for t in required]))


def tag_count(tags) -> Column:
    """``len(tags or {})``."""
    return F.size(tags_or_empty(tags))


def strip(text: Column) -> Column:
    """Text without white space (tabs and line ends included) at either end."""
    return F.regexp_replace(text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def required_tag_list(text) -> Column:
    """Comma-separated text -> trimmed, non-blank list of tag keys."""
    return F.filter(F.transform(F.split(_col(text), ","), strip), lambda t: t != "")


def clean_tag_pairs(pairs) -> Column:
    """I16: edited ``array<struct<key,value>>`` -> map.

    Keys and values are trimmed, pairs with a blank key or value are dropped and
    a later pair overrides an earlier one with the same key.
    """
    trimmed = F.transform(_col(pairs), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    nonblank = F.filter(trimmed, lambda e: (F.coalesce(e["key"], F.lit("")) != "")
                        & (F.coalesce(e["value"], F.lit("")) != ""))
    last_wins = F.filter(nonblank, lambda e, i: ~F.exists(
        F.slice(nonblank, i + 2, F.greatest(F.size(nonblank) - i - 1, F.lit(0))),
        lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last_wins), empty_tags())

