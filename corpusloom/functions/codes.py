"""Column functions on classification codes such as SN12a."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACES, WS, _col, blank_to_null

_WORD = r"[\p{L}\p{N}_]"
_TOKEN = r"^([A-Za-z]+)(\d+)([A-Za-z]*)"


def extract_codes(c: Column | str, *prefixes: str) -> Column:
    """Sorted distinct codes `<prefix><digits><letters>` standing as words in a text, in any case."""
    found = [_codes_with(prefix, _col(c)) for prefix in prefixes]
    return F.sort_array(F.array_distinct(found[0] if len(found) == 1 else F.concat(*found)))


def _codes_with(prefix: str, text: Column) -> Column:
    pattern = rf"(?i)(?<!{_WORD}){re.escape(prefix)}\d+[A-Za-z]*(?!{_WORD})"
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    head, start = F.lit(prefix.upper()), F.lit(len(prefix) + 1)
    return F.transform(hits, lambda x: F.concat(head, F.lower(F.substr(x, start))))


def coerce_codes(c: Column | str) -> Column:
    """Sorted distinct codes of a comma/space separated string; a token counts by its leading part."""
    return coerce_code_list(F.array(_col(c)))


def coerce_code_list(c: Column | str) -> Column:
    """As `coerce_codes`, for an array of such strings."""
    items = F.filter(F.coalesce(_col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    tokens = F.flatten(F.transform(items, lambda x: F.split(x, rf"(?:,|{WS})+")))
    codes = F.transform(
        tokens,
        lambda x: F.concat(
            F.upper(F.regexp_extract(x, _TOKEN, 1)),
            F.regexp_extract(x, _TOKEN, 2),
            F.lower(F.regexp_extract(x, _TOKEN, 3)),
        ),
    )
    return F.sort_array(F.array_distinct(F.filter(codes, lambda x: x != "")))


def resolve_codes(explicit: Column, header: Column | str, body: Column | str, prefix: str) -> Column:
    """The explicit codes when there are any, else those found in header and body."""
    found = extract_codes(F.concat_ws("\n", _col(header), _col(body)), prefix)
    return F.when(F.size(explicit) > 0, explicit).otherwise(found)


def strip_trailing_codes(header: Column | str, *prefixes: str) -> Column:
    """A header without its final `(SN.., DE..)` group and the dash before it; never empty."""
    h = _col(header)
    code = rf"(?:{'|'.join(re.escape(p) for p in prefixes)})\d+[A-Za-z]*"
    group = rf"(?i){WS}*\({WS}*{code}{WS}*(?:,{WS}*{code}{WS}*)*\){WS}*\z"
    cut = F.rtrim(F.regexp_replace(h, group, ""), F.lit(SPACES))
    cut = F.rtrim(F.rtrim(cut, F.lit("-–— ")), F.lit(SPACES))
    return F.coalesce(F.nullif(cut, F.lit("")), h)


def natural_code_key(c: Column | str) -> Column:
    """Sort key (prefix, number, suffix), so that SN2 comes before SN10."""
    code = _col(c)
    pattern = r"(?s)^([A-Za-z]+)(\d+)(.*)"
    number = F.regexp_extract(code, pattern, 2).try_cast("decimal(38,0)")
    matched = code.rlike(pattern)
    return F.struct(
        F.when(matched, F.regexp_extract(code, pattern, 1)).otherwise(code).alias("prefix"),
        F.when(matched, number).otherwise(F.lit(0)).cast("decimal(38,0)").alias("number"),
        F.when(matched, F.regexp_extract(code, pattern, 3)).otherwise(F.lit("")).alias("suffix"),
    )


def match_search(query: str, *columns: Column | str) -> Column:
    """Case-insensitive substring search; a blank query matches everything."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(_col(c)).contains(q), F.lit(False))
    return hit


def facet_filter(codes: Column | str, active: list[str], *, allow_all_when_empty: bool = True) -> Column:
    """True when the row holds an active code; with none active, all rows or no row by the flag."""
    if not active:
        return F.lit(allow_all_when_empty)
    wanted = F.array(*[F.lit(code) for code in active])
    return F.coalesce(F.arrays_overlap(_col(codes), wanted), F.lit(False))


def code_label(codes: Column | str) -> Column:
    """The codes joined by commas, `-` when there are none."""
    return F.coalesce(blank_to_null(F.array_join(_col(codes), ",")), F.lit("-"))

