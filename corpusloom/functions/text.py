"""Column functions on text: blankness, lines, punctuation, escaping, titles, slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of a Unicode-aware strip/split, as characters and as a regex class body.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_SPACE_CLASS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
SPACE_CLASS = ASCII_SPACE_CLASS + r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_SPACES = "".join(ch for ch in SPACES if ord(ch) > 127)
WS = f"[{SPACE_CLASS}]"
NOT_WS = f"[^{SPACE_CLASS}]"
# Line breaks other than the newline.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Typographic characters and their plain replacements, position by position.
FANCY = "\u2018\u2019\u201c\u201d\u00b4\u0060\u2013\u2014\u00a0\u0091\u0092"
PLAIN = "''\"\"''-- ''"
ELLIPSIS = "\u2026"
# Dropped control characters, all below the space but newline and tab.
CONTROLS = "".join(chr(i) for i in range(32) if chr(i) not in "\n\t")

# Macros for the characters that have no backslash form.
MACROS = {"\x01": r"\textbackslash{}", "\x02": r"\textasciitilde{}", "\x03": r"\textasciicircum{}"}

# Tags a generated text may start with, and quote characters around it.
TAGS = ("SN", "DE", "K", "STYLE", "VARIANT", "NEUTRAL")
BODY_TRIM = ' \n"“”«»'
TITLE_TRIM = " \t-–—.:"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def bound(c: Column | str, body: Callable[[Column], Column]) -> Column:
    """As `let`; a column name needs no binding."""
    return body(F.col(c)) if isinstance(c, str) else let(c, body)


def strip(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(SPACES))


def fold_spaces(c: Column | str) -> Column:
    """Every non-ASCII space as a plain one, so that cheap ASCII classes can split the text; lengths are kept."""

    def fold(text: Column) -> Column:
        # The range holds all wide spaces, and few texts hold anything of it.
        folded = F.translate(text, WIDE_SPACES, " " * len(WIDE_SPACES))
        return F.when(text.rlike("[\\x85\\xa0\\u1680-\\u3000]"), folded).otherwise(text)

    return bound(c, fold)


def to_integer(c: Column | str) -> Column:
    """A whole number written as text, blanks around it allowed; null when it is none."""
    # The cast trims ASCII blanks by itself; only what it refuses is stripped of wider ones.
    return bound(c, lambda t: F.coalesce(t.try_cast("long"), F.trim(t, F.lit(SPACES)).try_cast("long")))


def is_blank(c: Column | str) -> Column:
    """Null or nothing but white space; reads no further than the first other character."""
    return ~F.coalesce(_col(c).rlike(NOT_WS), F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def unix_lines(c: Column | str) -> Column:
    """Every kind of line break as a newline."""

    def fold(text: Column) -> Column:
        folded = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS))
        return F.when(text.rlike(f"[{OTHER_BREAKS}]"), folded).otherwise(text)

    return bound(c, fold)


def split_lines(c: Column | str) -> Column:
    """Lines without their breaks; a final break opens no further line."""

    def lines(t: Column) -> Column:
        return F.split(F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t), "\n")

    return let(unix_lines(c), lines)


def coalesce_text(variant: Column | str, neutral: Column | str) -> Column:
    """The variant text unless blank, else the neutral text, else ''."""
    return F.when(~is_blank(variant), _col(variant)).otherwise(F.coalesce(_col(neutral), F.lit("")))


def flag_bad(*columns: Column | str) -> Column:
    """True when any column holds a word starting with the placeholder mark BAD_, in any case."""
    hits = [F.coalesce(_col(c).cast("string").rlike(r"(?i)\bBAD_"), F.lit(False)) for c in columns]
    flag = hits[0]
    for hit in hits[1:]:
        flag = flag | hit
    return flag


@F.pandas_udf(StringType())
def _fold_to_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    )


def slugify(c: Column | str, max_len: int = 30) -> Column:
    """Lower-case ASCII slug; a longer one is cut and gets six hex digits of the full slug's SHA-1.

    Only texts with a non-ASCII character reach Python, and only for the folding.
    """
    source = _col(c)
    foreign = source.rlike(r"[^\x00-\x7f]")
    folded = F.when(foreign, _fold_to_ascii(F.when(foreign, source))).otherwise(source)
    # Everything between words, spaces included, counts as one space, and inner spaces become hyphens.
    slug = F.array_join(F.array_remove(F.split(F.lower(folded), "[^a-z0-9-]+"), ""), "-")

    def shorten(s: Column) -> Column:
        head = F.rtrim(F.substring(s, 1, max_len - 7), F.lit("-"))
        digest = F.substring(F.sha1(s.cast("binary")), 1, 6)
        return F.when(F.length(s) > max_len, F.concat(head, F.lit("-"), digest)).otherwise(s)

    return let(slug, shorten)


def dataset_name(kind: Column | str, stage: str, topic: Column | str) -> Column:
    """`<Kind>_<stage>_<slug>.csv`."""
    k = _col(kind)
    head = F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substr(k, F.lit(2))))
    return F.concat(head, F.lit(f"_{stage}_"), slugify(topic), F.lit(".csv"))


def normalize_punct(c: Column | str) -> Column:
    """Typographic punctuation to ASCII; control characters dropped. Texts without any are not touched."""

    def plain(text: Column) -> Column:
        out = F.replace(F.translate(text, FANCY + CONTROLS, PLAIN), F.lit(ELLIPSIS), F.lit("..."))
        return F.when(text.rlike(rf"[\x00-\x08\x0b-\x1f{FANCY}{ELLIPSIS}]"), out).otherwise(text)

    return bound(c, plain)


def latex_escape(c: Column | str) -> Column:
    """Plain text safe inside LaTeX. Control characters are gone by then, so three of them stand in."""

    def escape(t: Column) -> Column:
        marked = F.translate(t, "\\~^", "\x01\x02\x03")
        for ch in "&%$#_{}":
            marked = F.replace(marked, F.lit(ch), F.lit("\\" + ch))
        for mark, macro in MACROS.items():
            marked = F.replace(marked, F.lit(mark), F.lit(macro))
        return F.when(t.rlike(r"[&%$#_{}\\~^]"), marked).otherwise(t)

    return let(normalize_punct(c), escape)


def clean_body(c: Column | str, tags: tuple[str, ...] = TAGS) -> Column:
    """A generated body without code fence, outer quotes, trailing blanks and a leading tag."""
    names = "|".join(tags)
    tag_line = rf"(?i)^{WS}*(?:{names}){WS}*[:=\-]?{WS}*\z"
    bracket_line = rf"(?i)^{WS}*\[(?:{names})[^\]]*\]{WS}*\z"
    tag_prefix = rf"(?i)^{WS}*(?:{names}){WS}*[:=\-]{WS}*"

    def unfence(t: Column) -> Column:
        fenced = t.startswith("```") & t.endswith("```") & (F.length(t) > 6)
        return F.when(fenced, strip(F.substr(t, F.lit(4), F.length(t) - 6))).otherwise(t)

    def tidy_lines(t: Column) -> Column:
        lines = F.transform(split_lines(t), lambda line: F.rtrim(line, F.lit(SPACES)))
        return F.ltrim(F.array_join(lines, "\n"), F.lit("\n"))

    def untag(t: Column) -> Column:
        first = F.substring_index(t, "\n", 1)
        rest = F.substr(t, F.length(first) + 1)
        kept = F.concat(F.ltrim(F.regexp_replace(first, tag_prefix, ""), F.lit(SPACES)), rest)
        return F.when(first.rlike(tag_line) | first.rlike(bracket_line), rest).otherwise(kept)

    body = let(strip(_col(c)), unfence)
    body = tidy_lines(F.trim(body, F.lit(BODY_TRIM)))
    return strip(let(body, untag))


def filter_headers(c: Column | str, style: str = "full") -> Column:
    """Line filter of merged texts: "full" keeps all, "simple" drops comments, "none" drops every header."""
    dropped = {"full": (), "simple": ("%",), "none": ("\\", "%", "###")}[style]
    if not dropped:
        return _col(c)

    def keep(line: Column) -> Column:
        ok = F.lit(True)
        for mark in dropped:
            ok = ok & ~line.startswith(mark)
        return ok

    return F.array_join(F.filter(split_lines(c), keep), "\n")


def build_title(
    num: Column | str,
    advice: Column | str,
    topic: Column | str,
    codes: list[Column | str] = (),
    *,
    tidy: bool = True,
    numbered: bool = False,
) -> Column:
    """Advice, else topic, else `Text n`; then the codes; optionally `n. ` in front. Null counts as empty."""
    n = _col(num).cast("string")
    title = F.coalesce(blank_to_null(advice), blank_to_null(topic), F.concat(F.lit("Text "), n))
    if tidy:
        title = F.trim(_drop_list_mark(let(title, lambda t: _drop_own_label(t, n))), F.lit(TITLE_TRIM))
    title = F.concat_ws(" - ", title, *[blank_to_null(code) for code in codes])
    return F.concat(n, F.lit(". "), title) if numbered else title


def _drop_own_label(title: Column, n: Column) -> Column:
    label = F.regexp_extract(title, rf"(?i)^{WS}*Text{WS}*", 0)
    after = F.substr(title, F.length(label) + 1)
    rest = F.regexp_replace(F.substr(after, F.length(n) + 1), rf"^{WS}*[-–—:]?{WS}*", "")
    return F.when((label != "") & after.startswith(n), rest).otherwise(title)


def _drop_list_mark(title: Column) -> Column:
    return F.regexp_replace(title, rf"^{WS}*\d+{WS}*[.)-]{WS}*", "")


def excerpt_start(c: Column | str, n: int = 15) -> Column:
    return F.substring(_col(c), 1, n)


def excerpt_end(c: Column | str, n: int = 15) -> Column:
    return F.right(_col(c), F.lit(n))


def context_block(
    fields: dict[str, Column | str],
    codes: dict[str, Column | str],
    *,
    use_context: bool = True,
    use_codes: bool = True,
) -> Column:
    """`[SN] code` lines and one `[K] Name=value | …` line; blank parts and switched-off lines are absent."""
    lines = []
    if use_codes:
        for name, code in codes.items():
            lines.append(F.concat(F.lit(f"[{name}] "), blank_to_null(code)))
    if use_context and fields:
        parts = [F.concat(F.lit(f"{name}="), blank_to_null(value)) for name, value in fields.items()]
        joined = F.nullif(F.concat_ws(" | ", *parts), F.lit(""))
        lines.append(F.concat(F.lit("[K] "), joined))
    return F.concat_ws("\n", *lines) if lines else F.lit("")


def mean_std_label(mean: Column | str, std: Column | str) -> Column:
    """`mean (std)` with two decimals; a missing number reads `nan`."""
    return F.concat(_fixed(mean, "0.00"), F.lit(" ("), _fixed(std, "0.00"), F.lit(")"))


def percent_label(value: Column | str, *, scale: bool = True) -> Column:
    """One decimal and a percent sign; `scale` multiplies a ratio by 100; missing reads `0.0%`."""
    number = _col(value).cast("double") * (100.0 if scale else 1.0)
    return F.when(number.isNull(), "0.0%").otherwise(F.concat(_fixed(number, "0.0"), F.lit("%")))


def _fixed(value: Column | str, pattern: str) -> Column:
    # format_number rounds the exact binary value half-even, as C's printf does; format_string does not.
    number = _col(value).cast("double")
    text = F.call_function("format_number", number, F.lit(pattern))
    return F.when(number.isNull() | F.isnan(number), "nan").otherwise(text)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
