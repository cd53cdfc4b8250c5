"""Table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names and their order in the exchanged files.
ADVICE_COLUMNS = ["Num", "Topic", "Advice", "Sentence"]
MAPPING_COLUMNS = ["Num", "Code_SN", "Code_DE"]
CONTEXT_COLUMNS = ["Num", "Character", "Presence", "Location", "Sensation", "Time", "Moment", "First_Name"]
SN_COLUMNS = ["Code", "Name", "Narrative_Structure"]
DE_COLUMNS = ["Code", "Name", "Emotional_Sequence"]
STRUCTURAL_COLUMNS = ["Op_ID", "Signature", "Level", "Function", "Keyp", "Oplus"]
STYLISTIC_COLUMNS = ["Op_ID", "Signature", "Level", "Scope", "Function"]
CORPUS_COLUMNS = ["Num", "Text", "Advice", "Chapter"]
VARIANT_COLUMNS = ["Num", "Generated_Text"]

ADVICE = _strings(*ADVICE_COLUMNS)
MAPPING = _strings(*MAPPING_COLUMNS)
CONTEXT = _strings(*CONTEXT_COLUMNS)
SN = _strings(*SN_COLUMNS)
DE = _strings(*DE_COLUMNS)
STRUCTURAL = _strings(*STRUCTURAL_COLUMNS)
STYLISTIC = _strings(*STYLISTIC_COLUMNS)
CORPUS = _strings(*CORPUS_COLUMNS)
VARIANT = _strings(*VARIANT_COLUMNS)

THEMES_JSON = "struct<themes:array<struct<name:string,description:string,keywords:array<string>>>>"
ASSIGNMENTS_JSON = (
    "struct<assignments:array<struct<id:string,theme:string>>,"
    "new_themes:array<struct<name:string,description:string>>,_corrupt:string>"
)
CHAPTERS_JSON = (
    "struct<chapters_set_name:string,source:string,chapters:array<struct<"
    "chapter_id:string,title:string,theme:string,name:string,num_list:array<string>>>>"
)


def check_columns(df: DataFrame, expected: list[str], mode: str = "raise") -> list[str]:
    """Compare the header of `df` with `expected`; no job is run.

    mode "raise": exact list or ValueError; "require": every expected column present or ValueError;
    "warn": return the differences only.
    """
    return check_names(df.columns, expected, mode)


def check_names(columns: list[str], expected: list[str], mode: str = "raise") -> list[str]:
    """As `check_columns`, for a list of names."""
    found = [name.lstrip("\ufeff").strip() for name in columns]
    missing = [name for name in expected if name not in found]
    extra = [name for name in found if name not in expected]
    if mode == "raise" and found != expected:
        raise ValueError(f"header mismatch: expected {expected}, found {found}")
    if mode == "require" and missing:
        raise ValueError(f"missing columns {missing}, found {found}")
    return [f"missing {name}" for name in missing] + [f"extra {name}" for name in extra]


def pick_column(df: DataFrame, preferred: str, fallback: str) -> str:
    """`preferred` when present, else `fallback`, else ValueError."""
    for name in (preferred, fallback):
        if name in df.columns:
            return name
    raise ValueError(f"neither {preferred!r} nor {fallback!r} in {df.columns}")
