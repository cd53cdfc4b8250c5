"""Theme assignments to chapters to an ordered book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import chapters as ch
from corpusloom.operators import parsing as ps
from corpusloom.sources import sinks


def chapters_from_answers(answers: DataFrame, keys: list[str], threshold: int = 0) -> DataFrame:
    """The membership table from parsed assignment answers."""
    return ch.chapters_from_themes(ch.theme_members(ps.assignments(answers, keys)), threshold)


def write_book(
    corpus: DataFrame, members: DataFrame | None, path: str, descriptions: DataFrame | None = None,
    partitions: int | None = None, **options,
) -> None:
    """The book's lines as text files whose name order is the book's order."""
    sections = ch.book_sections(corpus, members, descriptions, **options).where("lines is not null")
    rows = sections.select("chapter_pos", "num_pos", F.array_join("lines", "\n").alias("line"))
    sinks.write_ordered_text(rows, path, ["chapter_pos", "num_pos"], partitions)
