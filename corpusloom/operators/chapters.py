"""Themes and chapters as long membership tables: (chapter_pos, chapter_id, title, num, num_pos)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import blank_to_null, build_title, clean_body, is_blank, latex_escape, let, strip, to_integer
from corpusloom.operators.alignment import join_null_safe, renumber
from corpusloom.session import materialise

# Titles and ids of the catch-all chapters.
OTHER = "Other"
ALL_TEXTS_ID, ALL_TEXTS_TITLE = "All_Texts", "All Texts"

# Places after every numbered chapter: the catch-all of small themes, then the orphans.
LAST_CHAPTER = 2**31 - 1
ORPHANS_CHAPTER = 2**31

# Themes in one list of a keyword, and counts that a task holds at a time.
THEMES, PLACES = 1000, 2**20


def theme_members(assignments: DataFrame) -> DataFrame:
    """Distinct (theme, num); blank themes and ids that are no integers are skipped."""
    rows = assignments.select(strip("theme").alias("theme"), to_integer(F.col("id").cast("string")).alias("num"))
    return rows.where(~is_blank("theme") & F.col("num").isNotNull()).distinct()


def theme_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("theme").agg(F.count(F.lit(1)).alias("n_texts"))


def number_chapters(themes: DataFrame) -> DataFrame:
    """(theme, chapter_pos, chapter_id) with themes in name order: Theme_<i>_<first 40 characters, _ for spaces>."""
    numbered = renumber(themes.select("theme").distinct(), ["theme"], "chapter_pos")
    slug = F.substring(F.replace("theme", F.lit(" "), F.lit("_")), 1, 40)
    return numbered.select(
        "theme", "chapter_pos", F.concat(F.lit("Theme_"), F.col("chapter_pos"), F.lit("_"), slug).alias("chapter_id")
    )


def merge_small_groups(members: DataFrame, threshold: int, title: str = OTHER) -> DataFrame:
    """Members of themes with fewer than `threshold` texts move to one catch-all theme; 0 moves none."""
    if threshold <= 0:
        return members.withColumn("merged", F.lit(False))
    # Written, so that the planner sees whether the list is small enough to spare the members a shuffle by theme.
    small = materialise(theme_sizes(members).where(F.col("n_texts") < threshold).select("theme"), "small")
    flagged = members.join(small.withColumn("merged", F.lit(True)), "theme", "left")
    flagged = flagged.withColumn("merged", F.coalesce("merged", F.lit(False)))
    return flagged.withColumn("theme", F.when(F.col("merged"), title).otherwise(F.col("theme"))).distinct()


def chapters_from_themes(members: DataFrame, threshold: int = 0, title: str = OTHER) -> DataFrame:
    """The chapter membership table; the catch-all chapter comes last."""
    sizes = materialise(theme_sizes(members), "themes")
    sized = number_chapters(sizes).join(sizes, "theme")
    merged = F.col("n_texts") < threshold
    # One row per theme, written for its size to be known: the members need no shuffle if it is small.
    chapters = materialise(
        sized.select(
            "theme",
            F.when(merged, F.lit(LAST_CHAPTER).cast("long")).otherwise(F.col("chapter_pos")).alias("chapter_pos"),
            F.when(merged, OTHER).otherwise(F.col("chapter_id")).alias("chapter_id"),
            F.when(merged, title).otherwise(F.col("theme")).alias("title"),
            merged.alias("merged"),
        ),
        "chapters",
    )
    placed = members.join(chapters, "theme").select(
        "chapter_pos", "chapter_id", "title", "num", F.col("num").alias("num_pos"), "merged"
    )
    # Members are distinct per theme; only the catch-all chapter can hold a number twice.
    return placed.where("not merged").drop("merged").unionByName(placed.where("merged").drop("merged").distinct())


def single_chapter(corpus: DataFrame, order: list[str]) -> DataFrame:
    """One chapter with the numbers 1..N for the N texts of the corpus."""
    numbered = renumber(corpus.select(*order), order, "num")
    return numbered.select(
        F.lit(1).cast("long").alias("chapter_pos"), F.lit(ALL_TEXTS_ID).alias("chapter_id"),
        F.lit(ALL_TEXTS_TITLE).alias("title"), "num", F.col("num").alias("num_pos"),
    )


def get_chapter(chapters: DataFrame, chapter_id: str) -> DataFrame:
    """The members of one chapter; ValueError when there is none."""
    found = chapters.where(F.col("chapter_id") == chapter_id)
    if found.isEmpty():
        raise ValueError(f"no chapter {chapter_id!r}")
    return found


def chapter_title(chapter: Column) -> Column:
    """Title, else theme, else name, else id, else `Chapter`."""
    filled = [F.nullif(chapter[k], F.lit("")) for k in ("title", "theme", "name", "chapter_id")]
    return F.coalesce(blank_to_null(F.coalesce(*filled, F.lit("Chapter"))), F.lit("Chapter"))


def chapter_members(documents: DataFrame, corpus: DataFrame, key: str = "num", offset: str | None = None) -> DataFrame:
    """Membership rows of parsed chapter documents (column `doc`): entries that are no known number are skipped,
    and a number stays in the first chapter that claims it.

    `offset` names a column with the position of a document's first chapter, for chapters spread over documents.
    """
    base = F.col(offset) if offset else F.lit(0)
    # The outer form and a test afterwards: the plain form would test the parsed lists beforehand and parse twice.
    chapters = documents.select(base.alias("base"), F.posexplode_outer("doc.chapters").alias("pos", "chapter"))
    rows = chapters.where("pos is not null").select(
        (F.col("base") + F.col("pos")).cast("long").alias("chapter_pos"), F.col("chapter.chapter_id").alias("chapter_id"),
        chapter_title(F.col("chapter")).alias("title"),
        F.posexplode_outer("chapter.num_list").alias("num_pos", "entry"),
    )
    known = rows.withColumn(key, to_integer("entry")).drop("entry").where(F.col(key).isNotNull())
    return first_claim(known.join(corpus.select(key), key, "left_semi"), key)


def first_claim(members: DataFrame, key: str = "num") -> DataFrame:
    """One row per number: its place in the first chapter listing it. Combined before the shuffle, so a number
    listed very often does no harm."""
    place = F.struct("chapter_pos", "num_pos", "chapter_id", "title")
    first = members.groupBy(key).agg(F.min(place).alias("p"))
    return first.select("p.chapter_pos", "p.chapter_id", "p.title", key, "p.num_pos")


def chapter_descriptions(chapters: DataFrame, themes: DataFrame) -> DataFrame:
    """Chapters with the description of the theme of the same name, '' when there is none."""
    named = (
        themes.select(strip("name").alias("title"), strip("description").alias("description"))
        .where("title <> ''").groupBy("title").agg(F.max("description").alias("description"))
    )
    return chapters.join(named, "title", "left").withColumn("description", F.coalesce("description", F.lit("")))


def orphans(corpus: DataFrame, members: DataFrame, key: str = "num") -> DataFrame:
    """Corpus rows in no chapter, as members of the last chapter."""
    rest = corpus.select(key).join(members.select(key), key, "left_anti")
    return rest.select(
        F.lit(ORPHANS_CHAPTER).cast("long").alias("chapter_pos"), F.lit(OTHER).alias("chapter_id"), F.lit(OTHER).alias("title"),
        key, F.col(key).alias("num_pos"),
    )


def merge_catalogue(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Themes of both tables, one per name: the existing one, else the earliest proposal (`seq`)."""
    a = existing.select("name", "description", F.lit(0).cast("long").alias("round"), F.lit(0).cast("long").alias("seq"))
    b = proposed.select("name", "description", F.lit(1).cast("long").alias("round"), F.col("seq").cast("long").alias("seq"))
    first = F.min(F.struct("round", "seq", "description")).alias("f")
    return a.unionByName(b).where(~is_blank("name")).groupBy("name").agg(first).select(
        "name", "f.description", (F.col("f.round") == 1).alias("is_new")
    )


def complete_variants(variants: DataFrame, text: str = "generated_text") -> DataFrame:
    """Rows of the variants that have no blank text at all."""
    whole = variants.groupBy("variant").agg(F.bool_and(~is_blank(text)).alias("whole")).where("whole")
    # Written: a list of known size lets the variants, of which one may be very large, stay where they are.
    return variants.join(materialise(whole.select("variant"), "whole"), "variant", "left_semi")


def keyword_themes(items: DataFrame, text_tokens: Column, keys: list[str], themes: DataFrame) -> DataFrame:
    """The theme (theme, keyword) sharing most distinct keywords with each item; ties go to the first name.

    Items without any keyword are absent; rows with equal keys count together. A keyword brings the numbers of its themes as
    lists, and the counts of an item are one row from then on: tasks add up rows that follow each other, whatever their
    number, so that a task holds what it sorts, an item's list once. Keys are of atomic types.
    """
    numbered = materialise(renumber(themes.select("theme").distinct(), ["theme"], "__number", start=0), "themes")
    pairs = join_null_safe(themes.select("theme", "keyword").distinct(), numbered, ["theme"])
    block = F.floor(F.col("__number") / THEMES)
    listed = F.collect_list(F.col("__number").cast("int")).alias("__themes")
    catalogue = materialise(pairs.groupBy("keyword", block).agg(listed).select("keyword", "__themes"), "keywords")
    words = items.select(*keys, F.explode(F.array_distinct(text_tokens)).alias("keyword"))
    ones = F.array_repeat(F.lit(1).cast("long"), F.size("__themes")).alias("__counts")
    hits = words.join(catalogue, "keyword").select(*keys, "__themes", ones)
    fields = [T.StructField(k, items.schema[k].dataType) for k in keys]
    counts = [T.StructField("__themes", T.ArrayType(T.IntegerType())), T.StructField("__counts", T.ArrayType(T.LongType()))]
    once = hits.mapInArrow(partial(_added, keys=keys, best=False), T.StructType(fields + counts))
    together = once.repartition(*keys).sortWithinPartitions(*keys)
    winner = [T.StructField("__number", T.IntegerType()), T.StructField("score", T.LongType())]
    best = together.mapInArrow(partial(_added, keys=keys, best=True), T.StructType(fields + winner))
    return best.join(numbered, "__number").select(*keys, "theme", "score")


def _added(batches: Iterator[pa.RecordBatch], keys: list[str], best: bool) -> Iterator[pa.RecordBatch]:
    """Rows (keys, themes, counts) of equal keys that follow each other as one, with each theme once; or, of `best`, (keys,
    theme, count) with the highest count, of equal ones the first theme."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if left is not None:
            rows = pa.concat_tables([left.cast(rows.schema), rows])
        rows = rows.combine_chunks()
        if not len(rows):
            continue
        begins = np.flatnonzero(np.r_[True, _changes(rows, keys)])
        # The last rows may go on in the next batch.
        if len(begins) > 1:
            yield from _sums(rows.slice(0, begins[-1]), begins[:-1], keys, best)
        (left,) = (pa.Table.from_batches([b]) for b in _sums(rows.slice(begins[-1]), np.array([0]), keys, False))
    if left is not None:
        yield from _sums(left, np.array([0]), keys, best)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has other keys than the one before it; a null equals a null."""
    changed = np.zeros(len(rows) - 1, bool)
    for k in keys:
        before, here = rows[k].slice(0, len(rows) - 1), rows[k].slice(1)
        same = pc.fill_null(pc.equal(before, here), False)
        same = pc.or_(same, pc.and_(pc.is_null(before, nan_is_null=True), pc.is_null(here, nan_is_null=True)))
        changed |= ~same.to_numpy()
    return changed


def _sums(rows: pa.Table, begins: np.ndarray, keys: list[str], best: bool) -> Iterator[pa.RecordBatch]:
    themes, counts = (rows[c].combine_chunks() for c in ("__themes", "__counts"))
    flat, n = themes.flatten().to_numpy(), counts.flatten().to_numpy()
    sizes = pc.list_value_length(themes).to_numpy()
    ends = np.cumsum(sizes)[np.r_[begins[1:], len(rows)] - 1]
    # Each group of rows has a place for each theme; few groups at a time.
    many = int(flat.max()) + 1
    step = max(1, PLACES // many)
    found = []
    for a in range(0, len(begins), step):
        low, high = ends[a - 1] if a else 0, ends[min(a + step, len(begins)) - 1]
        lengths = np.diff(np.r_[low, ends[a : a + step]])
        place = np.repeat(np.arange(len(lengths)), lengths) * many + flat[low:high]
        # Counts are far below 2^53, so that sums of doubles are exact.
        total = np.bincount(place, n[low:high], len(lengths) * many).reshape(len(lengths), many)
        if best:
            top = total.argmax(axis=1)
            found.append((top, total[np.arange(len(total)), top]))
        else:
            group, theme = np.nonzero(total)
            found.append((np.bincount(group, minlength=len(lengths)), theme, total[group, theme]))
    first = [rows[k].combine_chunks().take(pa.array(begins)) for k in keys]
    if best:
        theme, score = map(np.concatenate, zip(*found))
        made = [pa.array(theme.astype(np.int32)), pa.array(score.astype(np.int64))]
        names = ["__number", "score"]
    else:
        lengths, theme, score = map(np.concatenate, zip(*found))
        offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (theme.astype(np.int32), score.astype(np.int64))]
        names = ["__themes", "__counts"]
    yield pa.RecordBatch.from_arrays([*first, *made], [*keys, *names])


# --- the book -----------------------------------------------------------------------------------------------------


def _chapter_lines(title: Column, description: Column, numbered: bool) -> Column:
    t = latex_escape(title)

    def lines(name: Column) -> Column:
        if numbered:
            head = [F.concat(F.lit("\\chapter{"), name, F.lit("}"))]
        else:
            head = [
                F.concat(F.lit("\\chapter*{"), name, F.lit("}")),
                F.concat(F.lit("\\addcontentsline{toc}{chapter}{"), name, F.lit("}")),
                F.concat(F.lit("\\markboth{"), name, F.lit("}{"), name, F.lit("}")),
            ]
        quote = F.concat(F.lit("\\begin{quote}\\small "), latex_escape(description), F.lit("\\end{quote}"))
        extra = F.when(is_blank(description), F.array().cast("array<string>")).otherwise(F.array(quote, F.lit("")))
        return F.concat(F.array(*head, F.lit("")), extra)

    return let(t, lines)


def _section_lines(heading: Column, body: Column) -> Column:
    return let(
        heading,
        lambda h: F.array(
            F.concat(F.lit("\\section*{"), h, F.lit("}")),
            F.concat(F.lit("\\addcontentsline{toc}{section}{"), h, F.lit("}")),
            F.lit(""), latex_escape(body), F.lit(""),
        ),
    )


def book_sections(
    corpus: DataFrame, members: DataFrame | None, descriptions: DataFrame | None = None, *,
    heads: DataFrame | None = None, show_codes: bool = True, chapter_numbers: bool = True, entry_numbers: bool = True,
    orphans_chapter: bool = True,
) -> DataFrame:
    """The book as (chapter_pos, num_pos, lines): a row per chapter head, at num_pos -1, and per text.

    `corpus`: num, topic, advice, code columns code_sn and code_de, body. Without members the texts follow flat.
    `heads` (chapter_pos, title) adds the chapters that kept no text.
    """
    codes = ["code_sn", "code_de"] if show_codes else []
    title = latex_escape(build_title("num", "advice", "topic", codes))
    heading = F.concat(F.col("num").cast("string"), F.lit(". "), title) if entry_numbers else title
    # A blank body gives no lines; a filter would be pushed down and clean every body twice.
    section = let(clean_body("body"), lambda b: F.when(b != "", _section_lines(heading, b)))
    if members is None:
        return corpus.select(F.lit(0).cast("long").alias("chapter_pos"), F.col("num").alias("num_pos"), section.alias("lines"))
    columns = ["chapter_pos", "title", "num", "num_pos"]
    members = materialise(members.select(*columns), "members")
    if orphans_chapter:
        members = members.unionByName(orphans(corpus, members).select(*columns))
    named = members.select("chapter_pos", "title")
    if heads is not None:
        named = named.unionByName(heads.select("chapter_pos", "title"))
    heads = named.groupBy("chapter_pos").agg(F.max("title").alias("title"))
    heads = chapter_descriptions(heads, descriptions) if descriptions is not None else heads.withColumn(
        "description", F.lit("")
    )
    head_rows = heads.select(
        "chapter_pos", F.lit(-1).cast("long").alias("num_pos"),
        _chapter_lines(F.col("title"), F.col("description"), chapter_numbers).alias("lines"),
    )
    # Raw texts are joined; their lines are made behind the join.
    places = members.select("chapter_pos", "num", F.col("num_pos").cast("long").alias("num_pos"))
    body_rows = places.join(corpus, "num").select("chapter_pos", "num_pos", section.alias("lines"))
    return head_rows.unionByName(body_rows)


def book_lines(corpus: DataFrame, members: DataFrame | None, descriptions: DataFrame | None = None, **options) -> DataFrame:
    """The book as lines in order of (chapter_pos, num_pos, line_no); see `book_sections`."""
    sections = book_sections(corpus, members, descriptions, **options)
    return sections.select("chapter_pos", "num_pos", F.posexplode("lines").alias("line_no", "line"))
