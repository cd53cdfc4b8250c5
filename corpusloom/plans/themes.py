"""Texts to themes by a model: against a catalogue, with proposals, and once more for what stayed unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, strip
from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import generation as gn
from corpusloom.operators import parsing as ps
from corpusloom.session import materialise


def _catalogue_text(catalogue: DataFrame):
    """`- name: description` lines by name. A catalogue is part of every prompt, so it is as small as a prompt."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")))
    return catalogue.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n")).scalar()


def classify_model(
    corpus: DataFrame,
    catalogue: DataFrame,
    make_model: Callable[[], gn.Model],
    *,
    store: str,
    tasks: int,
    batch_size: int = 20,
    preamble: str = "",
    retry_preamble: str = "",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(assigned, catalogue): the theme of every text (num, theme), null where the model named none that is known, and
    the catalogue (name, description, is_new) with the proposals merged in.

    All batches of the first round see the given catalogue, so the result does not depend on their order; proposals
    are merged afterwards, one per name, the first by batch. A second round asks again, with the merged catalogue, for
    the texts whose theme is in neither. Of an answer only the numbers of its own batch count. Raw answers are kept
    below `store`. Runs the model, and jobs.
    """
    texts = corpus.where(~is_blank("text")).select("num", "text")
    known = catalogue.select("name", "description")
    assigned, open_ = None, texts.select("num")
    merged = ch.merge_catalogue(known, known.where("false").withColumn("seq", F.lit(0).cast("long")))
    for round_no, lead in enumerate((preamble, "\n".join(p for p in (preamble, retry_preamble) if p)), start=1):
        numbered = materialise(al.renumber(open_, ["num"], "__row"), "open")
        planned = gn.plan_batches(texts.join(numbered, "num"), batch_size, "__row")
        head = F.concat_ws("\n\n", F.nullif(F.lit(lead), F.lit("")), _catalogue_text(merged))
        prompts = gn.build_prompts(planned, strip("text"), head, head=gn.input_head)
        prompts = materialise(prompts.select("batch_id", F.sha2("prompt", 256).alias("ask"), "prompt"), "prompts")
        answers = gn.generate_into(f"{store}/round={round_no}", prompts, make_model, ["ask"], tasks=tasks, **options)
        mine = answers.where("raw is not null").join(prompts.select("ask", "batch_id"), "ask")
        parsed = materialise(ps.parse_answers(mine, "raw", ["batch_id"]), "answers")
        proposed = ps.new_themes(parsed, ["batch_id"]).select(strip("name").alias("name"), "description", F.col("batch_id").alias("seq"))
        merged = materialise(ch.merge_catalogue(merged, proposed).join(
            merged.where("is_new").select("name", F.lit(True).alias("__before")), "name", "left"
        ).select("name", "description", (F.col("is_new") | F.coalesce("__before", F.lit(False))).alias("is_new")), "catalogue")
        named = ps.assignments(parsed, ["batch_id"]).select(
            "batch_id", F.col("id").try_cast("long").alias("num"), strip("theme").alias("theme")
        )
        own = planned.select("batch_id", "num")
        valid = named.join(own, ["batch_id", "num"], "left_semi").join(
            merged.select(F.col("name").alias("theme")), "theme", "left_semi"
        )
        found = materialise(valid.groupBy("num").agg(F.min("theme").alias("theme")), "assigned")
        assigned = found if assigned is None else assigned.unionByName(found)
        open_ = materialise(open_.join(found, "num", "left_anti"), "rest")
    return texts.select("num").join(assigned, "num", "left"), merged
