"""Batches of prompts around a user-supplied model function."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.requests import budget_flag, estimate_tokens
from corpusloom.functions.text import blank_to_null, is_blank, strip
from corpusloom.operators.alignment import best_attempt, missing_rows, renumber, union_tables
from corpusloom.operators.parsing import parse_rewrites
from corpusloom.session import materialise

# Attempts per call and the pause between them, in seconds.
ATTEMPTS = 3
BACKOFF_SECONDS = 1.5
# Prompts handed to the model at a time.
LIST = 64
# Jobs of model calls in a run, at most: the more prompts, the more lists a task asks.
JOBS = 32
# A task's answers move into the table when the task ends, not when its whole job does.
COMMIT_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
# Prompts and answers are most of what a run writes.
PACKED = {"compression": "zstd"}

# One answer per prompt in the same order: None or an exception for a prompt without an answer. Raising fails the list.
Model = Callable[[list[str]], list[str | Exception | None]]


@dataclass(frozen=True)
class VariantSpec:
    """One variant to generate. The prose is the caller's."""

    name: str
    preamble: str = ""
    use_codes: bool = False
    use_context: bool = False


@dataclass(frozen=True)
class PromptOptions:
    """Parts of a preamble, chosen by mode; the texts are the caller's."""

    style: str = ""
    dialogue: dict[str, str] | None = None
    layouts: dict[str, str] | None = None
    extra: str = ""


def option_rules(options: PromptOptions, dialogue_mode: Column | str, layout: Column | str) -> Column:
    """Preamble per row: style, the rule of its layout, extra instructions, the rule of its dialogue mode."""

    def pick(rules: dict[str, str] | None, mode: Column | str) -> Column:
        key = F.col(mode) if isinstance(mode, str) else mode
        chosen = F.lit(None).cast("string")
        for name, rule in (rules or {}).items():
            chosen = F.when(key == name, rule).otherwise(chosen)
        return chosen

    parts = [
        F.nullif(F.lit(options.style), F.lit("")), pick(options.layouts, layout),
        blank_to_null(F.lit(options.extra)), pick(options.dialogue, dialogue_mode),
    ]
    return F.concat_ws("\n\n", *parts)


def plan_batches(numbered: DataFrame, size: int, num: str = "num") -> DataFrame:
    """`batch_id` of consecutive rows, from dense numbers; no window."""
    return numbered.withColumn("batch_id", F.floor((F.col(num) - 1) / size))


def batch_bounds(planned: DataFrame, num: str = "num", by: list[str] = ()) -> DataFrame:
    return planned.groupBy(*by, "batch_id").agg(
        F.min(num).alias("first_num"), F.max(num).alias("last_num"), F.count(F.lit(1)).alias("n_rows")
    )


def order_batches(names: Column | str) -> Column:
    """Numeric order key of batch names: the number between underscores, 0 without one."""
    c = F.col(names) if isinstance(names, str) else names
    return F.coalesce(F.regexp_extract(c, r"_(\d+)_", 1).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def table_as_text(
    reference: DataFrame, columns: list[str], order: list[str], sep: str = ";", block: int = 1000
) -> DataFrame:
    """(block_no, text): a table as texts of `block` value lines below the header line, in order. All rows stay; a table
    of up to `block` rows is one text. `order` must be a key. Numbering the rows writes their keys."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = renumber(reference.select(*dict.fromkeys([*order, *columns])), order, "__no", start=0).select(
        F.floor(F.col("__no") / block).alias("block_no"), "__no", line.alias("__line")
    )
    rows = F.sort_array(F.collect_list(F.struct("__no", "__line")))
    body = F.array_join(F.transform(rows, lambda r: r["__line"]), "\n")
    return lines.groupBy("block_no").agg(F.concat(F.lit(sep.join(columns) + "\n"), body).alias("text"))


def input_head(position: Column, num: Column) -> Column:
    """`[INPUT_TEXT k | Num=n]`."""
    return F.concat(F.lit("[INPUT_TEXT "), position.cast("string"), F.lit(" | Num="), num.cast("string"), F.lit("]"))


def line_block(fields: dict[str, Column | str], num: Column | str) -> Column:
    """`--- LINE n ---` and a `name: value` line per field, empty ones included."""
    n = F.col(num) if isinstance(num, str) else num
    lines = [F.concat(F.lit("--- LINE "), n.cast("string"), F.lit(" ---"))]
    for name, value in fields.items():
        v = F.col(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), F.coalesce(v.cast("string"), F.lit(""))))
    return F.concat_ws("\n", *lines)


def build_prompts(
    planned: DataFrame,
    block: Column | str,
    preamble: Column | str = "",
    by: list[str] = (),
    num: str = "num",
    head: Callable[[Column, Column], Column] | None = None,
    nums: str | None = None,
) -> DataFrame:
    """One prompt per batch: preamble, then the blocks in row order, each below `head(position, num)` if given. The column
    `nums`, if named, lists the batch's numbers in that order.

    A batch has a fixed size, so its list is small.
    """
    block = F.col(block) if isinstance(block, str) else block
    preamble = F.lit(preamble) if isinstance(preamble, str) else preamble
    blocks = F.sort_array(F.collect_list(F.struct(F.col(num).alias("num"), block.alias("block"))))
    grouped = planned.groupBy(*by, "batch_id").agg(
        F.max(preamble).alias("__preamble"), blocks.alias("__blocks"), F.count(F.lit(1)).alias("n_rows")
    )

    def shown(b: Column, i: Column) -> Column:
        return b["block"] if head is None else F.concat_ws("\n", head(i + 1, b["num"]), b["block"])

    joined = F.array_join(F.transform("__blocks", shown), "\n\n")
    listed = [F.transform("__blocks", lambda b: b["num"]).alias(nums)] if nums else []
    return grouped.select(
        *by, "batch_id", F.concat_ws("\n\n", F.nullif("__preamble", F.lit("")), joined).alias("prompt"), "n_rows", *listed
    )


def prompt_budget(prompts: DataFrame, target_words: int, limit: int) -> DataFrame:
    """Estimated tokens per prompt and whether prompt and answer come too close to the limit."""
    return prompts.withColumn("prompt_tokens", estimate_tokens("prompt")).withColumn(
        "over_budget", budget_flag(F.col("prompt_tokens"), F.col("n_rows"), target_words, limit)
    )


def _ask(model: Model, prompts: list[str]) -> list[str | Exception | None]:
    """The model's answers; a list that fails as a whole is asked again one by one, so that one prompt spoils no other."""
    try:
        answers = list(model(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
    except Exception as failure:  # noqa: BLE001 - the provider's errors are not ours to know
        return [failure] if len(prompts) == 1 else [_ask(model, [p])[0] for p in prompts]
    return answers


def _answered(
    model: Model, prompts: list[str], attempts: int, backoff: float, exponential: bool
) -> list[tuple[int, str | None, str | None]]:
    """(attempt, answer, error) of each prompt; only what has no answer yet is asked again."""
    results: list[tuple[int, str | None, str | None]] = [(attempts, None, "no answer")] * len(prompts)
    open_ = list(range(len(prompts)))
    for attempt in range(1, attempts + 1):
        still = []
        for i, answer in zip(open_, _ask(model, [prompts[i] for i in open_])):
            if isinstance(answer, str):
                results[i] = (attempt, answer, None)
            else:
                error = "no answer" if answer is None else f"{type(answer).__name__}: {answer}"
                results[i] = (attempts, None, error)
                still.append(i)
        open_ = still
        if not open_:
            break
        if attempt < attempts:
            time.sleep(backoff * (2 ** (attempt - 1) if exponential else attempt))
    return results


def _answers_schema(prompts: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [prompts.schema[k] for k in keys]
        + [T.StructField("attempt", T.IntegerType()), T.StructField("raw", T.StringType()),
           T.StructField("error", T.StringType())]
    )


def generate_batches(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    keys: list[str],
    *,
    tasks: int,
    attempts: int = ATTEMPTS,
    backoff: float = BACKOFF_SECONDS,
    exponential: bool = False,
    list_size: int = LIST,
) -> DataFrame:
    """(keys, attempt, raw, error): the answer of each prompt, null with the last error after all attempts.

    Prompts are dealt by key to `tasks` tasks, whatever their size in bytes; as many calls run at a time as tasks do. The
    model is built once per task and gets lists of up to `list_size` prompts. Write the result before parsing it
    (`generate_into`), or a second evaluation repeats the calls.
    """
    inputs = prompts.select(*keys, "prompt").repartition(tasks, *keys)
    return _call(inputs, make_model, keys, attempts, backoff, exponential, list_size)


def _call(
    inputs: DataFrame, make_model: Callable[[], Model], keys: list[str], attempts: int = ATTEMPTS,
    backoff: float = BACKOFF_SECONDS, exponential: bool = False, list_size: int = LIST,
) -> DataFrame:
    """The answers to prompts that lie in their tasks already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            listed, results = batch["prompt"].tolist(), []
            for start in range(0, len(listed), list_size):
                results += _answered(model, listed[start : start + list_size], attempts, backoff, exponential)
            out = batch[keys].copy()
            out["attempt"] = pd.Series([r[0] for r in results], index=out.index, dtype="int32")
            out["raw"] = pd.Series([r[1] for r in results], index=out.index, dtype="object")
            out["error"] = pd.Series([r[2] for r in results], index=out.index, dtype="object")
            yield out

    return inputs.mapInPandas(run, _answers_schema(inputs, keys))


def generate_into(
    path: str, prompts: DataFrame, make_model: Callable[[], Model], keys: list[str], *, tasks: int, list_size: int = LIST,
    lists: int = 1, carry: list[str] = (), **options,
) -> DataFrame:
    """(keys, carry, attempt, raw, error): the answers of the table at `path` to these prompts, after the model answered those
    that have none there and the raw answers were appended.

    An answer is stored with a digest of its keys and its prompt, and counts for that prompt only: a store may be used again
    after tables or prompts changed, then only what changed is asked. A repeated run after a failure calls the model only for
    what is still open. The open prompts are numbered and go to jobs of `tasks` tasks with `lists` lists of `list_size` prompts
    each, or with so many more that there are at most `JOBS` jobs; a task's answers are in the table as soon as it ends, so that
    a run that fails loses the tasks then at work and no more. (Where the file system's committer moves files only at the end
    of a job, that job.) More lists a task mean fewer jobs, whose slowest list the others wait for. `carry` are columns of
    `prompts` that hang on the keys. Runs the model, and jobs.
    """
    spark, run = prompts.sparkSession, uuid.uuid4().hex
    request = F.sha2(F.to_json(F.struct(*keys, F.col("prompt"))), 256)
    place = F.monotonically_increasing_id()
    # A prompt is written here, and moves once more to its task. All else needs its digest and its place in this table.
    asked = materialise(prompts.select(*keys, *carry, "prompt").withColumns({"request": request, "__at": place}), "prompts", **PACKED)
    # An answer names its run and brings its prompt's columns with it, so that those of this run join nothing.
    marked = asked.withColumn("run", F.lit(run))
    brought = [*keys, *carry, "request", "run"]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in _answers_schema(marked, brought).fields])
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    before = spark.read.schema(schema).parquet(path)
    known = materialise(asked.select("request", *carry).join(before.select("request"), "request", "left_semi"), "known")
    places = asked.select("request", "__at")
    open_ = places.join(before.where("raw is not null").select("request"), "request", "left_anti").select("__at")
    todo = materialise(renumber(open_, ["__at"], "__no", start=0), "open_prompts")
    share = tasks * list_size * max(lists, -(-todo.count() // (tasks * list_size * JOBS)))
    jobs = todo.groupBy(F.floor(F.col("__no") / share).alias("job")).agg(F.min("__at").alias("first"), F.max("__at").alias("last"))
    for job in jobs.orderBy("job").collect():
        # Numbers follow places, so a job reads little beside its own prompts; task by task dealt evenly.
        numbers = todo.where(F.col("__no").between(job["job"] * share, (job["job"] + 1) * share - 1))
        part = marked.where(F.col("__at").between(job["first"], job["last"])).join(F.broadcast(numbers), "__at")
        dealt = part.repartitionById(tasks, (F.col("__no") % tasks).cast("int")).select(*brought, "prompt")
        answers = _call(dealt, make_model, brought, list_size=list_size, **options)
        answers.write.mode("append").options(**COMMIT_BY_TASK, **PACKED).parquet(path)
    store, columns = spark.read.schema(schema).parquet(path), [*keys, *carry, "attempt", "raw", "error"]
    new = store.where(F.col("run") == run).select(columns)
    if known.isEmpty():
        return new
    # What a store held before may lack the columns carried.
    earlier = store.where(~F.col("run").eqNullSafe(run)).drop(*carry)
    return new.unionByName(earlier.join(known.dropDuplicates(["request"]), "request").select(columns))


def placeholder_failed(responses: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """One `[GENERATION_FAILED for line i]` per row of a batch without answer."""
    failed = responses.groupBy(*keys).agg(F.count("raw").alias("n")).where("n = 0").select(*keys)
    rows = bounds.join(failed, keys, "left_semi")
    line = F.explode(F.sequence("first_num", "last_num")).alias("num")
    text = F.concat(F.lit("[GENERATION_FAILED for line "), F.col("num").cast("string"), F.lit("]"))
    return rows.select(*keys, line).withColumn("text", text)


def row_count_guard(produced: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_expected, n_rows) of the batches whose row count is not the expected one: to be done again."""
    counts = produced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = expected.join(counts, keys, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
    return joined.where(F.col("n_rows") != F.col("n_expected"))


def redo_invalid(flagged: DataFrame, columns: list[str], keys: list[str], stage: str) -> DataFrame:
    """Batches with an invalid code in any column, with the counts: to be done again, or logged as failed."""
    counts = [F.count(F.when(F.col(f"{c}_invalid"), 1)).alias(f"n_invalid_{c}") for c in columns]
    total = sum((F.col(f"n_invalid_{c}") for c in columns), F.lit(0))
    return flagged.groupBy(*keys).agg(*counts).where(total > 0).withColumn("stage", F.lit(stage))


def redo_batches(
    prompts: DataFrame,
    make_model: Callable[[], Model],
    keys: list[str],
    rejected: Callable[[DataFrame], DataFrame],
    *,
    store: str,
    tasks: int,
    stage: str,
    rounds: int = 3,
    retry_preamble: str = "",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, failures): answers that pass, and the batches left without one after all rounds.

    accepted has (keys, round, raw), failures (keys, stage, reason). Each round asks for the batches that are still open
    and keeps the answers that `rejected` does not return: it takes (keys, raw) and gives (keys, reason), from
    `row_count_guard` or `redo_invalid` for instance. From the second round on `retry_preamble` leads the prompt. The
    answers of a round are a table below `store`; a repeated run asks only for prompts without an answer there, and ignores
    answers to other prompts. Runs the model, and jobs.
    """
    open_, accepted = prompts.select(*keys, "prompt"), []
    for round_no in range(1, rounds + 1):
        lead = F.lit(retry_preamble if round_no > 1 else "")
        asked = open_.withColumn("prompt", F.concat_ws("\n\n", F.nullif(lead, F.lit("")), F.col("prompt")))
        answers = generate_into(f"{store}/round={round_no}", asked, make_model, keys, tasks=tasks, **options)
        given = answers.where("raw is not null").select(*keys, "raw").join(open_.select(*keys), keys, "left_semi")
        bad = materialise(rejected(given).select(*keys, F.col("reason").cast("string").alias("reason")), "rejected")
        good = materialise(given.join(bad, keys, "left_anti"), "accepted")
        accepted.append(good.select(*keys, F.lit(round_no).alias("round"), "raw"))
        silent = open_.join(given.select(*keys), keys, "left_anti").select(*keys, F.lit("no answer").alias("reason"))
        failures = bad.unionByName(silent)
        open_ = materialise(prompts.select(*keys, "prompt").join(failures.select(*keys), keys, "left_semi"), "open")
    failed = failures.groupBy(*keys).agg(F.max("reason").alias("reason")).withColumn("stage", F.lit(stage))
    return union_tables(accepted), failed.select(*keys, "stage", "reason")


def choose_model(requests: DataFrame, roles: DataFrame, default: str) -> DataFrame:
    """Requests with the model of their role, the default for an unlisted role."""
    listed = roles.select("role", F.col("model").alias("__model"))
    return requests.join(listed, "role", "left").withColumn("model", F.coalesce("__model", F.lit(default))).drop("__model")


def fill_audit(corpus: DataFrame, variants: DataFrame, names: list[str]) -> DataFrame:
    """(variant, total, filled, missing, pct_filled, pct_missing) of a fill; the ids are rows of `fill_status`."""
    status = fill_status(corpus, variants, names)
    counts = status.groupBy("variant").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("filled"), 1)).alias("filled"),
        F.count(F.when(~F.col("filled"), 1)).alias("missing"),
    )
    return counts.select(
        "*", (F.col("filled") * 100.0 / F.col("total")).alias("pct_filled"),
        (F.col("missing") * 100.0 / F.col("total")).alias("pct_missing"),
    )


def fill_status(corpus: DataFrame, variants: DataFrame, names: list[str]) -> DataFrame:
    """(variant, num, filled) for every corpus row and variant."""
    wanted = wanted_rows(corpus, names).select("variant", "num")
    done = variants.where(~is_blank("generated_text")).select("variant", "num").distinct()
    return wanted.join(done.withColumn("filled", F.lit(True)), ["variant", "num"], "left").withColumn(
        "filled", F.coalesce("filled", F.lit(False))
    )


def wanted_rows(corpus: DataFrame, names: list[str]) -> DataFrame:
    """Every non-blank corpus row once per variant: all variants go through the same job."""
    return corpus.where(~is_blank("text")).withColumn("variant", F.explode(F.array(*[F.lit(n) for n in names])))


def _asks(planned: DataFrame, block: Column, preamble: Column) -> DataFrame:
    """(ask, variant, nums, prompt) of each batch; `ask` is a digest of all that is asked: variant, numbers, prompt."""
    batches = build_prompts(planned, block, preamble, by=["variant"], head=input_head, nums="nums")
    listed = F.concat_ws(",", F.transform("nums", lambda n: n.cast("string")))
    ask = F.sha2(F.concat_ws("\x1f", F.col("variant"), listed, F.col("prompt")), 256)
    return batches.select(ask.alias("ask"), "variant", "nums", "prompt")


def fill_missing(
    corpus: DataFrame,
    existing: DataFrame,
    specs: list[VariantSpec],
    make_model: Callable[[], Model],
    *,
    store: str,
    tasks: int,
    batch_size: int = 20,
    rounds: int = 2,
    overwrite: bool = False,
    retry_preamble: str = "",
    meta: Column | None = None,
    **options,
) -> DataFrame:
    """(variant, num, generated_text) for every corpus row and variant, '' where the model never answered.

    Each round asks only for what is missing and appends the raw answers to the table at `store`, keyed by what was asked;
    a later run with the same store repeats no prompt that has an answer there, and ignores answers to prompts it would
    not ask. Of an answer only the numbers of its own batch are taken. Existing texts stay unless `overwrite`; among
    the rounds of a run a later non-blank answer wins. The model is called in `tasks` tasks. Runs the model, and jobs.
    """
    names = [s.name for s in specs]
    wanted = wanted_rows(corpus.select("num", "text"), names).select("variant", "num")
    have = existing.where("false") if overwrite else existing
    kept = have.where(~is_blank("generated_text")).select(
        "variant", "num", strip("generated_text").alias("text"), F.lit(0).alias("attempt")
    )
    texts, news = kept, []
    sources = corpus.select("num", *[c for c in corpus.columns if c != "num"])
    for round_no in range(1, rounds + 1):
        pending = missing_rows(wanted, texts.select("variant", "num", F.col("text").alias("generated_text")), ["variant", "num"])
        # Only keys are sorted and numbered; the texts join them once. Numbers run through all variants, so a batch is
        # cut again at the border between two of them.
        numbered = materialise(renumber(pending, ["variant", "num"], "__row"), "pending")
        planned = plan_batches(sources.join(numbered, "num"), batch_size, "__row")
        block = F.concat_ws("\n", blank_to_null(meta) if meta is not None else F.lit(None), strip("text"))
        preamble = F.lit("")
        for s in specs:
            lead = s.preamble if round_no == 1 else "\n".join(p for p in (s.preamble, retry_preamble) if p)
            preamble = F.when(F.col("variant") == s.name, lead).otherwise(preamble)
        asks = _asks(planned, block, preamble)
        answers = generate_into(store, asks, make_model, ["ask"], tasks=tasks, carry=["variant", "nums"], **options)
        mine = answers.where("raw is not null")
        parsed = parse_rewrites(mine, "raw", ["variant", "nums"]).where(F.array_contains("nums", F.col("num")))
        # Parsed once: the next round and the result read the texts, not the answers.
        new = materialise(parsed.where(~is_blank("text")).select("variant", "num", "text"), "rewrites", **PACKED)
        news.append(new.withColumn("attempt", F.lit(round_no)))
        texts = texts.unionByName(news[-1])
    return _filled(wanted, kept, union_tables(news), ["variant", "num"]) if news else _best_filled(wanted, kept, ["variant", "num"])


def _best_filled(wanted: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    best = best_attempt(texts, keys).withColumnRenamed("text", "generated_text")
    return wanted.join(best, keys, "left").withColumn("generated_text", F.coalesce("generated_text", F.lit("")))


def _filled(wanted: DataFrame, kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows with their best text, '' without one. A new text that is the only one of a row that is wanted once
    stays where it is, only its key moves; `new` holds wanted rows that are not in `kept`, and no blank text. Writes the
    other keys."""
    several = [rows.groupBy(*keys).count().where("count > 1").select(*keys) for rows in (new, wanted)]
    repeated = materialise(union_tables(several).distinct(), "repeated")
    single = new.join(repeated, keys, "left_anti")
    rest = wanted.join(single.select(*keys), keys, "left_anti")
    others = _best_filled(rest, kept.unionByName(new.join(repeated, keys, "left_semi")), keys)
    return single.select(*keys, F.col("text").alias("generated_text")).unionByName(others)


def sample_rows(catalogue: DataFrame, key: str, n: int = 20, seed: str = "0") -> DataFrame:
    """A repeatable sample of at most n rows: those with the smallest hash of seed and key."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    return catalogue.withColumn("sample_order", order).orderBy("sample_order").limit(n)


