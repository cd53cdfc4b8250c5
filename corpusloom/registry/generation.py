"""Prompts, model calls, fills and classification, with models that answer by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import lexical as lx
from corpusloom.functions import text as tx
from corpusloom.operators import alignment as al
from corpusloom.operators import chapters as ch
from corpusloom.operators import generation as gn
from corpusloom.plans import corpus as corpus_plan
from corpusloom.plans import themes
from corpusloom.registry.core import query, sql_strip, sql_tokens, table, texts
from corpusloom.session import scratch_path


# Tasks that call the model.
TASKS = 8


def _numbered(spark, sf):
    docs = texts(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return gn.plan_batches(docs.join(al.renumber(docs.select("doc_id"), ["doc_id"]), "doc_id"), 5)


NUMBERED = """n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS num FROM documents),
   b AS (SELECT *, (num - 1) // 5 AS batch_id FROM n)"""


@query(
    "build_prompts",
    f"""WITH {NUMBERED} SELECT batch_id, 'STYLE' || chr(10) || chr(10) || string_agg('--- LINE ' || num || ' ---' || chr(10) || 'Topic: '
          || source || chr(10) || 'Advice: ' || lang || chr(10) || 'Sentence: ' || text, chr(10) || chr(10) ORDER BY num) AS prompt, count(*) AS n_rows
        FROM b GROUP BY 1""",
)
def build_prompts(spark, sf):
    block = gn.line_block({"Topic": "source", "Advice": "lang", "Sentence": "text"}, "num")
    return gn.build_prompts(_numbered(spark, sf), block, "STYLE")


@query(
    "budget_flag",
    f"""WITH {NUMBERED}, p AS (SELECT batch_id, string_agg('[INPUT_TEXT ' || (num - 1) % 5 + 1 || ' | Num=' || num || ']' || chr(10) || {sql_strip('text')},
          chr(10) || chr(10) ORDER BY num) AS prompt, count(*) AS n FROM b GROUP BY 1)
        SELECT batch_id, length(prompt) // 4 AS prompt_tokens, length(prompt) // 4 + n * 250 > 4000 * 0.8 AS over_budget FROM p""",
)
def budget_flag(spark, sf):
    prompts = gn.build_prompts(_numbered(spark, sf), tx.strip("text"), head=gn.input_head)
    return gn.prompt_budget(prompts, 250, 4000).select("batch_id", "prompt_tokens", "over_budget")


@query(
    "table_as_text",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders)
       SELECT no // 1000 AS block_no, 'o_orderkey;o_custkey;o_orderpriority' || chr(10) || string_agg(o_orderkey || ';' || o_custkey || ';'
         || o_orderpriority, chr(10) ORDER BY no) AS text FROM n GROUP BY 1""",
)
def table_as_text(spark, sf):
    return gn.table_as_text(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], ["o_orderkey"])


@query(
    "option_rules",
    """SELECT o_orderkey, concat_ws(chr(10) || chr(10), 'STYLE', CASE o_orderstatus WHEN 'O' THEN 'marked' WHEN 'F' THEN 'plain' END,
         'more', CASE o_orderpriority WHEN '1-URGENT' THEN 'no dialogue' WHEN '5-LOW' THEN 'one line' END) AS preamble FROM orders""",
)
def option_rules(spark, sf):
    options = gn.PromptOptions(
        "STYLE", {"1-URGENT": "no dialogue", "5-LOW": "one line"}, {"O": "marked", "F": "plain"}, " more "
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", gn.option_rules(options, "o_orderpriority", "o_orderstatus").alias("preamble")
    )


def make_echo():
    """Answers with the length of the prompt; the first call on each prompt with a hash sign fails."""
    seen: set[str] = set()

    def answer(prompt):
        if "#" in prompt and prompt not in seen:
            seen.add(prompt)
            return RuntimeError("busy")
        return None if "$" in prompt else f"{len(prompt)} characters"

    return lambda prompts: [answer(p) for p in prompts]


@query(
    "generate_batches",
    """SELECT doc_id, CASE WHEN contains(text, '$') THEN 3 WHEN contains(text, '#') THEN 2 ELSE 1 END AS attempt,
         CASE WHEN NOT contains(text, '$') THEN length(doc_id || ': ' || text) || ' characters' END AS raw,
         CASE WHEN contains(text, '$') THEN 'no answer' END AS error FROM documents""",
)
def generate_batches(spark, sf):
    # The number in front keeps prompts apart: the model counts its calls by prompt.
    prompt = F.concat(F.col("doc_id").cast("string"), F.lit(": "), "text")
    prompts = texts(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))
    return gn.generate_batches(prompts, make_echo, ["doc_id"], tasks=TASKS, backoff=0.0)


def make_rewriter():
    """Rewrites each input text by putting a mark in front; forgets French texts in the first round, never does texts
    with a dollar sign, and always adds rewrites of texts it was not asked for."""

    def model(prompts):
        answers = []
        for prompt in prompts:
            lead, *inputs = prompt.split("[INPUT_TEXT ")
            again, mark = "RETRY" in lead, prompt.split("\n", 1)[0]
            mine = {int(one.split("]\n", 1)[0].split(" | Num=")[1]) for one in inputs}
            parts = [f"[REWRITE 9 | Num={n}]\nforeign\n" for n in range(6) if n not in mine]
            for one in inputs:
                head, text = one.split("]\n", 1)
                position, num = head.split(" | Num=")
                if "$" in text or (" une " in text and not again):
                    continue
                parts.append(f"[REWRITE {position} | Num={num}]\n{mark}: {text.strip()}\n")
            answers.append("\n".join(parts))
        return answers

    return model


@query(
    "fill_missing",
    f"""SELECT v.variant, doc_id AS num, CASE WHEN quality = 1 AND v.variant = 'DIRECT' THEN 'kept' WHEN contains(text, '$') THEN ''
          ELSE v.variant || ': ' || {sql_strip('text')} END AS generated_text
        FROM (SELECT unnest(['DIRECT', 'FORMAL']) AS variant) v, documents LEFT JOIN labels USING (doc_id)""",
)
def fill_missing(spark, sf):
    corpus = texts(spark, sf, "documents").select(F.col("doc_id").alias("num"), "text")
    existing = table(spark, sf, "labels").select(
        F.lit("DIRECT").alias("variant"), F.col("doc_id").alias("num"), F.when(F.col("quality") == 1, "kept").otherwise(" ").alias("generated_text")
    )
    return gn.fill_missing(corpus, existing, SPECS, make_rewriter, store=scratch_path(spark, "answers"), **FILL)


SPECS = [gn.VariantSpec("DIRECT", "DIRECT"), gn.VariantSpec("FORMAL", "FORMAL")]
FILL = {"tasks": TASKS, "lists": 16, "retry_preamble": "RETRY", "backoff": 0.0}


@query(
    "fill_resumed",
    f"""SELECT v.variant, doc_id AS num, CASE WHEN quality = 1 AND v.variant = 'DIRECT' THEN 'kept' WHEN contains(text, '$') THEN ''
          ELSE v.variant || ': ' || {sql_strip('text')} END AS generated_text
        FROM (SELECT unnest(['DIRECT', 'FORMAL']) AS variant) v, documents LEFT JOIN labels USING (doc_id)""",
)
def fill_resumed(spark, sf):
    """A run over the labelled texts, then one over all with the same store and other texts filled in between."""
    corpus = texts(spark, sf, "documents").select(F.col("doc_id").alias("num"), "text")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("num"), "quality")
    store = scratch_path(spark, "answers")
    none = spark.createDataFrame([], "variant string, num long, generated_text string")
    gn.fill_missing(corpus.join(labels, "num", "left_semi"), none, SPECS, make_rewriter, store=store, **FILL)
    filled = labels.where("quality = 1").select(F.lit("DIRECT").alias("variant"), "num", F.lit("kept").alias("generated_text"))
    return gn.fill_missing(corpus, filled, SPECS, make_rewriter, store=store, **FILL)


@query(
    "placeholder_failed",
    f"""WITH {NUMBERED}, f AS (SELECT batch_id FROM b GROUP BY 1 HAVING bool_or(contains(text, '$')))
        SELECT batch_id, num, '[GENERATION_FAILED for line ' || num || ']' AS text FROM b SEMI JOIN f USING (batch_id)""",
)
def placeholder_failed(spark, sf):
    planned = _numbered(spark, sf)
    prompts = gn.build_prompts(planned, "text")
    path = scratch_path(spark, "responses")
    responses = gn.generate_into(path, prompts, make_echo, ["batch_id"], tasks=TASKS, attempts=2, backoff=0.0)
    return gn.placeholder_failed(responses, gn.batch_bounds(planned), ["batch_id"])


@query(
    "redo_invalid",
    """WITH st AS (SELECT DISTINCT l_linestatus AS code FROM lineitem),
         f AS (SELECT o_custkey AS batch_id, count(*) FILTER (st.code IS NULL) AS n_invalid_o_orderstatus,
           count(*) FILTER (o_orderpriority = '5-LOW') AS n_invalid_o_orderpriority
         FROM orders LEFT JOIN st ON o_orderstatus = st.code GROUP BY 1)
       SELECT *, 'Mapping' AS stage FROM f WHERE n_invalid_o_orderstatus + n_invalid_o_orderpriority > 0""",
)
def redo_invalid(spark, sf):
    status = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("code")).distinct()
    kinds = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code")).distinct().where("code <> '5-LOW'")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), "o_orderstatus", "o_orderpriority")
    flagged = al.validate_codes(orders, {"o_orderstatus": (status, "F"), "o_orderpriority": (kinds, "x")}, mode="flag")
    return gn.redo_invalid(flagged, ["o_orderstatus", "o_orderpriority"], ["batch_id"], "Mapping")


@query(
    "choose_model",
    """SELECT s_suppkey, 'NATION_' || s_nationkey AS role, coalesce('region ' || n_regionkey, 'default') AS model
       FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_name = 'NATION_' || s_nationkey""",
)
def choose_model(spark, sf):
    requests = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("role"))
    roles = table(spark, sf, "nation").where("n_regionkey <> 2").select(
        F.col("n_name").alias("role"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("model")
    )
    return gn.choose_model(requests, roles, "default")


@query(
    "classify_batches",
    f"""WITH k AS (SELECT DISTINCT 'item ' || item_id AS theme, unnest({sql_tokens('lower(text)')}) AS keyword FROM benchmark),
          w AS (SELECT DISTINCT doc_id, unnest({sql_tokens('lower(text)')}) AS keyword FROM documents),
          h AS (SELECT doc_id, theme, count(*) AS score FROM w JOIN k USING (keyword) GROUP BY ALL)
        SELECT doc_id, theme, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theme) AS rn FROM h) WHERE rn = 1""",
)
def classify_batches(spark, sf):
    words = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("theme"), F.explode(lx.tokens(F.lower("text"))).alias("keyword")
    )
    return ch.keyword_themes(texts(spark, sf, "documents"), lx.tokens(F.lower("text")), ["doc_id"], words)




def make_lister():
    """Answers with the input lines below the head; leaves out those of src7 unless asked again, and always those of src3."""

    def answer(prompt):
        lines = [line for line in prompt.split("\n") if ";" in line]
        return "\n".join(x for x in lines if not x.endswith(";src3") and ("RETRY" in prompt or not x.endswith(";src7")))

    return lambda prompts: [answer(p) for p in prompts]


def _redone(spark, sf, store=None, source=None):
    docs = table(spark, sf, "documents").select("doc_id", "source" if source is None else source.alias("source"))
    planned = gn.plan_batches(docs.join(al.renumber(docs.select("doc_id"), ["doc_id"]), "doc_id"), 5)
    prompts = gn.build_prompts(planned, F.concat_ws(";", "doc_id", "source"))
    expected = prompts.select("batch_id", F.col("n_rows").alias("n_expected"))

    def too_few(given):
        rows = given.select("batch_id", F.explode(F.filter(F.split("raw", "\n"), lambda x: x != "")))
        asked = expected.join(given.select("batch_id"), "batch_id", "left_semi")
        reason = F.concat(F.col("n_rows"), F.lit(" of "), F.col("n_expected"))
        return gn.row_count_guard(rows, asked, ["batch_id"]).withColumn("reason", reason)

    return gn.redo_batches(
        prompts, make_lister, ["batch_id"], too_few, store=store or scratch_path(spark, "redone"), tasks=TASKS, stage="Context",
        rounds=2, retry_preamble="RETRY", backoff=0.0,
    )


SQL_REDONE = f"""WITH {NUMBERED}, r AS (SELECT batch_id, count(*) AS n, count(*) FILTER (source <> 'src3') AS kept,
         bool_or(source = 'src7') AS again, string_agg(doc_id || ';' || source, chr(10) ORDER BY num) AS raw FROM b GROUP BY 1)"""


@query("redo_batches", f"{SQL_REDONE} SELECT batch_id, CASE WHEN again THEN 2 ELSE 1 END AS round, raw FROM r WHERE kept = n")
def redo_batches(spark, sf):
    return _redone(spark, sf)[0]


@query("redo_resumed", f"{SQL_REDONE} SELECT batch_id, CASE WHEN again THEN 2 ELSE 1 END AS round, raw FROM r WHERE kept = n")
def redo_resumed(spark, sf):
    # The store holds answers to other prompts of the same batches.
    store = scratch_path(spark, "redone")
    _redone(spark, sf, store, F.concat(F.lit("old"), "source"))
    return _redone(spark, sf, store)[0]


@query(
    "narrate",
    f"""WITH {NUMBERED}, f AS (SELECT batch_id FROM b GROUP BY 1 HAVING bool_or(contains(text, '$')))
        SELECT batch_id, 0 AS row, length('Tell.' || string_agg(chr(10) || chr(10) || source || ': ' || text, '' ORDER BY num)) || ' characters' AS text
          FROM b ANTI JOIN f USING (batch_id) GROUP BY 1
        UNION ALL SELECT batch_id, num, '[GENERATION_FAILED for line ' || num || ']' FROM b SEMI JOIN f USING (batch_id)""",
)
def narrate(spark, sf):
    numbered = _numbered(spark, sf).drop("batch_id")
    new = {"texts": numbered.select("num", "text"), "sources": numbered.select("num", "source")}
    old = {name: df.where("num <= 10") for name, df in new.items()} | {"sources": numbered.select("num", F.lit("old").alias("source"))}
    store, block = scratch_path(spark, "narratives"), F.concat_ws(": ", "source", "text")
    # The store holds answers to other prompts of the same batches, and batches that are no more.
    for tables in (old, new):
        told = corpus_plan.narrate(tables, block, "Tell.", make_echo, store, tasks=TASKS, attempts=2, backoff=0.0)
    return told


@query("failed_batches", f"{SQL_REDONE} SELECT batch_id, 'Context' AS stage, kept || ' of ' || n AS reason FROM r WHERE kept < n")
def failed_batches(spark, sf):
    return _redone(spark, sf)[1]


def make_classifier():
    """Gives each text the theme of its first word if that is listed; proposes one for words that end with an odd digit;
    names the others by a theme nobody knows, and when asked again the first one listed. Also answers for others."""

    def answer(prompt):
        import json

        lead, *inputs = prompt.split("[INPUT_TEXT ")
        listed = [line[2:].split(": ")[0] for line in lead.split("\n") if line.startswith("- ")]
        found, new = [{"id": "0", "theme": "src1"}, {"id": "1", "theme": "src1"}], []
        mine = {int(x.split("Num=")[1].split("]")[0]) for x in inputs}
        found = [x for x in found if int(x["id"]) not in mine]
        for one in inputs:
            num, word = one.split("Num=")[1].split("]")[0], one.split("]\n", 1)[1].split()[0]
            if word in listed:
                theme = word
            elif word[-1] in "13579":
                theme = word
                new.append({"name": word, "description": "new"})
            else:
                theme = listed[0] if "RETRY" in lead else "nowhere"
            found.append({"id": num, "theme": theme})
        return "Sure: " + json.dumps({"assignments": found, "new_themes": new})

    return lambda prompts: [answer(p) for p in prompts]


def _classified(spark, sf):
    corpus = texts(spark, sf, "documents").select(F.col("doc_id").alias("num"), F.concat_ws(" ", "source", "text").alias("text"))
    catalogue = table(spark, sf, "region").select(
        F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("description")
    )
    return themes.classify_model(
        corpus, catalogue, make_classifier, store=scratch_path(spark, "themes"), tasks=TASKS, preamble="Sort.",
        retry_preamble="RETRY", backoff=0.0,
    )


@query(
    "classify_model",
    """SELECT doc_id AS num, CASE WHEN 'src' || r_regionkey = source OR right(source, 1) IN ('1', '3', '5', '7', '9') THEN source ELSE 'src0' END AS theme
       FROM documents LEFT JOIN region ON 'src' || r_regionkey = source""",
)
def classify_model(spark, sf):
    return _classified(spark, sf)[0]


@query(
    "classify_model_catalogue",
    """SELECT 'src' || r_regionkey AS name, r_name AS description, false AS is_new FROM region
       UNION ALL SELECT DISTINCT source, 'new', true FROM documents ANTI JOIN region ON 'src' || r_regionkey = source
         WHERE right(source, 1) IN ('1', '3', '5', '7', '9')""",
)
def classify_model_catalogue(spark, sf):
    return _classified(spark, sf)[1]
