"""Column functions on model requests and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col, let, strip

# Providers accepted in front of a model name.
KNOWN_PROVIDERS = ["openai", "openrouter", "gemini", "mistral", "ollama", "local", "huggingface", "grok", "xai"]

# Model name patterns and the provider each one stands for, first match wins.
PROVIDER_PATTERNS = [
    (r"^(?:gemini|google/)", "gemini"),
    (r"^(?:gpt-|o1-|o3-)", "openai"),
    (r"^(?:mistral-|pixtral-|codestral)", "mistral"),
    (r"/", "openrouter"),
    (r":|llama|phi3|phi4|gemma", "ollama"),
]
DEFAULT_PROVIDER = "openai"

# Secret shapes and their replacements, applied in this order. The first entry lists lower-case
# strings one of which a text must hold for the pattern to match at all.
REDACTED = "***REDACTED***"
SECRET_PATTERNS = [
    (("bearer",), r"(?i)(authorization\s*[:=]\s*bearer\s+)([A-Za-z0-9._\-=/+]{16,})", 1, ""),
    (("bearer",), r"(?i)(\bbearer\s+)([A-Za-z0-9._\-=/+]{16,})", 1, ""),
    (("sk-",), r"\bsk-[A-Za-z0-9]{4,}\b", 0, "sk-"),
    (("sk-ant-",), r"\bsk-ant-[A-Za-z0-9\-_]{10,}\b", 0, "sk-ant-"),
    (("sk-or-v1-",), r"\bsk-or-v1-[A-Za-z0-9\-_]{10,}\b", 0, "sk-or-v1-"),
    (("aiza",), r"\bAIza[0-9A-Za-z\-_]{30,}\b", 0, "AIza"),
    (
        ("api", "token", "secret"),
        r"(?i)\b(api[_-]?key|x-api-key|token|secret)\b(\s*[:=]\s*)(['\"]?)([^\s'\",]{12,})",
        3,
        "",
    ),
    (
        ("key",),
        r"(?i)\b((?:OPENAI|ANTHROPIC|OPENROUTER|GOOGLE|GEMINI|MISTRAL|XAI|HUGGINGFACE|HF)_[A-Z0-9_]*KEY)\b"
        r"(\s*[:=]\s*)(['\"]?)([^\s'\",]{12,})",
        3,
        "",
    ),
]


def estimate_tokens(c: Column | str) -> Column:
    """About four characters a token; at least 1 for a non-empty text, 0 for an empty one."""
    size = F.coalesce(F.length(_col(c)), F.lit(0))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("long")


def budget_flag(prompt_tokens: Column, rows: Column, target_words: int, limit: int, share: float = 0.8) -> Column:
    """True when prompt and expected answer exceed `share` of the model's limit."""
    return (prompt_tokens + rows * F.lit(target_words)) > F.lit(limit * share)


def guess_provider(model: Column | str) -> Column:
    name = strip(F.lower(_col(model)))
    guess = None
    for pattern, provider in PROVIDER_PATTERNS:
        guess = F.when(name.rlike(pattern), provider) if guess is None else guess.when(name.rlike(pattern), provider)
    return guess.otherwise(DEFAULT_PROVIDER)


def split_model_spec(spec: Column | str) -> Column:
    """struct(provider, model) of `provider\\model`, `provider/model`, `provider:model` or a bare model name."""
    s = _col(spec)

    def parts(sep: str) -> tuple[Column, Column, Column]:
        head = strip(F.lower(F.substring_index(s, sep, 1)))
        rest = strip(F.substr(s, F.instr(s, sep) + 1))
        return F.contains(s, F.lit(sep)), head, rest

    back, back_head, _ = parts("\\")
    back_rest = F.ltrim(strip(F.substr(s, F.instr(s, "\\") + 1)), F.lit("\\/"))
    slash, slash_head, slash_rest = parts("/")
    colon, colon_head, colon_rest = parts(":")
    by_slash = slash & slash_head.isin(KNOWN_PROVIDERS)
    by_colon = colon & colon_head.isin(KNOWN_PROVIDERS)
    provider = (
        F.when(back, back_head).when(by_slash, slash_head).when(by_colon, colon_head).otherwise(guess_provider(s))
    )
    model = (
        F.when(back, back_rest).when(by_slash, slash_rest).when(by_colon, colon_rest)
        .otherwise(F.ltrim(strip(s), F.lit("\\/")))
    )
    return F.struct(provider.alias("provider"), model.alias("model"))


def flatten_messages(messages: Column | str) -> Column:
    """`[ROLE] content` parts, a blank line between them; a missing role is the user's."""
    part = lambda m: F.concat(
        F.lit("["), F.upper(F.coalesce(m["role"], F.lit("user"))), F.lit("] "), F.coalesce(m["content"], F.lit(""))
    )
    return F.array_join(F.transform(_col(messages), part), "\n\n")


def redact_secrets(c: Column | str) -> Column:
    """Tokens, keys and `key=value` secrets masked. A pattern runs only on texts that hold its key word."""
    text = F.coalesce(_col(c), F.lit(""))

    def mask(low: Column) -> Column:
        out = text
        for words, pattern, groups, literal in SECRET_PATTERNS:
            kept = "".join(f"${i}" for i in range(1, groups + 1))
            present = low.contains(words[0])
            for word in words[1:]:
                present = present | low.contains(word)
            out = let(out, lambda t: F.when(present, F.regexp_replace(t, pattern, kept + literal + REDACTED)).otherwise(t))
        return out

    return let(F.lower(text), mask)


def extract_json_object(c: Column | str) -> Column:
    """The fenced JSON object of an answer, else the stretch from the first `{` to the last `}`."""

    def unfence(t: Column) -> Column:
        fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1)
        return F.when(fenced != "", fenced).otherwise(t)

    def cut(t: Column) -> Column:
        first = F.instr(t, "{")
        last = F.length(t) - F.length(F.substring_index(t, "}", -1))
        whole = t.startswith("{") | (first == 0) | (last <= first) | ~t.contains("}")
        return F.when(whole, t).otherwise(F.substr(t, first, last - first + 1))

    return let(let(strip(_col(c)), unfence), cut)
