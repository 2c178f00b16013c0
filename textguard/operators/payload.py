"""Text, usage and token counts out of captured request and response JSON.

``content`` may be a string or a list of blocks and ``prompt`` a string or a list,
so the documents are read as VARIANT and taken apart by type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.dialect import java_regex

MAX_INPUT_TOKENS = 8192
_TOKEN = java_regex(r"\w+|[^\w\s]")
_BLANK = java_regex(r"^\s*$")


def parsed(col: Column) -> Column:
    """The document as VARIANT; NULL when it is not JSON."""
    return F.try_parse_json(col)


def _array(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _string(doc: Column, path: str) -> Column:
    """The string at ``path``; NULL when there is none or it has another type."""
    v = F.try_variant_get(doc, path, "variant")
    return F.when(_is_string(v), F.try_variant_get(doc, path, "string"))


def _list(*values: Column) -> Column:
    """The non-null strings of the given columns, in order."""
    return F.array_compact(F.array(*values))


def _text_blocks(message: Column, path: str = "$.content") -> Column:
    blocks = F.transform(
        _array(message, path),
        lambda b: F.when(_string(b, "$.type") == "text", F.coalesce(_string(b, "$.text"), F.lit(""))),
    )
    return F.array_compact(blocks)


def not_blank(texts: Column) -> Column:
    return F.filter(texts, lambda t: ~t.rlike(_BLANK))


def message_texts(doc: Column) -> Column:
    return F.flatten(F.transform(_array(doc, "$.messages"), lambda m: F.concat(_list(_string(m, "$.content")), _text_blocks(m))))


def request_texts(payload: Column, dedupe_blocks: bool = True) -> Column:
    """Texts of a request: messages, then prompt.  ``dedupe_blocks=False`` lists the
    blocks of list-valued contents a second time at the end."""
    doc = parsed(payload)
    prompts = F.array_compact(F.transform(_array(doc, "$.prompt"), lambda p: F.try_variant_get(p, "$", "string")))
    parts = [message_texts(doc), _list(_string(doc, "$.prompt")), prompts]
    if not dedupe_blocks:
        parts.append(F.flatten(F.transform(_array(doc, "$.messages"), lambda m: _text_blocks(m))))
    return not_blank(F.concat(*parts))


def request_text(payload: Column, dedupe_blocks: bool = True) -> Column:
    return F.array_join(request_texts(payload, dedupe_blocks), "\n")


def stream_request_text(payload: Column) -> Column:
    """As ``request_text`` for streamed requests: a prompt list is joined by blanks."""
    doc = parsed(payload)
    prompts = F.transform(_array(doc, "$.prompt"), lambda p: F.coalesce(F.try_variant_get(p, "$", "string"), F.lit("")))
    joined = F.when(F.size(prompts) > 0, F.array_join(prompts, " "))
    return F.array_join(not_blank(F.concat(message_texts(doc), _list(_string(doc, "$.prompt"), joined))), "\n")


def flattened_content(message: Column) -> Column:
    """One message's content: the string, or the text of all its blocks joined by blanks."""
    doc = parsed(message)
    blocks = F.transform(_array(doc, "$.content"), lambda b: F.coalesce(_string(b, "$.text"), F.lit("")))
    return F.coalesce(_string(doc, "$.content"), F.array_join(blocks, " "))


def response_texts(payload: Column) -> Column:
    """Generated texts: choices (message, delta, text), then text blocks."""
    doc = parsed(payload)
    choices = F.flatten(
        F.transform(
            _array(doc, "$.choices"),
            lambda c: _list(_string(c, "$.message.content"), _string(c, "$.delta.content"), _string(c, "$.text")),
        )
    )
    return not_blank(F.concat(choices, _text_blocks(doc)))


def response_text(payload: Column) -> Column:
    return F.array_join(response_texts(payload), "\n")


def usage(payload: Column) -> Column:
    """Struct of input and output token counts, 0 where the response names none."""
    doc = parsed(payload)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(doc, f"$.usage.{n}", "long") for n in names], F.lit(0).cast("long"))

    return F.struct(
        first("prompt_tokens", "input_tokens").alias("input_tokens"),
        first("completion_tokens", "output_tokens").alias("output_tokens"),
    )


def estimated_tokens(text: Column) -> Column:
    """Words plus single punctuation marks, an estimate that needs no vocabulary."""
    return F.size(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))


def budget_text(payload: Column, mode: str = "top_level") -> Column:
    """What the token limit looks at: the top-level strings, or all texts of the request."""
    if mode == "all_text":
        return F.array_join(request_texts(payload), " ")
    if mode != "top_level":
        raise ValueError(f"unknown mode: {mode}")
    # string members only: the JSON text of a string starts with a quote
    members = F.from_json(payload, "map<string,variant>")
    strings = F.filter(F.map_values(members), _is_string)
    return F.array_join(F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), " ")


def token_counts(payload: Column, mode: str = "top_level", limit: int = MAX_INPUT_TOKENS, prefix: str = "") -> list[Column]:
    """The token count of a request and whether it exceeds the limit."""
    n = estimated_tokens(budget_text(payload, mode))
    return [n.alias(f"{prefix}token_count"), (n > limit).alias(f"{prefix}rejected")]


def token_budget(df: DataFrame, keys: list[str], payload: str, limit: int = MAX_INPUT_TOKENS, mode: str = "top_level") -> DataFrame:
    """Adds the token count of each request and whether it exceeds the limit."""
    return df.select(*keys, *token_counts(F.col(payload), mode, limit))
