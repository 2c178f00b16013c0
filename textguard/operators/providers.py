"""Requests and responses of different providers as one chat table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers in reporting order.
PROVIDERS = (
    "openai", "anthropic", "bedrock", "azure", "ollama",
    "gemini", "groq", "mistral", "cohere", "deepseek",
)
# By provider, the model of a request that names none, prefixes of model names, and the temperature.
DEFAULTS = {
    "gemini": ("gemini-2.0-flash", ("google/", "gemini/"), 1.0),
    "cohere": ("command-r-plus-08-2024", ("cohere/",), 0.3),
}
MAX_TOKENS = 4096

MESSAGES = "array<struct<role:string,content:string>>"


def _without_system(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "system")


def to_gemini(messages: Column) -> Column:
    """Contents with roles user/model; the last system message becomes the instruction."""
    contents = F.transform(
        _without_system(messages),
        lambda m: F.struct(
            F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"),
            F.array(F.struct(m["content"].alias("text"))).alias("parts"),
        ),
    )
    system = F.element_at(F.filter(messages, lambda m: m["role"] == "system")["content"], -1)
    return F.struct(
        contents.alias("contents"),
        F.when(F.exists(messages, lambda m: m["role"] == "system"), system).alias("system_instruction"),
    )


def to_cohere(messages: Column) -> Column:
    """The last user message, the history before it, and the first system message.

    User turns enter the history only when there is more than one of them.
    """
    users = F.filter(messages, lambda m: m["role"] == "user")["content"]
    many = F.size(users) > 1
    kept = F.filter(messages, lambda m: (m["role"] == "assistant") | ((m["role"] == "user") & many))
    history = F.transform(
        kept,
        lambda m: F.struct(
            F.when(m["role"] == "assistant", "CHATBOT").otherwise("USER").alias("role"),
            m["content"].alias("message"),
        ),
    )
    return F.struct(
        F.when(F.size(users) > 0, F.element_at(users, -1)).otherwise("").alias("message"),
        history.alias("chat_history"),
        F.get(F.filter(messages, lambda m: m["role"] == "system")["content"], 0).alias("preamble"),
    )


def request_settings(provider: Column, payload: Column) -> Column:
    """Struct of model, max_tokens and temperature that a chat request becomes for Gemini and Cohere; NULL for other providers."""
    doc = F.try_parse_json(payload)
    out = F.lit(None)
    for name, (model, prefixes, temperature) in DEFAULTS.items():
        named = F.coalesce(F.try_variant_get(doc, "$.model", "string"), F.lit(model))
        for prefix in prefixes:
            named = F.replace(named, F.lit(prefix), F.lit(""))
        settings = F.struct(
            named.alias("model"),
            F.coalesce(F.try_variant_get(doc, "$.max_tokens", "long"), F.lit(MAX_TOKENS)).alias("max_tokens"),
            F.coalesce(F.try_variant_get(doc, "$.temperature", "double"), F.lit(temperature)).alias("temperature"),
        )
        out = F.when(provider == name, settings).otherwise(out)
    return out


def normalized_response(provider: Column, payload: Column) -> Column:
    """Struct of text, input and output tokens from a Gemini, Cohere, Anthropic or
    OpenAI-shaped response. All texts of an answer are read, one per line: every part, text block and choice."""
    doc = F.try_parse_json(payload)

    def items(path: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))

    def string(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def tokens(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(doc, p, "long") for p in paths], F.lit(0).cast("long"))

    def joined(texts: Column) -> Column:
        return F.array_join(F.filter(texts, lambda t: t != ""), "\n")

    def blocks(path: str) -> Column:
        kinds = F.filter(items(path), lambda b: F.coalesce(string(b, "$.type"), F.lit("text")) == "text")
        return joined(F.transform(kinds, lambda b: string(b, "$.text")))

    parts = F.flatten(F.transform(items("$.candidates"), lambda c: F.coalesce(
        F.try_variant_get(c, "$.content.parts", "array<variant>"), F.array().cast("array<variant>"))))
    text = (
        F.when(provider == "gemini", joined(F.transform(parts, lambda p: string(p, "$.text"))))
        .when(provider == "cohere", F.coalesce(F.nullif(blocks("$.message.content"), F.lit("")), string(doc, "$.text")))
        .when(provider == "anthropic", blocks("$.content"))
        .otherwise(joined(F.transform(items("$.choices"), lambda c: string(c, "$.message.content"))))
    )
    tokens_in = (
        F.when(provider == "gemini", tokens("$.usageMetadata.promptTokenCount"))
        .when(provider == "cohere", tokens("$.meta.tokens.input_tokens"))
        .otherwise(tokens("$.usage.prompt_tokens", "$.usage.input_tokens"))
    )
    tokens_out = (
        F.when(provider == "gemini", tokens("$.usageMetadata.candidatesTokenCount"))
        .when(provider == "cohere", tokens("$.meta.tokens.output_tokens"))
        .otherwise(tokens("$.usage.completion_tokens", "$.usage.output_tokens"))
    )
    return F.struct(F.coalesce(text, F.lit("")).alias("content"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"))


# Providers whose stream chunks have the choices/delta form.
DELTA_PROVIDERS = ("openai", "groq", "mistral", "deepseek", "azure")


def chunk_text(provider: Column, doc: Column) -> Column:
    """The text that one stream chunk adds; empty for other chunks and providers.

    ``doc`` is the chunk as VARIANT, NULL where it is not JSON.
    """

    def at(path: str) -> Column:
        return F.try_variant_get(doc, path, "string")

    parts = F.try_variant_get(doc, "$.candidates[0].content.parts", "array<struct<text:string>>")
    text = (
        F.when(provider.isin(*DELTA_PROVIDERS), at("$.choices[0].delta.content"))
        .when((provider == "anthropic") & (at("$.type") == "content_block_delta"), at("$.delta.text"))
        .when(provider == "gemini", F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        .when((provider == "cohere") & (at("$.type") == "content-delta"), at("$.delta.message.content.text"))
    )
    return F.coalesce(text, F.lit(""))


def chunk_usage(provider: Column, doc: Column) -> tuple[Column, Column]:
    """Input and output tokens that one chunk reports; NULL leaves earlier values alone."""
    delta = provider.isin(*DELTA_PROVIDERS) & doc.isNotNull()
    anthropic = provider == "anthropic"
    kind = F.try_variant_get(doc, "$.type", "string")

    def tokens(path: str) -> Column:
        return F.coalesce(F.try_variant_get(doc, path, "long"), F.lit(0).cast("long"))

    tokens_in = F.when(delta, tokens("$.usage.prompt_tokens")).when(
        anthropic & (kind == "message_start"), tokens("$.message.usage.input_tokens")
    )
    tokens_out = F.when(delta, tokens("$.usage.completion_tokens")).when(
        anthropic & (kind == "message_delta"), tokens("$.usage.output_tokens")
    )
    return tokens_in, tokens_out
