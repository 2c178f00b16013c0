"""Queries over captured request and response documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.operators import payload as P
from textguard.operators.pii import mask_response
from textguard.operators.providers import normalized_response, request_settings, to_cohere, to_gemini
from textguard.plans.decision_queries import messages, messages_sql
from textguard.plans.fixtures import texts_sql
from textguard.plans.text_queries import masked_sql
from textguard.sources.tables import spread


def quoted(col: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.array(col)), r"(?s)^\[(.*)\]$", 1)


def requests(spark, sf_dir):
    """One request document per message: string or block contents, no/string/list prompt."""
    m = messages(spark, sf_dir)
    odd = (F.col("conv_id") + F.col("turn")) % 2 == 1
    text = quoted(F.col("text"))
    blocks = F.concat(
        F.lit('[{"type":"text","text":'), text,
        F.lit('},{"type":"image","text":"not shown"},{"type":"text","text":"tail block"},{"type":"text","text":"  "}]'),
    )
    prompt = (
        F.when(F.col("turn") % 3 == 1, F.lit(',"prompt":"continue please"'))
        .when(F.col("turn") % 3 == 2, F.lit(',"prompt":["first part","","second part"]'))
        .otherwise("")
    )
    payload = F.concat(
        F.lit('{"model":"small","stream":false,"max_tokens":64,"messages":[{"role":"system","content":"You are helpful."},{"role":'),
        quoted(F.col("role")), F.lit(',"content":'), F.when(odd, blocks).otherwise(text), F.lit("}]"), prompt, F.lit("}"),
    )
    return spread(m, "conv_id").select("conv_id", "turn", "text", payload.alias("payload"))


_ODD = "(conv_id + turn) % 2 = 1"
_MESSAGE = f"'You are helpful.' || chr(10) || text || CASE WHEN {_ODD} THEN chr(10) || 'tail block' ELSE '' END"
_PROMPT = (
    "CASE turn % 3 WHEN 1 THEN chr(10) || 'continue please' "
    "WHEN 2 THEN chr(10) || 'first part' || {} || 'second part' ELSE '' END"
)


def extract_request(spark, sf_dir):
    return requests(spark, sf_dir).select(
        "conv_id", "turn",
        P.request_text(F.col("payload")).alias("request_text"),
        P.request_text(F.col("payload"), dedupe_blocks=False).alias("request_text_twice"),
    )


EXTRACT_REQUEST_SQL = f"WITH {messages_sql()}" + f"""m AS (SELECT conv_id, turn, text FROM messages)
SELECT conv_id, turn, {_MESSAGE} || {_PROMPT.format("chr(10)")} AS request_text,
       {_MESSAGE} || {_PROMPT.format("chr(10)")} || CASE WHEN {_ODD} THEN chr(10) || text || chr(10) || 'tail block' ELSE '' END AS request_text_twice
FROM m"""


def extract_request_stream(spark, sf_dir):
    return requests(spark, sf_dir).select("conv_id", "turn", P.stream_request_text(F.col("payload")).alias("request_text"))


EXTRACT_STREAM_SQL = f"WITH {messages_sql()}" + f"""m AS (SELECT conv_id, turn, text FROM messages)
SELECT conv_id, turn, {_MESSAGE} || {_PROMPT.format("'  '")} AS request_text FROM m"""


def flatten_content(spark, sf_dir):
    """The contents of all messages of a request as the batch scan reads them: all blocks, whatever their type."""
    messages_ = F.try_variant_get(P.parsed(F.col("payload")), "$.messages", "array<variant>")
    d = requests(spark, sf_dir).select("conv_id", "turn", F.posexplode(messages_).alias("place", "m"))
    return d.select("conv_id", "turn", "place", P.flattened_content(F.to_json("m")).alias("content"))


FLATTEN_SQL = f"WITH {messages_sql()}" + f"""m AS (SELECT conv_id, turn, text FROM messages)
SELECT conv_id, turn, 0 AS place, 'You are helpful.' AS content FROM m UNION ALL
SELECT conv_id, turn, 1 AS place, text || CASE WHEN {_ODD} THEN ' not shown tail block   ' ELSE '' END AS content FROM m"""


def token_budget(spark, sf_dir):
    r = requests(spark, sf_dir).select("conv_id", "turn", *P.token_counts(F.col("payload"), "all_text", 512), *P.token_counts(F.col("payload"), "top_level", 4, "top_level_"))
    return r.withColumnsRenamed({"top_level_token_count": "top_level_tokens"})


_TOKENS = r"len(regexp_extract_all({}, '[\pL\pN_]+|[^\pL\pN_\s]'))"
TOKEN_SQL = f"WITH {messages_sql()}" + f"""m AS (SELECT conv_id, turn, text, {_MESSAGE} || {_PROMPT.format("chr(10)")} AS t FROM messages),
n AS (SELECT conv_id, turn, CAST({_TOKENS.format("replace(t, chr(160), ' ')")} AS INTEGER) AS token_count,
             CASE turn % 3 WHEN 1 THEN 3 ELSE 1 END AS top_level_tokens FROM m)
SELECT *, token_count > 512 AS rejected, top_level_tokens > 4 AS top_level_rejected FROM n"""


def responses(spark, sf_dir):
    """One response document per message: choices, text blocks, or nothing."""
    m = spread(messages(spark, sf_dir), "conv_id")
    text, kind = quoted(F.col("text")), (F.col("conv_id") + F.col("turn")) % 3
    n = F.length("text").cast("string")
    choices = F.concat(
        F.lit('{"id":"r1","object":"chat.completion","model":"small","choices":[{"index":0,"message":{"role":"assistant","tool_calls":[{"id":"t1","function":{"name":"f","arguments":"{}"}}],"content":'), text,
        F.lit('},"finish_reason":"stop"},{"index":1,"delta":{"content":"more at info@corp.example"}},{"index":2,"text":"old form"}],"system_fingerprint":"fp1","usage":{"details":{"cached":1},"prompt_tokens":'),
        (F.col("turn") + 10).cast("string"), F.lit(',"completion_tokens":'), n, F.lit("}}"),
    )
    blocks = F.concat(
        F.lit('{"id":"r2","type":"message","content":[{"type":"text","text":'), text,
        F.lit('},{"type":"tool_use","name":"search","input":{"q":"x"},"text":"not shown"}],"usage":{"input_tokens":'), (F.col("turn") + 20).cast("string"),
        F.lit(',"output_tokens":'), n, F.lit("}}"),
    )
    empty = F.lit('{"choices":[{"message":{"content":null}}],"content":[]}')
    return m.select("conv_id", "turn", F.when(kind == 0, choices).when(kind == 1, blocks).otherwise(empty).alias("payload"))


_RESPONSE = (
    "CASE (conv_id + turn) % 3 WHEN 0 THEN text || chr(10) || 'more at info@corp.example' || chr(10) || 'old form' "
    "WHEN 1 THEN text ELSE '' END"
)


def extract_response(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", P.response_text(F.col("payload")).alias("response_text"))


EXTRACT_RESPONSE_SQL = f"WITH {messages_sql()}" + f"""m AS (SELECT conv_id, turn, text FROM messages)
SELECT conv_id, turn, {_RESPONSE} AS response_text FROM m"""


def mask_output(spark, sf_dir):
    d = mask_response(responses(spark, sf_dir), "payload", "masked_payload")
    return d.select(
        "conv_id", "turn",
        P.response_text(F.coalesce("masked_payload", "payload")).alias("response_text"),
        F.col("masked_payload").isNotNull().alias("changed"),
        F.col("masked_payload").alias("document"),
    )


def mask_output_sql():
    answers = f"answers AS (SELECT conv_id, turn, msg_id, {_RESPONSE} AS answer FROM messages),\n"
    ctes = masked_sql("msg_id", messages_sql() + answers + texts_sql("answers", "msg_id", "answer"))
    return f"""WITH {ctes},
m AS (SELECT conv_id, turn, answer, masked, regexp_extract(masked, 'more at ([^\n]*)\nold form$', 1) AS more, n
      FROM answers LEFT JOIN masked USING (msg_id) JOIN (SELECT conv_id, turn, length(text) AS n FROM messages) USING (conv_id, turn))
SELECT conv_id, turn, coalesce(masked, answer) AS response_text, masked IS NOT NULL AS changed,
  CASE WHEN masked IS NULL THEN NULL WHEN (conv_id + turn) % 3 = 0 THEN
    '{{"choices":[{{"finish_reason":"stop","index":0,"message":{{"content":' || to_json(masked[:length(masked) - length(more) - 18])
    || ',"role":"assistant","tool_calls":[{{"function":{{"arguments":"{{}}","name":"f"}},"id":"t1"}}]}}}},{{"delta":{{"content":'
    || to_json('more at ' || more) || '}},"index":1}},{{"index":2,"text":"old form"}}],"id":"r1","model":"small","object":"chat.completion",'
    || '"system_fingerprint":"fp1","usage":{{"completion_tokens":' || n || ',"details":{{"cached":1}},"prompt_tokens":' || (turn + 10) || '}}}}'
  ELSE '{{"content":[{{"text":' || to_json(masked) || ',"type":"text"}},{{"input":{{"q":"x"}},"name":"search","text":"not shown","type":"tool_use"}}],'
    || '"id":"r2","type":"message","usage":{{"input_tokens":' || (turn + 20) || ',"output_tokens":' || n || '}}}}' END AS document
FROM m"""


def usage(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", P.usage(F.col("payload")).alias("u")).select(
        "conv_id", "turn", "u.input_tokens", "u.output_tokens"
    )


USAGE_SQL = f"WITH {messages_sql()}" + """m AS (SELECT conv_id, turn, text, (conv_id + turn) % 3 AS kind FROM messages)
SELECT conv_id, turn, CASE kind WHEN 0 THEN turn + 10 WHEN 1 THEN turn + 20 ELSE 0 END AS input_tokens,
       CASE WHEN kind < 2 THEN CAST(length(text) AS BIGINT) ELSE 0 END AS output_tokens FROM m"""


def normalize_provider(spark, sf_dir):
    """Responses as four providers send them, read into one table."""
    m = spread(messages(spark, sf_dir), "conv_id")
    text, turn = quoted(F.col("text")), F.col("turn").cast("string")
    provider = F.get(F.array(*[F.lit(p) for p in ("gemini", "cohere", "anthropic", "openai")]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    body = (
        F.when(F.col("provider") == "gemini", F.concat(
            F.lit('{"candidates":[{"content":{"parts":[{"text":'), text, F.lit('},{"inlineData":{}},{"text":"part two"}]}}],"usageMetadata":{"promptTokenCount":'), turn, F.lit(',"candidatesTokenCount":7}}')))
        .when(F.col("provider") == "cohere", F.concat(
            F.lit('{"id":"c","message":{"content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), text, F.lit('},{"type":"text","text":"part two"}]},"meta":{"tokens":{"input_tokens":'), turn, F.lit(',"output_tokens":8}}}')))
        .when(F.col("provider") == "anthropic", F.concat(
            F.lit('{"content":[{"type":"thinking","thinking":"hm"},{"type":"text","text":'), text, F.lit('},{"type":"text","text":"part two"}],"usage":{"input_tokens":'), turn, F.lit(',"output_tokens":9}}')))
        .otherwise(F.concat(
            F.lit('{"choices":[{"message":{"role":"assistant","content":'), text, F.lit('}},{"message":{"role":"assistant","content":"part two"}}],"usage":{"prompt_tokens":'), turn, F.lit(',"completion_tokens":6}}')))
    )
    d = m.select("conv_id", "turn", "text", provider.alias("provider")).select("*", body.alias("payload"))
    return d.select("conv_id", "turn", "provider", normalized_response(F.col("provider"), F.col("payload")).alias("n")).select(
        "conv_id", "turn", "provider", "n.content", "n.input_tokens", "n.output_tokens"
    )


NORMALIZE_SQL = f"WITH {messages_sql()}" + """m AS (SELECT conv_id, turn, text, CAST((conv_id + turn) % 4 AS INT) AS kind FROM messages)
SELECT conv_id, turn, (['gemini', 'cohere', 'anthropic', 'openai'])[kind + 1] AS provider, text || chr(10) || 'part two' AS content,
       turn AS input_tokens, CAST((ARRAY[7, 8, 9, 6])[kind + 1] AS BIGINT) AS output_tokens FROM m"""


def provider_requests(spark, sf_dir):
    """Each message as a three-message chat, in the request forms of two providers."""
    m = messages(spark, sf_dir)

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chat = F.array(
        message("system", F.lit("Be brief.")), message("user", F.lit("Hello")),
        message("assistant", F.concat(F.lit("Hi, turn "), F.col("turn").cast("string"))), message("user", F.col("text")),
    )
    d = m.select("conv_id", "turn", chat.alias("c")).select(
        "conv_id", "turn", to_gemini(F.col("c")).alias("g"), to_cohere(F.col("c")).alias("h"))
    return d.select(
        "conv_id", "turn",
        F.array_join(F.transform("g.contents", lambda x: F.concat(x["role"], F.lit("="), x["parts"][0]["text"])), "|").alias("gemini_contents"),
        F.col("g.system_instruction").alias("gemini_system"),
        F.col("h.message").alias("cohere_message"),
        F.array_join(F.transform("h.chat_history", lambda x: F.concat(x["role"], F.lit("="), x["message"])), "|").alias("cohere_history"),
        F.col("h.preamble").alias("cohere_preamble"),
    )


PROVIDER_REQUESTS_SQL = f"WITH {messages_sql()}" + """m AS (SELECT conv_id, turn, text FROM messages)
SELECT conv_id, turn, 'user=Hello|model=Hi, turn ' || turn || '|user=' || text AS gemini_contents, 'Be brief.' AS gemini_system,
       text AS cohere_message, 'USER=Hello|CHATBOT=Hi, turn ' || turn || '|USER=' || text AS cohere_history, 'Be brief.' AS cohere_preamble
FROM m"""


SETTINGS = ['{"messages":[]}', '{"model":"google/gemini-x","max_tokens":64}', '{"model":"cohere/c-1","temperature":0.7}']


def provider_settings(spark, sf_dir):
    """What requests with and without settings of their own become for two providers."""
    payload = F.get(F.array(*[F.lit(s) for s in SETTINGS]), ((F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    provider = F.get(F.array(F.lit("gemini"), F.lit("cohere"), F.lit("groq")), (F.col("conv_id") % 3).cast("int"))
    d = messages(spark, sf_dir).select("conv_id", "turn", provider.alias("provider"), request_settings(provider, payload).alias("s"))
    return d.select("conv_id", "turn", "provider", "s.*")


SETTINGS_SQL = """SELECT conv_id, turn, provider,
  CASE WHEN provider = 'groq' THEN NULL WHEN k = 0 THEN CASE provider WHEN 'gemini' THEN 'gemini-2.0-flash' ELSE 'command-r-plus-08-2024' END
       WHEN k = 1 THEN CASE provider WHEN 'gemini' THEN 'gemini-x' ELSE 'google/gemini-x' END
       ELSE CASE provider WHEN 'gemini' THEN 'cohere/c-1' ELSE 'c-1' END END AS model,
  CASE WHEN provider <> 'groq' THEN CASE k WHEN 1 THEN 64 ELSE 4096 END END::BIGINT AS max_tokens,
  CASE WHEN provider <> 'groq' THEN CASE WHEN k = 2 THEN 0.7 WHEN provider = 'gemini' THEN 1.0 ELSE 0.3 END END::DOUBLE AS temperature
FROM (SELECT conv_id, turn, (['gemini', 'cohere', 'groq'])[CAST(conv_id % 3 AS INT) + 1] AS provider, (conv_id + turn) % 3 AS k FROM conversations)"""


def entries():
    return {
        "provider_settings": (provider_settings, SETTINGS_SQL),
        "extract_request": (extract_request, EXTRACT_REQUEST_SQL),
        "extract_request_stream": (extract_request_stream, EXTRACT_STREAM_SQL),
        "flatten_content": (flatten_content, FLATTEN_SQL),
        "token_budget": (token_budget, TOKEN_SQL),
        "extract_response": (extract_response, EXTRACT_RESPONSE_SQL),
        "mask_output": (mask_output, mask_output_sql()),
        "usage": (usage, USAGE_SQL),
        "normalize_provider": (normalize_provider, NORMALIZE_SQL),
        "provider_requests": (provider_requests, PROVIDER_REQUESTS_SQL),
    }
