"""Whole texts and token usage from streamed response chunks.

Chunks: request_id, provider, seq, ts, data.  ``data`` is one JSON chunk or ``[DONE]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.providers import chunk_text, chunk_usage

DONE = "[DONE]"
BLOCK = 1024
TIMEOUT = "120 seconds"


def _pieces(chunks: DataFrame) -> DataFrame:
    tokens_in, tokens_out = chunk_usage(F.col("provider"), F.col("doc"))
    d = chunks.select("*", F.try_parse_json("data").alias("doc"))
    return d.select(
        "request_id", "provider", "seq", "ts",
        (F.col("data") == DONE).alias("done"),
        chunk_text(F.col("provider"), F.col("doc")).alias("delta"),
        tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"),
    )


def _end() -> Column:
    """The place of the first end marker of a group, or null."""
    return F.min(F.when(F.col("done"), F.col("seq")))


def _before_done(items: Column, end: Column) -> Column:
    """Items in order up to the first end marker."""
    return F.filter(items, lambda x: end.isNull() | (x["seq"] < end))


def _last(items: Column, field: str) -> Column:
    known = F.filter(items, lambda x: x[field].isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1)[field])


def _item() -> Column:
    return F.struct("seq", "done", "delta", "tokens_in", "tokens_out")


def assemble(chunks: DataFrame) -> DataFrame:
    """One row per request: text and usage, from chunks in ``seq`` order until the marker.

    Two steps, so that no task collects more than a block of chunks at a time: blocks of
    consecutive chunks become strings first, then the strings of a request are joined.
    """
    block = _pieces(chunks).groupBy("request_id", "provider", F.floor(F.col("seq") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(_item())).alias("items"), _end().alias("end")
    )
    kept = _before_done(F.col("items"), F.col("end"))
    blocks = block.select(
        "request_id", "provider", "block",
        F.col("end").isNotNull().alias("done"),
        kept.alias("kept"),
    ).select(
        "request_id", "provider",
        F.struct(
            "block", "done",
            F.array_join(F.transform("kept", lambda x: x["delta"]), "").alias("delta"),
            _last(F.col("kept"), "tokens_in").alias("tokens_in"),
            _last(F.col("kept"), "tokens_out").alias("tokens_out"),
        ).alias("b"),
    )
    joined = blocks.groupBy("request_id", "provider").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    end = F.array_min(F.transform(F.filter("bs", lambda x: x["done"]), lambda x: x["block"]))
    until = F.filter("bs", lambda x: end.isNull() | (x["block"] <= end))
    return _result(joined.select("request_id", "provider", until.alias("_i")))


def _result(d: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return d.select(
        "request_id", "provider",
        F.array_join(F.transform("_i", lambda x: x["delta"]), "").alias("text"),
        F.coalesce(_last(F.col("_i"), "tokens_in"), zero).alias("input_tokens"),
        F.coalesce(_last(F.col("_i"), "tokens_out"), zero).alias("output_tokens"),
    )


def assemble_stream(chunks: DataFrame, timeout: str = TIMEOUT, lateness: str = "10 minutes") -> DataFrame:
    """The same for a stream of chunks, in append mode.

    A request is closed when no chunk came for ``timeout``; the state of one request is
    one response, which providers bound by their output limit.  Chunks later than
    ``lateness`` are dropped.
    """
    d = _pieces(chunks.withWatermark("ts", lateness))
    g = d.groupBy("request_id", "provider", F.session_window("ts", timeout)).agg(
        F.sort_array(F.collect_list(_item())).alias("items"), _end().alias("end")
    )
    return _result(g.select("request_id", "provider", _before_done(F.col("items"), F.col("end")).alias("_i")))
