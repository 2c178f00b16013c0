"""Masking and exposure reports for personal data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.validators import value_hash
from textguard.operators.payload import response_text
from textguard.operators.scan import matched_values
from textguard.rules import rule_pack


def _labels(rules) -> Column:
    return F.array(*[F.lit(r.label) for r in rules])


def _masks(matches: Column, rules) -> Column:
    """The distinct (value, mask) pairs of a row's matches, in finding order."""
    return F.array_distinct(
        F.transform(
            matches,
            lambda x: F.struct(
                x["match"].alias("value"),
                F.concat(F.lit("[REDACTED:"), F.get(_labels(rules), x["rule"]), F.lit("]")).alias("mask"),
            ),
        )
    )


def _masked(text: Column, masks: Column) -> Column:
    """Replace every occurrence of each value, one value after the other."""
    return F.aggregate(masks, text, lambda acc, v: F.replace(acc, v["value"], v["mask"]))


def mask(df: DataFrame, text: str, out: str = "masked", enabled: bool = True) -> DataFrame:
    """Adds the text with personal data masked; NULL where nothing was found.

    With ``enabled=False`` texts with findings are returned as they are.
    """
    rules = rule_pack(["pii"])
    d = matched_values(df, text, rules, "_matches")
    value = _masked(F.col(text), _masks(F.col("_matches"), rules)) if enabled else F.col(text)
    return d.select(*df.columns, F.when(F.size("_matches") > 0, value).alias(out))


def _json(value: Column) -> Column:
    """A variant as JSON text; a missing one as null."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _edited(doc: Column, edits: dict[str, Callable[[Column], Column]]) -> Column:
    """An object (variant) as JSON text, with the members named in ``edits`` rewritten and all others as they are."""

    def member(e: Column) -> Column:
        value = _json(e["value"])
        for name, edit in edits.items():
            value = F.when(e["key"] == name, edit(e["value"])).otherwise(value)
        return F.concat(_quoted(e["key"]), F.lit(":"), value)

    members = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(members, member), ","), F.lit("}"))
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), text).otherwise(_json(doc))


def _each(items: Column, edit: Callable[[Column], Column]) -> Column:
    """An array (variant) as JSON text with every element rewritten."""
    array = F.try_variant_get(items, "$", "array<variant>")
    text = F.concat(F.lit("["), F.array_join(F.transform(array, edit), ","), F.lit("]"))
    return F.when(F.schema_of_variant(items).startswith("ARRAY"), text).otherwise(_json(items))


def mask_response(df: DataFrame, payload: str, out: str = "masked_payload") -> DataFrame:
    """Adds each response document with personal data masked in its generated texts,
    NULL where none was found. All other members of the document stay as they are, in the order of their names.

    Values are looked for in all texts of the response together and masked in every
    text field by itself, so line breaks and quotes cannot hide them.
    """
    rules = rule_pack(["pii"])
    d = df.withColumn("_text", response_text(F.col(payload)))
    d = matched_values(d, "_text", rules, "_matches").withColumn("_masks", _masks(F.col("_matches"), rules))

    def masked(field: Column) -> Column:
        text = F.try_variant_get(field, "$", "string")
        return F.when(F.schema_of_variant(field) == "STRING", _quoted(_masked(text, F.col("_masks")))).otherwise(_json(field))

    def holder(field: Column) -> Column:
        return _edited(field, {"content": masked})

    def choice(item: Column) -> Column:
        return _edited(item, {"message": holder, "delta": holder, "text": masked})

    def block(item: Column) -> Column:
        kind = F.try_variant_get(item, "$.type", "string")
        return F.when(kind == "text", _edited(item, {"text": masked})).otherwise(_json(item))

    result = _edited(F.try_parse_json(payload), {"choices": lambda x: _each(x, choice), "content": lambda x: _each(x, block)})
    return d.select(*df.columns, F.when(F.size("_masks") > 0, result).alias(out))


def pii_values(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per personal-data match with the hash of the value, never the value."""
    rules = rule_pack(["pii"])
    d = matched_values(df.select(*keys, text), text, rules, "_matches")
    labels = _labels(rules)
    return d.select(*keys, F.inline(F.array_compact("_matches"))).select(
        *keys,
        F.get(labels, F.col("rule")).alias("label"),
        "occurrence",
        "position",
        F.length("match").alias("n_chars"),
        value_hash(F.col("match")).alias("value_hash"),
    )


def exposure(values: DataFrame, key: str, source: str, exact: bool = True) -> DataFrame:
    """Per kind of data: texts, matches, distinct values, values seen in two or more sources.

    Two steps: per value first (partial sums before the shuffle), then per label, so a
    value that fills a third of the rows is already one row when labels are summed.
    """
    if not exact:
        return values.groupBy("label").agg(
            F.approx_count_distinct(key).alias("n_texts"),
            F.count(F.lit(1)).alias("n_matches"),
            F.approx_count_distinct("value_hash").alias("n_values"),
        )
    # every branch starts from this aggregate, so that the texts are scanned once and its exchange is reused
    per_text = values.groupBy("label", "value_hash", source, key).agg(F.count(F.lit(1)).alias("n"))
    per_value = (
        per_text.groupBy("label", "value_hash", source)
        .agg(F.sum("n").alias("n"))
        .groupBy("label", "value_hash")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"))
    )
    texts = per_text.groupBy("label", key).agg(F.sum("n").alias("n")).groupBy("label").agg(F.count("n").alias("n_texts"))
    sums = per_value.groupBy("label").agg(
        F.sum("n").alias("n_matches"),
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("n_sources") >= 2).alias("n_shared_values"),
    )
    return sums.join(texts, "label").select("label", "n_texts", "n_matches", "n_values", "n_shared_values")
