"""The operators as registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import functions as F

from textguard.llm import quality
from textguard.llm.collocations import LONGEST, SUPPORT, TOP, collocations
from textguard.llm.common import stored
from textguard.llm.exact_dedup import exact_duplicates
from textguard.llm.fingerprints import CLAUSE, fingerprint, likeness, with_next
from textguard.llm.language import fit, held_out, identify
from textguard.llm.line_dedup import MIN_CHARS, MIN_DOCS, line_dedup
from textguard.llm.mixing import TARGETS, label_domain, mix
from textguard.llm.ngram_join import near_duplicates
from textguard.llm.periodic_runs import find_periodic
from textguard.llm.pii_crf import KINDS, find_pii
from textguard.llm.pii_crf import fit as fit_pii
from textguard.llm.repeat_removal import remove_repeats
from textguard.llm.sentence_pieces import decode, encode
from textguard.llm.token_counts import BUDGET, count_tokens


def op3_suffix_array_dedup(spark, sf_dir):
    out = remove_repeats(_docs(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["to"] - x["from"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_pii_crf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = find_pii(docs, fit_pii(docs))
    base = F.filter("spans", lambda s: s["base"])

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return out.select("doc_id", *map(_count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _count(kind):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


#: Folder of the public vocabularies; none of them is part of this repository.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentence_pieces(spark, sf_dir):
    """Ids of every whole text, and whether decoding them gives the text again."""
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    ids = encode(docs, model).withColumn("n_pieces", F.size("piece_ids").cast("long"))
    ids = ids.withColumn("ids_sha256", F.sha2(F.array_join("piece_ids", ","), 256))
    out = decode(ids, model)
    return out.select("doc_id", "n_pieces", "ids_sha256", (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(_docs(spark, sf_dir))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op5_token_counts(spark, sf_dir):
    out = count_tokens(_docs(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")
    return out.withColumn("over_limit", F.col("n_tokens") > BUDGET)


def op6_source_mixing(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("domain", label_domain())
    out = mix(_docs(spark, sf_dir), labels)
    shares = [F.coalesce(F.try_element_at("posterior", F.lit(d)), F.lit(0.0)).alias(f"p_{d}") for d in TARGETS]
    return out.select("doc_id", "n_words", "domain", *shares, "rate")


def op7_line_dedup(spark, sf_dir):
    out = line_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP7_SQL = f"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM doc),
keyed AS (SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS keep_id FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT doc_id, line, pos, shared.k IS NOT NULL AND doc_id <> keep_id AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_ngram_join(spark, sf_dir):
    return near_duplicates(_docs(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


def op10_fingerprints(spark, sf_dir):
    pairs = with_next(_docs(spark, sf_dir))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    out = out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _fingerprint_sql(text):
    tree = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{CLAUSE}'), lambda c: sha256(c))))"
    sections = f"""list_transform({tree}, lambda ps: {{
        'hash': sha256(array_to_string(list_transform(ps, lambda cs: sha256(array_to_string(cs, ''))), '')),
        'codes': array_to_string(list_transform(ps, lambda cs: array_to_string(list_transform(cs, lambda h: h[1:8]), '.')), ',')}})"""
    return f"""(SELECT sha256(array_to_string(list_transform(x, lambda s: s.hash), '')) || ':' ||
        array_to_string(list_transform(x, lambda s: s.hash[1:16] || '=' || s.codes), '/') FROM (SELECT {sections} AS x))"""


def _likeness_sql(a, b):
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
pairs AS (SELECT doc_id, text, n, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT doc_id, text, n, next_text, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM pairs),
fps AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_fingerprint_sql('text')} AS f, {_fingerprint_sql('edited')} AS e, {_fingerprint_sql('next_text')} AS x FROM edits),
codes AS (SELECT *, list_distinct(regexp_extract_all(f, '[=.,]([0-9a-f]{{8}})', 1)) AS cf, list_distinct(regexp_extract_all(e, '[=.,]([0-9a-f]{{8}})', 1)) AS ce,
    list_distinct(regexp_extract_all(x, '[=.,]([0-9a-f]{{8}})', 1)) AS cx FROM fps)
SELECT doc_id, n AS n_chars, edited_sha256, f AS fingerprint, e AS edited_fingerprint,
       {_likeness_sql('cf', 'ce')} AS near_edited, {_likeness_sql('cf', 'cx')} AS near_next
FROM codes
"""


def op11_quality(spark, sf_dir):
    measured = stored(quality.measure(_docs(spark, sf_dir).select("doc_id", "text")).drop("text"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    out = quality.score(measured, quality.fit(measured, labels))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_periodic_runs(spark, sf_dir):
    """Runs of the texts; in a tenth of them all words from one on repeat a stretch of the text."""
    words = F.filter(F.split(F.col("text"), r"[ \t-\r]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("_w"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    repeated = F.transform(F.col("_w"), lambda w, i: F.when(i < a, w).otherwise(F.element_at("_w", (1 + a + F.pmod(i - a, p)).cast("int"))))
    planted = F.col("_w").isNotNull() & (n > 0)
    docs = _docs(spark, sf_dir).select("doc_id", "text", F.when(F.pmod(h, F.lit(10)) == 0, words).alias("_w"))
    docs = docs.select("doc_id", F.when(planted, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    out = find_periodic(docs).select("doc_id", "periodic.*")
    top = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda m, r: F.when(m.isNull() | (r["length"] > m["length"]), r).otherwise(m))
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * top.length div top.period")
    return out.select("doc_id", "n_runs", "top.*", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_collocations(spark, sf_dir):
    return collocations(_docs(spark, sf_dir))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "chr(10) || chr(11) || chr(12) || chr(13)"
OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split(translate(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), ',;:!?' || {_MARKS}, '.........'), '.')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, (SELECT unnest(range(1, {LONGEST + 1})) AS m))),
f AS (SELECT lang, phrase, m, count(*)::HUGEINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
inside AS (SELECT DISTINCT lang, a, array_to_string(ws[i : i + s - 1], ' ') AS phrase
  FROM (SELECT lang, a, ws, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand))),
cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, k, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM (SELECT *, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 : m], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)) c
  JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
left_over AS (SELECT * FROM least ANTI JOIN inside USING (lang, phrase, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM left_over QUALIFY rank <= {TOP}
"""


def entries() -> dict:
    """Query and SQL (None where SQL cannot express it) by name."""
    return {
        "op1_sentence_pieces": (op1_sentence_pieces, None),
        "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
        "op3_suffix_array_dedup": (op3_suffix_array_dedup, None),
        "op4_pii_crf": (op4_pii_crf, None),
        "op5_token_counts": (op5_token_counts, None),
        "op6_source_mixing": (op6_source_mixing, None),
        "op7_line_dedup": (op7_line_dedup, OP7_SQL),
        "op8_ngram_join": (op8_ngram_join, None),
        "op9_language_id": (op9_language_id, None),
        "op10_fingerprints": (op10_fingerprints, OP10_SQL),
        "op11_quality": (op11_quality, None),
        "op12_periodic_runs": (op12_periodic_runs, None),
        "op13_collocations": (op13_collocations, OP13_SQL),
    }
