"""Removal of long repeated byte strings, with suffix arrays.

A string of ``length`` bytes that starts at two places of the corpus is removed at all of them.

1. Every start gets a key: the smallest hash of the ``GRAM``-byte strings inside its string. Equal
   strings have equal keys, and neighbouring starts mostly share one, so keys come in runs.
2. Runs whose key occurs once have no equal anywhere. The others become contexts: the bytes of all
   strings that start in the run. Equal contexts are combined before they move.
3. The contexts of a key meet. Their bytes are cut into short tokens where byte pairs say so, a
   suffix array of the tokens is built by linear grouping (``suffix_groups``), and the bytes in front of a token
   are put in front of it in the order. Equal strings are then neighbours, which is checked byte by byte.
4. Starts go back to their documents, where overlapping strings join into spans.

Keys with very many runs get two further hashes, so their contexts divide; a key that still has very many
different contexts is settled by counting its strings one by one. No cap drops anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import join_groups, join_same, marks_of, parted, released, stored
from textguard.llm.suffix_groups import suffix_array

LENGTH = 200
GRAM = 64
#: Runs of a key beyond which it is divided by further hashes.
HOT = 1000
#: Bytes of one key's contexts that are sorted together; more are settled string by string.
TOGETHER = 4 << 20
#: Bytes of the contexts of many keys that share one suffix array.
BATCH = 1 << 18
#: Bytes of a text worked on at a time, of short texts worked on together, and starts in one context at most.
WINDOW = 1 << 22
TEXTS = 1 << 15
RUN = 1 << 14

_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Byte pairs between which a token ends: about one in twenty-five, and equal bytes.
_CUT = np.random.default_rng(11).random((256, 256)) < 0.04
_CUT |= np.eye(256, dtype=bool)


def _words(data: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each of the first ``count`` positions as one integer, little end first."""
    return np.ndarray((count,), "<u8", data, strides=(1,))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes, never 0: strings of eight bytes are joined two by two."""
    h, size = _words(data, len(data) - 7) * _ODD[0], 8
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * _ODD[step % 61] + h[step:]
        size += step
    return _mixed(h) | np.uint64(1)


def keys_of(data: np.ndarray, length: int, gram: int, level: int = 0) -> np.ndarray:
    """The key of every string of ``length`` bytes; each ``level`` uses other hashes."""
    h = _gram_hashes(data, gram)
    if level:
        h = _mixed(h + _ODD[20 + level])
    return _sliding(h, length - gram + 1, np.minimum)


def runs_of(data: np.ndarray, length: int, gram: int, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, end of starts, key, and at how many places the key's smallest string occurs, of every run of starts.

    ``begins`` tells where the texts that ``data`` consists of begin, and where the last one ends (one text, if left out).
    """
    begins = np.array([0, len(data)]) if begins is None else begins
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(data, gram)
    keys = _sliding(h, length - gram + 1, np.minimum)
    # strings that reach into the next text have no key
    over = np.zeros(len(data) + 1, np.int32)
    np.add.at(over, np.maximum(begins[1:-1] - length + 1, 0), 1)
    np.add.at(over, begins[1:-1], -1)
    keys[np.cumsum(over[: len(keys)]) > 0] = 0
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    end = np.append(first[1:], len(keys))
    some = keys[first] > 0
    first, end = first[some], end[some]
    # positions that are the smallest of some string: those of a run are neighbours, and come in the order of runs
    pad = np.zeros(length - gram, np.uint64)
    least = np.flatnonzero(h == _sliding(np.concatenate([pad, keys, pad]), length - gram + 1, np.maximum))
    text = np.searchsorted(begins, least, side="right")
    new = np.flatnonzero(np.concatenate([[True], (h[least[1:]] != h[least[:-1]]) | (text[1:] != text[:-1])])[: len(least)])
    return first, end, keys[first].view(np.int64), np.diff(np.append(new, len(least)))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (no nulls) as they lie one after the other, and where each begins and the last one ends."""
    _, ends, raw = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    return np.frombuffer(raw or b"", np.uint8), ends


def _parts(ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(text, begins, at): short texts together, from ``text`` on; of a long one a window, from its byte ``at`` on."""
    row = 0
    while row < len(ends) - 1:
        size = int(ends[row + 1] - ends[row])
        if size > TEXTS:
            for at in range(0, max(size - length + 1, 0), WINDOW):
                yield row, ends[row] + np.array([at, min(at + WINDOW + length - 1, size)]), at
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + TEXTS, side="right")) - 1)
        yield row, ends[row : end + 1], 0
        row = end


def _all_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, ends = _bytes_of(batch.column("t"))
            hashes = batch.column("th").to_numpy()
            for text, begins, at in _parts(ends, length):
                begins = begins - begins[0]
                a = int(ends[text]) + at
                first, end, keys, weight = runs_of(raw[a : a + int(begins[-1])], length, gram, begins)
                # no context is longer than a fixed size
                cuts = -(-(end - first) // RUN)
                own = np.repeat(np.arange(len(first)), cuts)
                step = np.arange(len(own)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                lo = first[own] + step * RUN
                hi = np.minimum(lo + RUN, end[own])
                of = np.searchsorted(begins, lo, side="right") - 1
                lo, hi = lo - begins[of] + at, hi - begins[of] + at
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(text + of)), pa.array(hashes[text + of]), pa.array(lo), pa.array(hi), pa.array(keys[own]), pa.array(weight[own])],
                    ["id", "th", "lo", "hi", "key", "weight"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "th", "t").mapInArrow(run, f"id {kind}, th long, lo long, hi long, key long, weight long")


def _contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """id, th, key, lo, ctx of the runs in ``runs`` (lo, hi, key, hot); hot ones are divided by two further hashes."""

    def divided(data: np.ndarray, key: int) -> Iterator[tuple[int, int, bytes]]:
        second, third = keys_of(data, length, gram, 1), keys_of(data, length, gram, 2)
        sub = _mixed(_mixed(np.uint64(key & (2**64 - 1)) + second) + third).view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        for a, b in zip(first.tolist(), np.append(first[1:], len(sub)).tolist()):
            yield int(sub[a]), a, data[a : b + length - 1].tobytes()

    def run(batches):
        for batch in batches:
            raw, ends = _bytes_of(batch.column("t"))
            each, own = batch.column("runs").flatten(), np.repeat(np.arange(batch.num_rows), batch.column("runs").value_lengths())
            lo, hi, keys = (each.field(f).to_numpy() for f in ("lo", "hi", "key"))
            hot = each.field("hot").to_numpy(zero_copy_only=False)
            begin, size = ends[own] + lo, hi - lo + length - 1
            for at in range(0, len(own), 1024):
                some = range(at, min(at + 1024, len(own)))
                rows = []
                for i, a, b in zip(some, begin[some].tolist(), (begin + size)[some].tolist()):
                    if hot[i]:
                        rows += [(i, key, int(lo[i]) + off, ctx) for key, off, ctx in divided(raw[a:b], int(keys[i]))]
                    else:
                        rows.append((i, keys[i], lo[i], raw[a:b].tobytes()))
                for begun in range(0, len(rows), 4096):
                    i, key, start, ctx = zip(*rows[begun : begun + 4096])
                    of = pa.array(own[list(i)])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(of), batch.column("th").take(of), pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(ctx, pa.binary())],
                        ["id", "th", "key", "lo", "ctx"],
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "th", "t", "runs").mapInArrow(run, f"id {kind}, th long, key long, lo long, ctx binary")


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different contexts: which of its starts have a string that starts at another place of one of them."""
    data = np.frombuffer(b"".join(contexts) + bytes(length + 8), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    # tokens end between certain byte pairs, and at the ends of contexts
    cut = np.zeros(n + 1, bool)
    cut[1:n] = _CUT[data[: n - 1], data[1:n]]
    cut[begin] = cut[n] = True
    token_at = np.flatnonzero(cut)
    token_of = np.cumsum(cut[:n]) - 1
    left = token_at[token_of + 1] - np.arange(n)  # bytes up to the end of the token
    reach = np.minimum(left, length)
    # names of whole tokens in the order of their bytes
    raw, heads = data.tobytes(), token_at[:-1]
    tokens = [raw[a:b] for a, b in zip(heads.tolist(), (heads + reach[heads]).tolist())]
    number = {token: i for i, token in enumerate(sorted(set(tokens)))}
    names = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    rank = np.zeros(len(heads) + 1, np.int64)
    rank[suffix_array(names)] = np.arange(1, len(heads) + 1)
    # starts in the order of the bytes up to the next token, then of the suffix that begins there; equal strings have the same ``reach``
    start = np.concatenate([np.arange(b, b + s - length + 1) for b, s in zip(begin, sizes)])
    after = reach[start] * (len(heads) + 1) + rank[token_of[start] + 1]
    order, less = [], 0
    for most in (*(w for w in (8, 16, 32, 64) if w < length), length):
        some = np.flatnonzero((reach[start] > less) & (reach[start] <= most))
        at, columns, less = start[some], [], most
        for j in range(0, most, 8):
            # the bytes up to the end of the token, eight by eight, in their own order, then zeros
            shift = (np.uint64(8) - np.clip(reach[at] - j, 0, 8).astype(np.uint64)) * np.uint64(8)
            word = _words(data[j:], n)[at].byteswap()
            columns.append(np.where(shift < 64, (word >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0)))
        order.append(at[np.lexsort([after[some], *reversed(columns)])])
    order = np.concatenate(order)
    # neighbours that are equal
    equal = np.arange(max(len(order) - 1, 0))
    for j in (*range(0, length - 7, 8), length - 8):
        w = _words(data[j:], n)
        equal = equal[w[order[equal + 1]] == w[order[equal]]]
    twice = np.zeros(n, bool)
    twice[order[equal + 1]] = True
    twice[order[equal]] = True
    return [twice[b : b + s - length + 1] for b, s in zip(begin, sizes)]


def _intervals(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_FOUND = "key long, c1 long, c2 long, starts array<struct<from:long,to:long>>, rest binary, n long"


def _settle(groups: DataFrame, length: int) -> DataFrame:
    """Repeated starts of every context. ``groups`` (key, c1, c2, ctx, n) has the contexts of a key next to each other.

    A context of a key with too many bytes comes back whole in ``rest``.
    """
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
             pa.array([r[3] for r in rows], kind), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.int64())],
            ["key", "c1", "c2", "starts", "rest", "n"],
        )

    def solve(held):
        """Rows of the groups in ``held``: several contexts share one suffix array; a lone one that has copies is repeated as it is."""
        rows, sort = [], []
        for group in held:
            alone = len(group) == 1
            for key, c1, c2, ctx, n in group:
                if alone and n > 1:
                    rows.append((key, c1, c2, [{"from": 0, "to": len(ctx) - length + 1}], None, n))
                else:
                    sort.append((key, c1, c2, ctx, n))
        if sort:
            for (key, c1, c2, ctx, n), flags in zip(sort, repeated_starts([s[3] for s in sort], length)):
                if n > 1:
                    flags = np.ones(len(ctx) - length + 1, bool)
                if flags.any():
                    rows.append((key, c1, c2, _intervals(flags), None, n))
        return rows

    def run(batches):
        held, held_bytes, key, group, size = [], 0, None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "ctx", "n"))):
                if row[0] != key:
                    if size > TOGETHER:
                        yield out([(*g[:3], None, *g[3:]) for g in group])
                    elif group:
                        held.append(group)
                        held_bytes += size
                    if held_bytes > BATCH:
                        yield out(solve(held))
                        held, held_bytes = [], 0
                    key, group, size = row[0], [], 0
                group.append(row)
                size += len(row[3])
                if size > TOGETHER and len(group) >= 64:  # too many: they leave as they come
                    yield out([(*g[:3], None, *g[3:]) for g in group])
                    group = []
        if size > TOGETHER:
            yield out([(*g[:3], None, *g[3:]) for g in group])
        elif group:
            held.append(group)
        if held:
            yield out(solve(held))

    return groups.select("key", "c1", "c2", "ctx", "n").mapInArrow(run, _FOUND)


def _one_by_one(rest: DataFrame, length: int) -> DataFrame:
    """Repeated starts of the contexts in ``rest``, by counting every string."""
    starts = F.sequence(F.lit(0).cast("long"), F.octet_length("rest").cast("long") - length)
    strings = rest.select("key", "c1", "c2", "n", "rest", F.explode(starts).alias("from"))
    strings = strings.select("key", "c1", "c2", "n", "from", F.substring("rest", F.col("from").cast("int") + 1, F.lit(length)).alias("s"))
    strings = strings.withColumn("s1", F.xxhash64("s")).withColumn("s2", F.xxhash64(F.lit(1), "s")).drop("s")
    counts = stored(strings.groupBy("s1", "s2").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("w")).where("places > 1"))
    met = join_groups(strings, counts, ["s1", "s2"], "w", F.col("c1")).where("places IS NOT NULL")
    one = F.struct(F.col("from"), (F.col("from") + 1).alias("to"))
    return met.groupBy("key", "c1", "c2").agg(F.collect_list(one).alias("starts"), F.first("n").alias("n"))


def _cut_out(texts: DataFrame, length: int) -> DataFrame:
    """id, n_bytes, spans, kept bytes of texts (id, t, starts)."""
    kind = texts.schema["id"].dataType

    spans_kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches):
        for batch in batches:
            raw, ends = _bytes_of(batch.column("t"))
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                data = raw[ends[i] : ends[i + 1]].tobytes()
                spans: list[list[int]] = []
                starts = batch.column("starts")[i].values
                found = [] if starts is None else sorted(zip(starts.field("from").to_pylist(), starts.field("to").to_pylist()))
                for a, b in found:
                    b += length - 1
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                edges = [0, *(e for s in spans for e in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                held.append((len(data), [{"from": a, "to": b} for a, b in spans], kept))
                size += len(kept)
                if size > WINDOW or i + 1 == batch.num_rows:
                    n, spans_of, kept_of = zip(*held)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(first, len(held)), pa.array(n, pa.int64()), pa.array(spans_of, spans_kind), pa.array(kept_of, pa.binary())],
                        ["id", "n_bytes", "spans", "kept"],
                    )
                    first, held, size = i + 1, [], 0

    return texts.select("id", "t", "starts").mapInArrow(
        run, f"id {kind.simpleString()}, n_bytes long, spans array<struct<from:long,to:long>>, kept binary"
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (maximal removed runs of bytes, end exclusive), ``kept`` (binary).

    Texts are UTF-8 bytes; a null text is empty. Every byte covered by a string of ``length`` bytes that
    also starts at another place of any document (the same one included) is removed. Matches do not cross
    documents and are judged on the input. Rows repeated with the same id and text are documents of their
    own, and repeat each other. Null ids, empty tables and other columns of any name are fine.
    ``gram`` is a multiple of 8 and at most ``length``.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    runs = _all_runs(own, length, gram)
    keys = released(runs.groupBy("key").agg(F.sum("weight").alias("places"), F.count(F.lit(1)).alias("w")).where("places > 1"))
    met = join_groups(runs, keys, ["key"], "w", F.xxhash64("id", "th", "lo")).where("places IS NOT NULL")
    one = F.struct("lo", "hi", "key", (F.col("w") > HOT).alias("hot"))
    per_doc = released(met.groupBy("id", "th").agg(F.collect_set(one).alias("runs")))
    # texts that surely have no runs neither move nor are stored
    some, none = parted(own, stored(marks_of(per_doc, ["id", "th"])), ["id", "th"])
    texts = released(join_same(some, per_doc, ["id", "th"]))
    touched = texts.where("runs IS NOT NULL")

    contexts = _contexts(touched, length, gram)
    c1, c2 = F.xxhash64("ctx").alias("c1"), F.xxhash64(F.lit(1), "ctx").alias("c2")
    groups = contexts.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n")).select("key", c1, c2, "ctx", "n")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = released(_settle(groups.repartition(tasks, "key").sortWithinPartitions("key"), length))
    settled = found.where("rest IS NULL").select("key", "c1", "c2", "starts", "n")
    rest = found.where("rest IS NOT NULL")
    if not rest.isEmpty():
        settled = settled.unionByName(_one_by_one(rest, length))
    settled = stored(settled)

    places = contexts.select("id", "th", "key", "lo", c1, c2)
    met = join_groups(places, settled, ["key", "c1", "c2"], "n", F.xxhash64("id", "lo")).where("starts IS NOT NULL")
    moved = F.transform("starts", lambda x: F.struct((x["from"] + F.col("lo")).alias("from"), (x["to"] + F.col("lo")).alias("to")))
    per_doc = met.groupBy("id", "th").agg(F.flatten(F.collect_list(moved)).alias("starts"))
    cut = _cut_out(join_same(touched.select("id", "th", "t"), per_doc, ["id", "th"]), length)
    no_spans = F.array().cast("array<struct<from:long,to:long>>")
    clean = texts.where("runs IS NULL").select("id", "t").unionByName(none.select("id", "t")).select(
        "id", F.octet_length("t").cast("long").alias("n_bytes"), no_spans.alias("spans"), F.col("t").cast("binary").alias("kept")
    )
    return cut.unionByName(clean).withColumnRenamed("id", id_col)
