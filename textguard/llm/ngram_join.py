"""Near duplicates by Jaccard similarity of word n-grams: an exact join by token-combination prefixes.

Each document is the set of its distinct n-grams (64-bit hashes). Equal sets are one set from then on.

1. *Extended prefixes.* Two sets with similarity t share most of their smallest tokens in any one order.
   In the order of hashes, every set shows a prefix that is longer than needed by a twentieth of the
   set; sets of which too few of those tokens occur elsewhere have no partner and go no further.
2. *Signatures.* Over the sets that are left, tokens are counted exactly and ordered from rare to frequent.
   A token that few sets have is a signature by itself. Frequent tokens fall into classes by hash, and
   the pairs within a class are signatures. A prefix is extended until it has more signatures than a
   partner's missing tokens can spoil, so partners always share one.
3. *Verification.* Sets that share a signature are compared exactly. In a group all are first compared
   with the most central of them, the leader, which connects a group of many near copies without its pairs. What two
   sets have in common follows from how each differs from the leader and from the differences they share. If one of them
   has no link to the leader, they can only be similar if they share more than about half of the other's differences:
   the rarest of these are indexed, and only sets that meet there are compared.

Links are exact and complete between classes of connected sets: no cap on partners or on groups.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import fresh, join_groups, join_same, likely_in, measured_groups, released, stored, text_of
from textguard.llm.components import components

#: Production values of near-duplicate stages; a query may set others.
WORDS = 5
PERCENT = 80
#: A token that at most so many sets have is rare.
RARE = 16
#: Frequent tokens per class, roughly; each class gives its pairs.
CLASS = 4
#: A prefix by hash is longer by this percentage of the set.
EXTRA = 5
#: Rounds of comparing groups with one of their members.
ROUNDS = 2
#: Pairs with the same set that meet in one task, roughly.
MET = 1000

MEMORY = 300_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_words: dict[bytes, int] = {}


def _hash_word(word: bytes) -> int:
    found = _words.get(word)
    if found is None:
        if len(_words) > MEMORY:
            _words.clear()
        found = _words[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams (signed 64 bits).

    Words are runs without blanks (space, tab to carriage return), with A-Z in lower case. A text with fewer words is
    one n-gram; one without words has none.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hash_word, found), np.uint64, len(found))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = _mixed(h * _MIX[0] + w[j : len(w) - k + 1 + j])
    return np.unique(h.view(np.int64))


def _least(n, percent: int):
    """The fewest shared tokens of a set of ``n`` tokens with a partner, and the fewest tokens of the partner."""
    return -((-n * percent) // 100)


def _longer(n):
    return 1 + n * EXTRA // 100


def _show_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """id, th (hash of the text), n, f1 and f2 (128 bits of the set), prefix (array<long>) of every row."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes, marks, prefixes = [], [], []
                for text in batch.column("t").to_pylist():
                    s = shingles(text, words)
                    sizes.append(len(s))
                    marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    prefixes.append(s[: len(s) - _least(len(s), percent) + _longer(len(s))])
                both = np.array(marks).reshape(-1, 2)
                ends = pa.array(np.cumsum([0, *map(len, prefixes)], dtype=np.int32))
                flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.ListArray.from_arrays(ends, flat)],
                    ["id", "th", "n", "f1", "f2", "prefix"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th long, n long, f1 long, f2 long, prefix array<long>")


def _whole_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets = [shingles(t, words) for t in batch.column("t").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
                flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.ListArray.from_arrays(ends, flat)], ["sid", "tokens"])

    return texts.select("sid", "t").mapInArrow(run, "sid long, tokens array<long>")


def signatures(n: int, tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set of ``n`` tokens, given those that other sets have too and how many sets have each.

    The other tokens come first in the order, and spoil one signature each. Classes of frequent tokens
    depend on the size of the set; a set gives keys for its own size and for that of its smallest partner.
    """
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    lost = n - _least(n, percent)
    keys = [np.zeros(0, np.uint64)]
    for size in {int(n).bit_length(), int(_least(n, percent)).bit_length()}:
        classes = max(1, (1 << size) * (100 - percent) // (100 * CLASS))
        covered, held = n - len(tokens), {}
        for token, count in zip(tokens.view(np.uint64), counts):
            if covered > lost:
                break
            if count <= RARE:
                keys.append(np.array([token], np.uint64))
                covered += 1
                continue
            mates = held.setdefault(int(_mixed(np.array([token]) + _MIX[0])[0] % np.uint64(classes)), [])
            if mates:
                keys.append(_mixed(np.array(mates, np.uint64) * _MIX[0] + token + np.uint64(size)))
                covered += 1
            mates.append(token)
    return np.unique(np.concatenate(keys)).view(np.int64)


def _keyed(rows: DataFrame, percent: int) -> DataFrame:
    def run(parts):
        for part in parts:
            for sid, n, shared in zip(part["sid"], part["n"], part["shared"]):
                tokens = np.array([x["token"] for x in shared], np.int64)
                counts = np.array([x["n_sets"] for x in shared], np.int64)
                keys = signatures(n, tokens, counts, percent)
                # how far the set lies among others: tokens that many sets have, for each of its own
                middle = float(counts.sum()) / n
                each = {"sid": sid, "n": n, "s": len(tokens), "middle": middle}
                yield pd.DataFrame({"key": keys, **{c: np.full(len(keys), v) for c, v in each.items()}})

    return rows.mapInPandas(run, "key long, sid long, n long, s long, middle double")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b, ca) those that are similar enough. Pairs with the same ``a`` are dealt out, its tokens repeated."""
    fan, sizes = measured_groups(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("w")).withColumn("parts", F.ceil(F.col("w") / MET).cast("long")), "w")
    sets = likely_in(sets, pairs.select(F.explode(F.array("a", "b")).alias("sid")), {"sid": "sid"})
    pairs = join_groups(pairs, fan, ["a"], "w", F.col("b"), sizes).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("w", "parts")
    one = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")).join(fan, "a")
    one = one.select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    two = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(two, "b").join(one, ["a", "part"])
    return met.where(both * 100 >= (F.size("ta") + F.size("tb") - both) * percent).select("a", "b", "ca")


def _apart(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ca) that may be similar although one of the two has no link to their leader; members: p, np, sid, n, s, comp.

    With A the tokens of the leader that a set lacks and B those it has beyond them, a and b share |p| - |A_a| - |A_b| tokens and the
    differences they have in common. So they need c_a + w_b common ones, w = (100 |A| + percent |B|) / (100 + percent) and
    c_a above 0 where a has no link to p: one of any |A_b| + |B_b| - floor(w_b) differences of b is among those of a.
    """
    fan, sizes = measured_groups(members.groupBy("p").agg(F.count(F.lit(1)).alias("w")).withColumn("parts", F.ceil(F.col("w") / MET).cast("long")), "w")
    # a leader is a member of its group
    sets = likely_in(sets, members, {"sid": "sid"})
    dealt = join_groups(members, fan, ["p"], "w", F.col("sid"), sizes).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts"))).drop("w", "parts")
    leaders = sets.select(F.col("sid").alias("p"), F.col("tokens").alias("tp")).join(fan, "p")
    leaders = leaders.select("p", "tp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = dealt.join(sets.select("sid", F.col("tokens").alias("t")), "sid").join(leaders, ["p", "part"])
    met = met.select("p", "np", "sid", "n", "s", "comp", F.array_except("tp", "t").alias("lacks"), F.array_except("t", "tp").alias("has"))
    both = F.col("np") - F.size("lacks")
    away = both * 100 < (F.col("n") + F.col("np") - both) * percent
    most = F.size("lacks") + F.size("has") - F.floor((F.size("lacks") * 100 + F.size("has") * percent) / (100 + percent)).cast("int")
    met = stored(met.select("p", "sid", "n", "s", "comp", away.alias("away"), most.alias("most"), F.concat("lacks", "has").alias("delta")))
    each = met.select("p", "sid", F.explode("delta").alias("token"))
    twice, sizes = measured_groups(each.groupBy("p", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "c")
    # differences that no other set of the leader has would come first in the index and meet nobody: only their number counts
    known = join_groups(each, twice, ["p", "token"], "c", F.col("sid"), sizes).where("c IS NOT NULL")
    known = known.groupBy("p", "sid").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("d"))
    rarest = (F.col("most") - (F.size("delta") - F.size("d"))).alias("rarest")
    met = stored(met.join(known, ["p", "sid"]).select("p", "sid", "n", "s", "comp", "away", rarest, "d"))
    shared = lambda d: F.explode(F.transform(d, lambda x: x["token"])).alias("token")
    one = met.where("away").select("p", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("comp").alias("ca"), shared(F.col("d")))
    two = met.where("rarest > 0").select("p", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("comp").alias("cb"), shared(F.slice("d", F.lit(1), F.col("rarest"))))
    on = (one["p"] == two["p"]) & (one["token"] == two["token"]) & (F.col("ca") != F.col("cb")) & _near(percent)
    return one.join(two, on).select("a", "b", "ca").dropDuplicates(["a", "b"])


def _near(percent: int) -> Column:
    """Whether sizes, and tokens that others have at all, allow a link."""
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & (F.least("sa", "sb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def _connect(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``sid``, ``comp`` for the sets that share a key (key, sid, n, s, middle; s: tokens that others have) with another and have a link.

    ``labels`` names sets that are known to be connected; it may lag behind, which only costs comparisons. The
    components come from all links at the end.
    """
    own = F.struct((-F.col("middle")).alias("h"), "sid").alias("comp")
    labels, links = stored(entries.select("sid", own, F.lit(False).alias("led")).distinct()), []
    for round_ in range(ROUNDS):
        seen = entries.join(labels, "sid")
        # the most central member, of those that are not connected to others and have not been it before
        by_comp = seen.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct(~F.col("led"), "middle", "sid", "n", "s")).alias("p"))
        groups = by_comp.groupBy("key").agg(
            F.sum("c").alias("m"), F.count(F.lit(1)).alias("comps"), F.max(F.struct((F.col("c") == 1).alias("alone"), "p", "comp")).alias("first"),
        ).where("comps > 1")
        groups = groups.select("key", "m", F.col("first.p.sid").alias("a"), F.col("first.p.n").alias("na"), F.col("first.p.s").alias("sa"), F.col("first.comp").alias("ca"))
        groups, sizes = measured_groups(groups, "m")
        open_ = stored(join_groups(seen, groups, ["key"], "m", F.col("sid"), sizes).where("m IS NOT NULL"))
        star = open_.where("comp <> ca").select("a", "na", "sa", "ca", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        found = _linked(star.where(_near(percent)).select("a", "b", "ca").dropDuplicates(["a", "b"]), sets, percent)
        found = stored(found) if round_ else released(found)
        links.append(found.select("a", "b"))
        if not round_:
            # differences are measured from the first leader; a group of two is settled by now
            first = groups.select("key", F.col("a").alias("p"), F.col("na").alias("np"))
            entries = open_.where("m > 2").select("key", "sid", "n", "s", "middle")
        # a set joins the most central leader that it has a link to, and what that one has joined
        joined = found.groupBy(F.col("b").alias("sid")).agg(F.min("ca").alias("to"))
        led = groups.select(F.col("a").alias("sid"), F.lit(True).alias("leads")).distinct()
        now = labels.join(joined, "sid", "left").join(led, "sid", "left")
        now = stored(now.select("sid", F.least("comp", "to").alias("comp"), (F.col("led") | F.col("leads").isNotNull()).alias("led")))
        further = now.select(F.col("sid").alias("root"), F.col("comp").alias("further"))
        weights = now.groupBy(F.col("comp.sid").alias("root")).agg(F.count(F.lit(1)).alias("w"))
        further, sizes = measured_groups(weights.join(further, "root"), "w")
        now = now.withColumn("root", F.col("comp.sid"))
        labels = stored(join_groups(now, further, ["root"], "w", F.col("sid"), sizes).select("sid", F.coalesce("further", "comp").alias("comp"), "led"))
    seen = entries.join(labels.drop("led"), "sid")
    groups = seen.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("comp").alias("comps")).where("comps > 1").join(first, "key")
    groups, sizes = measured_groups(groups.drop("comps"), "m")
    open_ = join_groups(seen, groups, ["key"], "m", F.col("sid"), sizes).where("m IS NOT NULL")
    members = stored(open_.select("p", "np", "sid", "n", "s", "comp").distinct())
    links.append(stored(_linked(_apart(members, sets, percent), sets, percent)).select("a", "b"))
    found = components(reduce(DataFrame.unionByName, links))
    return found.select(F.col("node").alias("sid"), F.col("root").alias("comp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` (long), ``component_id`` (the smallest id reachable by links),
    ``text_hash`` and ``kept`` (true for the component's row with the smallest id, then text hash).

    Two rows link when their sets of word n-grams have 100 * intersection >= percent * union. A null or empty text and one without
    words has an empty set and links with nothing, not even with its like: its component is its own id.
    Equal sets are linked. Rows with the same id keep apart rows; a null id never names a component that
    has another id. An empty table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    rows = stored(_show_sets(own, words, percent))
    key = ["f1", "f2", "n"]
    found = rows.where("n > 0").groupBy(*key).agg(
        F.min(F.struct("id", "th")).alias("r"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("w")
    )
    sets = stored(found.select(*key, "r.id", "r.th", "min_id", "w", F.monotonically_increasing_id().alias("sid")))

    # 1: sets with enough tokens of their extended prefix elsewhere
    shown = join_same(rows.select("id", "th", "prefix"), sets.select("id", "th", "sid", "n"), ["id", "th"], "inner")
    tokens = shown.select("sid", "n", F.explode("prefix").alias("token"))
    twice, sizes = measured_groups(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1"), "n_sets")
    met = join_groups(tokens, twice, ["token"], "n_sets", F.col("sid"), sizes).where("n_sets IS NOT NULL")
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    enough = F.col("hits") >= 1 + F.floor(least * EXTRA / 100)
    left = met.groupBy("sid", "n").agg(F.count(F.lit(1)).alias("hits")).where(enough).select("sid")
    left = released(sets.join(left, "sid").select("sid", "n", "id", "th"))

    # 2: exact counts of their tokens, and signatures
    own = likely_in(own, left, {"id": "id", "th": "th"})
    texts = join_same(own, left, ["id", "th"], "inner").select("sid", "t")
    whole = released(_whole_sets(texts, words).dropDuplicates(["sid"]))
    tokens = whole.select("sid", F.explode("tokens").alias("token"))
    twice, sizes = measured_groups(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1"), "n_sets")
    met = join_groups(tokens, twice, ["token"], "n_sets", F.col("sid"), sizes).where("n_sets IS NOT NULL")
    shared = met.groupBy("sid").agg(F.collect_list(F.struct("token", "n_sets")).alias("shared"))
    shared = shared.join(left.select("sid", "n"), "sid").where(F.size("shared") >= least)
    entries = released(_keyed(shared, percent))
    # of keys with the same sets, which near copies have many of, one is enough
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "sid")).alias(f"x{i}") for i in range(2)]
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("w"), *marks).where("w > 1")
    several, sizes = measured_groups(several.groupBy("w", "x0", "x1").agg(F.min("key").alias("key")).select("key", "w"), "w")
    entries = stored(join_groups(entries, several, ["key"], "w", F.col("sid"), sizes).where("w IS NOT NULL").drop("w"))

    # 3: links and components
    nodes = _connect(entries, whole, percent)
    classes = stored(sets.join(nodes, "sid", "left").select(*key, "w", "min_id", "id", "th", F.coalesce("comp", "sid").alias("comp")))
    # the row that stays: the smallest id, then the smallest hash of the text; a row without an id only if all are
    stays = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("min_id", "id").alias("id"), "th")).alias("s")
    names, sizes = measured_groups(classes.groupBy("comp").agg(F.min("min_id").alias("component_id"), stays, F.count(F.lit(1)).alias("_w")), "_w")
    named = join_groups(classes, names, ["comp"], "_w", F.xxhash64("f1"), sizes)
    named, sizes = measured_groups(named.select(*key, "component_id", F.col("s.id").alias("stay_id"), F.col("s.th").alias("stay_th"), "w"), "w")
    out = join_groups(rows.select("id", "th", *key), named, key, "w", F.col("id"), sizes)
    kept = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("th") == F.col("stay_th")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.col("th").alias("text_hash"), kept.alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component of similar texts, all columns kept; texts without words all stay."""
    th = fresh(docs, "th")
    staying = near_duplicates(docs, id_col, text, words, percent).where("kept").select(id_col, F.col("text_hash").alias(th)).distinct()
    met = join_same(docs.withColumn(th, F.xxhash64(text_of(text))), staying, [id_col, th], "left_semi")
    # rows repeated with the same id and text are one
    return met.dropDuplicates([id_col, th]).drop(th)
