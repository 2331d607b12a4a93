r"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles of `k` words (fewer words: the whole sequence as one). Each shingle is hashed
and toggles one bit of a sketch; the Hamming distance of two sketches is at most the symmetric difference of the sets.
Sizes are cut into bands, each with the greatest difference D that a link in it may have, and a band's sketches (a word
wide for each shingle) are cut into D + 1 + E blocks. Linked sets differ in at most D blocks, so 1 + E blocks at least are
equal. Blocks of few shingles are equal in sets that share nothing but these; each set leaves out as many of its sparsest
as E allows (see block_keys), and an equality join on (band, block, content) of the rest finds every link. A set that may
be a pair's larger one emits the band below as well.

Equal sets are collapsed to one node before keys are made. Keys that one node alone has are most: a pre-aggregated count
finds the others, and a bitmap of bounded size thins the nodes' keys to these (with more shared keys than it has bits it
thins less; the results are the same). A bucket of few nodes gives its pairs; those go on whose narrow sketches, with a bit
for each shingle, have no greater Hamming distance than a link's difference, and are verified by their whole sets.

Groups of near copies would make all pairs of a bucket. Instead a larger bucket's members meet only its least member, the
leader, and their symmetric differences from it are computed exactly. The Jaccard distance is a metric and linked sets are
no farther apart than e = 1 - num / den, so both are within 2.5 e of the leader or both are beyond 1.5 e. Sets beyond, which
mostly share parts of a template with many leaders, go once each, whatever the number of these, to rounds of leaders by their
rarest tokens, and what these leave to a join by them (_apart_links). Links between members within 2.5 e follow from the differences. A group of a bounded
number of members, whose pairs are no more than its differences' tokens, gives those of its pairs that sizes and distances from the leader
allow to link, once for all leaders, to sketches and verification. A larger group's differences are taken to a centre (the leader
with the majority's differences applied); members close enough to the centre are a star around the closest; any other link needs a common token in the differences' rarest tokens (prefix
filter with the exact overlap that the link requires), and the candidates from that are verified exactly. No link
between different sets is lost, and a group of g copies costs about g.

A node is a 64-bit fingerprint of a set and its size; shingles are 64-bit hashes. Words are longest
runs of characters other than ASCII white space, A-Z lower-cased. Null, empty and blank texts have an empty set, no
links, and are their own component. Rows of equal id are judged each; a row of null id takes part and never names a
component unless all its rows are null. Texts of any length are taken whole; repeated rows are answered each, alike; ties
of leaders and hubs go to the least fingerprint; an empty table gives none. Only the id and the text are read, so other
columns' names don't matter. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import Scratch, apart, bit_field, bit_table, by_bytes, map_batches
from lodegraph.llm.components import components

#: Growth of sizes from band to band, if the similarity doesn't ask for more.
WIDEN = 1.25
#: Bits, as a power of two, of the bitmap over keys that more than one set has.
BITMAP = 27
#: A bucket of no more sets gives its pairs, each refused by sketches or verified; in larger ones all meet the leader.
FEW = 6
#: A leader's group of no more sets gives its pairs, where these are no more than the tokens of its differences.
SOME = 256
#: Rounds in which sets far from a leader meet another one, before those still left are joined by their rarest tokens.
ROUNDS = 6
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_30, _27, _31, _32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _30)) * _M2
    x = (x ^ (x >> _27)) * _M3
    return x ^ (x >> _31)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        size = min(k, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for j in range(size):
            out = mixed(out * _M1 + h[j : len(words) - size + 1 + j])
    return np.unique(out)


@lru_cache(maxsize=4096)
def _low(i: int, num: int, den: int) -> int:
    """Least size of band i. Bands widen by WIDEN, or by what a link's sizes may differ if that is more."""
    low = 1
    for _ in range(i):
        low = max(low + 1, math.ceil(low * max(WIDEN, den / num)))
    return low


@lru_cache(maxsize=4096)
def _blocks(i: int, num: int, den: int) -> tuple[int, int, int]:
    """(E, blocks, t) of band i: the least E that lets nearly all sets of the band leave out their blocks of fewer than t
    tokens, t being two, or, where sets are too small for that, one: their empty blocks."""
    low, top = _low(i, num, den), _low(i + 1, num, den) - 1
    d = (den - num) * (top + top * den // num) // (den + num)
    for t in (2, 1):
        for e in range(d + 3):
            mean = low / (d + 1 + e)
            weak = (d + 1 + e) * math.exp(-mean) * (1 + mean if t == 2 else 1)
            if weak + 2 * math.sqrt(weak) <= e:
                return e, d + 1 + e, t
    return d + 2, 2 * d + 3, 1


def _band(n: int, num: int, den: int) -> int:
    i = 0
    while _low(i + 1, num, den) <= n:
        i += 1
    return i


def block_keys(tokens: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """(need, keys) for the set's band and, if it may be the larger of a pair there, the band below: whatever the set
    links to in that band has at least `need` of the keys.

    Of the 1 + E blocks at least that linked sets have equal, a set leaves out those of fewer than t tokens, t being the
    band's, if it has no more than E such; these are in both sets or in none, so all but as many of the equal ones are
    left. A set with more of them takes a smaller t, or all blocks, and emits what the other one emits and more; as that
    is all it knows of the other one, it needs one key.
    """
    n = len(tokens)
    if not n:
        return []
    own = _band(n, num, den)
    out = []
    for i in [own, *([own - 1] if own and n * num <= (_low(own, num, den) - 1) * den else [])]:
        spare, blocks, most = _blocks(i, num, den)
        with np.errstate(over="ignore"):
            block = ((tokens >> _32) * np.uint64(blocks)) >> _32  # in order, as the tokens are
            toggled = mixed(tokens + _M1)  # the place in the block's sketch, as a word to XOR
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            content, which = np.bitwise_xor.reduceat(toggled, first), block[first]
            filled = np.diff(np.concatenate([first, [n]]))
            empty = blocks - len(which)
            need = 1
            if empty > spare:  # all blocks, the empty ones too
                gone = np.setdiff1d(np.arange(blocks, dtype=np.uint64), which)
                content, which = np.concatenate([content, np.zeros(len(gone), np.uint64)]), np.concatenate([which, gone])
            else:
                weak = empty + int((filled < most).sum())
                if weak <= spare:
                    strong = filled >= most
                    content, which, need = content[strong], which[strong], 1 + spare - weak
            keys = mixed(content ^ mixed((np.uint64(i + 1) << _32) + which))
            out.append((need, keys.view(np.int64)))
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """Parity sketch of a power of two of bits, one for each token at least; folding halves gives the smaller ones."""
    width = 1 << max(6, (len(tokens) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = (mixed(tokens ^ _M2) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches at the narrower one's width: no more than the sets' difference."""
    a, b = (np.frombuffer(s, np.uint8) for s in ((x, y) if len(x) <= len(y) else (y, x)))
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def fingerprint(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = np.array([len(tokens), tokens.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(tokens ^ _M3)) if len(tokens) else 0], np.uint64)
        h = np.zeros(1, np.uint64)
        for x in both:
            h = mixed(h * _M1 + x + np.uint64(1))
    return int(h.view(np.int64)[0])


BANDS = "array<struct<need:int,keys:array<bigint>>>"


def _bands_array(by_set: list[list[tuple[int, np.ndarray]]]) -> pa.Array:
    def offsets(parts: list) -> pa.Array:
        return pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())

    flat = [x for found in by_set for x in found]
    keys = pa.ListArray.from_arrays(offsets([x for _, x in flat]), pa.array(np.concatenate([np.empty(0, np.int64), *(x for _, x in flat)])))
    both = pa.StructArray.from_arrays([pa.array([need for need, _ in flat], pa.int32()), keys], ["need", "keys"])
    return pa.ListArray.from_arrays(offsets(by_set), both)


def _sketched(df: DataFrame, row: str, text: str, k: int, num: int, den: int, mark: Column) -> DataFrame:
    """(id, n, v, bands, sketch, mark) of every row, bands being (need, keys) of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 1 << 20):
            sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), _bands_array([block_keys(s, num, den) for s in sets]), pa.array(map(sketch, sets), pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "v", "bands", "sketch", "mark"])

    given = df.select(row, text, mark.cast("long").alias("__mark"))
    return map_batches(given, work, f"id {df.schema[row].dataType.simpleString()}, n long, v long, bands {BANDS}, sketch binary, mark long")


def _shared_bits(nodes: DataFrame, scratch: Scratch) -> np.ndarray:
    """Bits, at the keys' low BITMAP bits, of the keys that two sets at least have; of 2^BITMAP bits at any number of keys."""
    keys = nodes.select(F.explode("bands.keys").alias("keys")).select(F.explode("keys").alias("key"))
    again = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    return bit_field(again, scratch, "bitmap", BITMAP)


def _shared_keys(nodes: DataFrame, held: Broadcast) -> DataFrame:
    """(v, band, need, key): the keys whose bit is set, of bands in which a set has as many of these as any link has."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            bands = batch.column(1)
            per_set = np.diff(bands.offsets.to_numpy())
            flat = bands.flatten()
            need, lists = flat.field(0).to_numpy(), flat.field(1)
            sizes = np.diff(lists.offsets.to_numpy())
            keys = lists.flatten().to_numpy()
            at = keys & ((1 << BITMAP) - 1)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            which = np.repeat(np.arange(len(sizes)), sizes)
            enough = np.bincount(which[hit], minlength=len(sizes)) >= need
            hit &= enough[which]
            which = which[hit]
            v = np.repeat(batch.column(0).to_numpy(), per_set)[which]
            band = (np.arange(len(sizes)) - np.repeat(np.cumsum(per_set) - per_set, per_set))[which].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(band), pa.array(need[which]), pa.array(keys[hit])], ["v", "band", "need", "key"])

    return map_batches(nodes.select("v", "bands"), work, "v long, band int, need int, key long")


def _close(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (x, y) those that their sketches allow to link: the others' Hamming distance is more than a link's
    difference can be."""
    a, b = den + num, den - num

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny, sx, sy = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            may = [num * max(m, n) <= den * min(m, n) and a * sketch_distance(s, t) <= b * (m + n) for m, n, s, t in zip(nx, ny, sx, sy, strict=True)]
            yield batch.filter(pa.array(may, pa.bool_())).select(["x", "y"])

    known = nodes.select("v", "n", "sketch")
    both = pairs.join(known.withColumnsRenamed({"v": "x", "n": "nx", "sketch": "sx"}), "x").join(known.withColumnsRenamed({"v": "y", "n": "ny", "sketch": "sy"}), "y")
    return map_batches(both.select("x", "y", "nx", "ny", "sx", "sy"), work, "x long, y long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, w): of pairs (x, y) those that link, by their whole sets. A set x comes once for all its y."""
    a, b = den + num, den - num

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, mine, other = batch.columns
            linked = []
            for k in range(batch.num_rows):
                p, q = (c[k].values.to_numpy(zero_copy_only=False) for c in (mine, other))
                linked.append(a * (len(p) + len(q) - 2 * len(np.intersect1d(p, q, assume_unique=True))) <= b * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([u, w], ["u", "w"]).filter(pa.array(linked, pa.bool_()))

    whole = pairs.join(sets.select(F.col("v").alias("x"), F.col("tokens").alias("mine")), "x").join(sets.select(F.col("v").alias("y"), F.col("tokens").alias("other")), "y")
    return map_batches(whole.select("x", "y", "mine", "other"), work, "u long, w long")


def _memberships(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """(leader, v): the leaders that v is compared with, in buckets of more than FEW sets.

    Linked sets that are in no bucket of few sets together share `need` keys at least of the other buckets, both by the
    one's count and the other's. So each may leave out half of what is short of that, floor((need - 1) / 2) keys: the two
    together leave one that both keep. Those of the leaders that v shares fewest keys with go first; most of these just
    share a phrase with v.
    """
    shared = keyed.join(buckets, "key").where("v != leader").groupBy("v", "band", "need", "leader").agg(F.count(F.lit(1)).alias("c"))
    kept = shared.withColumn("gone", F.expr("sum(c) over (partition by v, band order by c, leader rows unbounded preceding)")).where("gone > (need - 1) div 2")
    return kept.select("leader", "v").distinct()


def _fingerprinted(df: DataFrame, k: int) -> DataFrame:
    """(v, text) of rows (text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(shingles(t, k)) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(0)], ["v", "text"])

    return map_batches(df, work, "v long, text string")


def _sets(df: DataFrame, k: int) -> DataFrame:
    """(v, tokens) of rows (v, text): those whose text has the fingerprint v."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [(v, s) for v, s in zip(batch.column(0).to_pylist(), (shingles(t, k) for t in batch.column(1).to_pylist()), strict=True) if fingerprint(s) == v]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["v", "tokens"])

    return map_batches(df, work, "v long, tokens array<long>")


def _beyond(halves: int, num: int, den: int) -> str:
    """Whether a set's Jaccard distance from its leader, d / union, is more than so many halves of a link's greatest."""
    return f"4 * {den} * d > {halves * (den - num)} * (n + n_leader + d)"


def _differences(df: DataFrame, num: int, den: int) -> DataFrame:
    """(leader, v, n, n_leader, d, delta) of rows (leader, v, m, tokens, own): own are the leader's tokens, d the
    difference's size; the difference itself only where the leader has other sets that it serves to compare with, and
    the set is not beyond comparison."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                many = [m > 1 for m in part.column(2).to_pylist()]
                pairs = [(part.column(3)[i].values.to_numpy(zero_copy_only=False), part.column(4)[i].values.to_numpy(zero_copy_only=False)) for i in range(part.num_rows)]
                found = [np.setxor1d(a, b, assume_unique=True) for a, b in pairs]
                many = [m and 4 * den * len(x) <= 5 * (den - num) * (len(p) + len(q) + len(x)) for m, x, (p, q) in zip(many, found, pairs, strict=True)]
                sizes = [pa.array([len(x) for x in y], pa.int64()) for y in (*([p[j] for p in pairs] for j in (0, 1)), found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sizes, pa.array([x if keep else None for x, keep in zip(found, many, strict=True)], pa.list_(pa.int64()))], ["leader", "v", "n", "n_leader", "d", "delta"])

    return map_batches(df, work, "leader long, v long, n long, n_leader long, d long, delta array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """_differences of pairs (leader, v)."""
    own = sets.select(F.col("v").alias("leader"), F.col("tokens").alias("own"))
    met = pairs.join(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("m")), "leader").join(sets, "v").join(own, "leader")
    return _differences(met.select("leader", "v", "m", "tokens", "own"), num, den)


def _apart_links(given: DataFrame, sets: DataFrame, nodes: DataFrame, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(u, w): links, or what connects as they do, between sets that are both beyond 1.5 times a link's distance from a
    leader that they share; and tables (x, y) of pairs that are still to be verified.

    A set comes once, with its tokens, the rarest first. Linked sets have num / den of either one's tokens in common at
    least, so their first common token is among the first n - ceil(n * num / den) + 1 of both. Sets with a token there of
    which there are more than FEW meet a leader again, in rounds: that with the fewest tokens of its own, which of near copies is
    the least changed. As before, links are within 2.5 times a link's distance of it or beyond 1.5, and only the sets beyond
    stay with the token. When few pairs are left, or a round takes few away, the rest is joined by its tokens.
    """
    beyond = given.where(_beyond(3, num, den)).select("leader", "v")
    several = beyond.groupBy("leader").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("leader")
    apart_ = scratch.save(beyond.join(several, "leader").select("v").distinct(), "beyond")
    tokens = apart_.join(sets, "v").select("v", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    tokens = scratch.save(tokens, "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = "row_number() over (partition by v order by coalesce(often, 1), token)"
    first = f"r <= n - ceil(n * {num} / {den}) + 1"
    ranked = tokens.join(often, "token", "left").withColumn("r", F.expr(order)).withColumn("alone", F.expr("count_if(often is null) over (partition by v)"))
    rest = scratch.save(ranked.where(f"often is not null and {first}").select("token", "v", "n", "alone", (F.col("n") - F.col("r")).alias("after")), "firsts")
    links, beside, last = [], [], math.inf
    for k in range(ROUNDS + 1):
        # From their first common token on, two sets have no more in common than the shorter one has left, and a token's
        # least set is the smallest that one of its others may link to.
        least = rest.groupBy("token").agg(F.min("n").alias("low"))
        rest = rest.join(least, "token").where(f"{den + num} * (1 + after) >= {num} * (n + greatest(low, ceil(n * {num} / {den})))").drop("low")
        rest = scratch.save(rest, f"rest{k}")
        buckets = scratch.save(rest.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min_by("v", F.struct("alone", "v")).alias("leader")), f"tokens{k}")
        rows, pairs = buckets.agg(F.sum("c"), F.sum(F.expr("c * (c - 1) div 2"))).first()
        if k == ROUNDS or not rows or pairs <= FEW * rows or pairs > 0.8 * last:
            break
        last = pairs
        large = rest.join(buckets.where(f"c > {FEW}").select("token", "leader"), "token").where("v != leader")
        compared = scratch.save(large.select("leader", "v").distinct(), f"pairs{k}")
        given = scratch.save(_compared(compared, sets, num, den), f"differences{k}")
        found, between = _links(given, num, den, scratch)
        links.append(scratch.save(found, f"links{k}"))
        beside.append(scratch.save(between, f"between{k}"))
        left = large.join(given.where(_beyond(3, num, den)).select("leader", "v"), ["leader", "v"]).select(rest.columns)
        rest = rest.join(buckets.where(f"c <= {FEW}").select("token"), "token").select(rest.columns).unionByName(left)
    x, y = (rest.drop("alone").withColumnsRenamed({"v": k, "n": f"n{k}", "after": f"a{k}"}) for k in ("x", "y"))
    left = f"{den + num} * (1 + least(ax, ay)) >= {num} * (nx + ny)"
    met = x.join(y, "token").where(f"x < y and {num} * greatest(nx, ny) <= {den} * least(nx, ny) and {left}")
    near = scratch.save(_close(met.select("x", "y").distinct(), nodes, num, den), "near")
    return reduce(DataFrame.unionByName, links, _verified(near, sets, num, den)), beside


def _links(given: DataFrame, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(u, w): links that connect what the differences from leaders show to be connected; and (x, y), pairs of smaller groups
    that are still to be verified."""
    a, b = den + num, den - num  # sets link where a * difference <= b * (size + size)
    near = f"{a} * d <= {b} * (n + n_leader)"
    to_leader = given.where(near).select(F.col("leader").alias("u"), F.col("v").alias("w"))
    given = given.where(f"not ({_beyond(5, num, den)})")
    groups = given.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum(F.expr(f"if({near}, 0, 1)")).alias("far"), F.sum("d").alias("t"), F.first("n_leader").alias("n"))
    # Of two sets near the leader nothing is left to find; the other pairs are m * (m - 1) / 2 less those.
    smaller = F.expr(f"m <= {SOME} and m * (m - 1) - (m - far) * (m - far - 1) <= 2 * t")
    opened = scratch.save(groups.where("m > 1 and far > 0").withColumn("smaller", smaller), "groups")
    paired = given.withColumn("near", F.expr(near)).join(opened.where("smaller").select("leader"), "leader").select("leader", "v", "n", "d", "near")
    x, y = (paired.withColumnsRenamed({"v": k, "n": f"n{k}", "d": f"d{k}", "near": f"near{k}"}) for k in ("x", "y"))
    met = x.join(y, "leader").where(f"x < y and not (nearx and neary) and {num} * greatest(nx, ny) <= {den} * least(nx, ny) and {a} * abs(dx - dy) <= {b} * (nx + ny)")
    between = met.select("x", "y").distinct()
    opened = opened.where("not smaller")
    if opened.isEmpty():
        return to_leader, between
    members = given.join(opened.select("leader", "m"), "leader").select("leader", "v", "n", "delta", "m")
    members = members.unionByName(opened.select("leader", F.col("leader").alias("v"), "n", F.array().cast("array<bigint>").alias("delta"), "m"))
    counts = members.select("leader", "m", F.explode("delta").alias("token")).groupBy("leader", "token", "m").agg(F.count(F.lit(1)).alias("c"))
    major = counts.where("2 * c > m + 1").groupBy("leader").agg(F.collect_list("token").alias("major"))
    moved = F.expr("if(major is null, delta, concat(array_except(delta, major), array_except(major, delta)))")
    centred = members.join(major, "leader", "left").select("leader", "v", "n", moved.alias("delta")).withColumn("d", F.size("delta").cast("long"))
    centred = scratch.save(centred.withColumn("c", F.expr(f"{a} * d - {b} * n")), "centred")
    star = centred.groupBy("leader").agg(F.min("c").alias("low"), F.min_by("v", F.struct("c", "v")).alias("hub"))
    star = scratch.save(star, "stars")
    placed = centred.join(star, "leader")
    to_hub = placed.where("c + low <= 0 and v != hub").select(F.col("hub").alias("u"), F.col("v").alias("w"))
    tokens = placed.select("leader", "v", "n", "d", "c", "low", F.explode("delta").alias("token"))
    often = tokens.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Tokens of one set alone, the rarest, come before those of several, and are not joined.
    order = "d - count(1) over (partition by leader, v) + row_number() over (partition by leader, v order by often, token)"
    ranked = tokens.join(often, ["leader", "token"]).withColumn("r", F.expr(order))
    far_need = f"greatest(1, ceil((c - {b} * floor(n * {den} / {num})) / {a}))"
    near_need = f"greatest(1, ceil((c + greatest(c, 1 - low)) / {2 * a}))"
    ranked = scratch.save(ranked.select("leader", "token", "v", "n", "c", (F.col("d") - F.col("r")).alias("after"), "d", F.expr(f"c + low > 0 and r <= d - {far_need} + 1").alias("far"), F.expr(f"r <= d - {near_need} + 1").alias("near")).where("far or near"), "prefixes")
    x = ranked.where("far").select("leader", "token", F.col("v").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("d").alias("dx"), F.col("after").alias("ax"))
    y = ranked.where("near").select("leader", "token", F.col("v").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("d").alias("dy"), F.col("after").alias("ay"))
    # From their first common token on, two differences have no more in common than the shorter one has left.
    left = f"{a} * (dx + dy - 2 - 2 * least(ax, ay)) <= {b} * (nx + ny)"
    met = x.join(y, ["leader", "token"]).where(f"x != y and cx >= cy and {num} * greatest(nx, ny) <= {den} * least(nx, ny) and {left}")
    met = met.select("leader", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    arrays = centred.select("leader", F.col("v").alias("x"), F.col("delta").alias("dx"), F.col("n").alias("nx"))
    others = centred.select("leader", F.col("v").alias("y"), F.col("delta").alias("dy"), F.col("n").alias("ny"))
    verified = met.join(arrays, ["leader", "x"]).join(others, ["leader", "y"]).where(f"{a} * (size(dx) + size(dy) - 2 * size(array_intersect(dx, dy))) <= {b} * (nx + ny)")
    return to_leader.unionByName(to_hub).unionByName(verified.select(F.col("x").alias("u"), F.col("y").alias("w"))), between


def classes(df: DataFrame, row: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100, mark: Column | None = None) -> DataFrame:
    """(row, n_shingles, component_id): sets link where den * intersection >= num * union; a component is named by the
    least id in it. Sets of one text or of copies are one component. With `mark`, a whole number that tells rows apart, the
    result has mark and group too: a number of the component, whatever its ids; null where the set is empty."""
    scratch = Scratch(df.sparkSession)
    every = scratch.save(_sketched(df, row, text, k, num, den, F.lit(0) if mark is None else mark), "every")
    base = scratch.save(every.select("id", "n", "v", "mark"), "base")
    nodes = every.where("n > 0").groupBy("v").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = scratch.save(nodes, "nodes")
    scratch.drop("every")
    held = df.sparkSession.sparkContext.broadcast(_shared_bits(nodes, scratch))
    keyed = scratch.save(_shared_keys(nodes, held), "keyed")
    held.destroy()
    buckets = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("leader")).where("c > 1"), "buckets")
    few = keyed.join(buckets.where(f"c <= {FEW}").select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    beside = "flatten(transform(vs, (x, i) -> transform(slice(vs, i + 2, size(vs)), y -> struct(x, y))))"
    met = few.select(F.explode(F.expr(beside)).alias("p")).select("p.x", "p.y").distinct()
    close = scratch.save(_close(met, nodes, num, den), "close")
    pairs = scratch.save(_memberships(keyed, buckets.where(f"c > {FEW}").select("key", "leader")), "pairs")
    ends = [close.select(F.col("x").alias("v")), close.select(F.col("y").alias("v")), pairs.select("v"), pairs.select(F.col("leader").alias("v"))]
    wanted = reduce(DataFrame.unionByName, ends).distinct().join(nodes, "v").select("v", "least")
    wanted = scratch.save(wanted, "wanted")
    size = wanted.count()
    ids = wanted.where("least is not null").select("v", F.col("least").alias("__id"))
    near, _ = apart(df.select(F.col(row).alias("__id"), F.col(text).alias("text")), F.xxhash64("__id"), bit_table(ids.select(F.xxhash64("__id")), scratch, "field"))
    texts = near.join(ids, "__id").select("v", "text")
    nameless = wanted.where("least is null").select("v")
    if not nameless.isEmpty():  # no id fetches the sets that only rows of null id have
        unnamed = _fingerprinted(df.where(F.col(row).isNull()).select(F.col(text).alias("text")), k)
        texts = texts.unionByName(unnamed.join(nameless, "v").select("v", "text"))
    sets = scratch.save(_sets(texts, k), "sets")
    if (found := sets.count()) != size:  # rows of one id and one text
        sets = scratch.save(sets.dropDuplicates(["v"]), "distinct")
        found = sets.count()
    if found != size:
        raise RuntimeError(f"{found} of {size} sets to compare were fetched")
    verified = scratch.save(_verified(close, sets, num, den), "verified")
    given = scratch.save(_compared(pairs, sets, num, den), "differences")
    apart_links, beside = _apart_links(given, sets, nodes, num, den, scratch)
    apart_links = scratch.save(apart_links, "apart")
    found, between = _links(given, num, den, scratch)
    between = scratch.save(reduce(DataFrame.unionByName, beside, between).distinct(), "between")
    may = scratch.save(_close(between, nodes, num, den), "may")
    links = scratch.save(reduce(DataFrame.unionByName, [_verified(may, sets, num, den), verified, apart_links], found), "links")
    scratch.drop("sets", "distinct")
    roots = components(links, scratch)
    named = nodes.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("v", "component_id", "root")
    out = base.join(named, "v", "left").select(F.col("id").alias(row), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *([] if mark is None else ["mark", F.col("root").alias("group")]))
    return scratch.finish(out)
