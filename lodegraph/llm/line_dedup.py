r"""Line dedup: repeated runs of lines, found by a distributed suffix array over line ids.

A run of whole consecutive lines of at least `min_words` words is deleted where it occurs earlier too: in a document
earlier in the order of (id, text's hash), or above in the same one, in both cases without overlap of the two copies.
What goes are all maximal such runs of every document; blank lines are no part of runs and stay, shorter repeats stay.

Lines with a word become 64-bit ids. Only lines that occur twice can be in a repeat, so each document is cut into
segments of consecutive such lines with at least `min_words` words. The suffixes of all segments are ranked by prefix
doubling: a round orders the distinct pairs (rank, rank 2^r lines on) by a range sort and gives their places as new
ranks, until a round splits no class. Sorted suffixes form the array; the longest common prefix of neighbours comes
from comparing their segments, joined once for each pair of segments. Where neighbours share at least `min_words`
words they are in one interval. All its suffixes are compared with its earliest, which is the best copy for as far as a
suffix agrees with it. Those that agree equally far and then have the same next line are an interval within, of a longer
common prefix, with an earliest of its own; so on, until no interval has two suffixes. That takes as many rounds as
there are ever later copies that agree ever longer, mostly two or three.

Documents of equal line sequences are one sequence to this: copies of the least id are deleted whole if they have
`min_words` words. Rows equal in id and text are one document and are cleaned alike. Null text stays null, empty text
empty; a null id sorts first. Texts of any length are taken whole. Other columns pass; those named like the new ones are
replaced. Nothing is capped: hot lines are pre-aggregated pairs, joins on ranks can be split, groups handled in one
place are one document's lines or a fixed stretch of the array. Texts of which nothing is deleted are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import Scratch, apart, bit_table, by_bytes, map_batches, numbered, set_aside

MIN_WORDS = 50
#: Places of the suffix array that a window takes at once.
STRETCH = 100_000


def _lined(df: DataFrame, row: str, text: str) -> DataFrame:
    """(id, th, at, ids, words): line numbers, ids and word counts of the lines with words; th: the text's hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            at, ids, words = [], [], []
            for t in batch.column(2).to_pylist():
                lines = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
                counts = [len(x.split()) for x in lines]
                real = [k for k, n in enumerate(counts) if n]
                at.append(real)
                ids.append([int.from_bytes(hashlib.blake2b(lines[k], digest_size=8).digest(), "little", signed=True) for k in real])
                words.append([counts[k] for k in real])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], ["id", "th", "at", "ids", "words"])

    given = df.select(F.col(row).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias(text)).where(F.col(text).isNotNull())
    return map_batches(given, work, f"id {df.schema[row].dataType.simpleString()}, th long, at array<int>, ids array<long>, words array<int>")


def _common(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Of pairs (s, o, t, p, g) of suffixes: common, the lines on which they agree, its words, next (the line of the first
    that follows, if any), and the run of document d that repeats: lines [at, upto) of `run_words` words, which end where
    the second's copy would reach into the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("s", "o", "g", "d", "common", "common_words", "next", "at", "upto", "run_words")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[tuple] = []
            for s, places, a, w, d, start, b, e, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b, sums = np.array(a, np.int64), np.array(b, np.int64), np.concatenate([[0], np.cumsum(w)])
                by_shift: dict[int, list[tuple[int, int]]] = {}
                for x in places:
                    by_shift.setdefault(x["p"] - x["o"], []).append((x["o"], x["g"]))
                for shift, offsets in by_shift.items():
                    low, high = max(0, -shift), min(len(a), len(b) - shift)
                    unequal = np.flatnonzero(np.concatenate([a[low:high] != b[low + shift : high + shift], [True]])) + low
                    ends = unequal[np.searchsorted(unequal, [o for o, _ in offsets])].tolist()
                    gap = max(0, start - begin - shift) if d == e else len(a)  # lines from the other's start to the one's
                    for (o, g), end in zip(offsets, ends, strict=True):
                        stop = min(end, o + gap)
                        out.append((s, o, g, d, end - o, int(sums[end] - sums[o]), int(a[end]) if end < len(a) else None, start + o, start + stop, int(sums[stop] - sums[o])))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    grouped = pairs.groupBy("s", "t").agg(F.collect_list(F.struct("o", "p", "g")).alias("places"))
    own = segments.select("s", F.col("ids").alias("a"), "words", "d", "start")
    other = segments.select(F.col("s").alias("t"), F.col("ids").alias("b"), F.col("d").alias("e"), F.col("start").alias("begin"))
    joined = grouped.join(own, "s").join(other, "t").select("s", "places", "a", "words", "d", "start", "b", "e", "begin")
    return map_batches(joined, work, "s long, o int, g long, d long, common int, common_words int, next long, at int, upto int, run_words int")


def repeats(lined: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(id, th, start, end) in places among a document's lines with words: what later copies repeat."""
    firsts = lined.groupBy(F.xxhash64("ids").alias("x"), F.size("ids").alias("n"), F.expr("aggregate(ids, 0L, (a, i) -> a ^ xxhash64(i, 7L))").alias("y")).agg(F.min(F.struct("id", "th")).alias("first"))
    firsts = scratch.save(firsts, "firsts")
    keyed = lined.withColumns({"x": F.xxhash64("ids"), "n": F.size("ids"), "y": F.expr("aggregate(ids, 0L, (a, i) -> a ^ xxhash64(i, 7L))"), "total": F.expr("aggregate(words, 0L, (a, w) -> a + w)")})
    known = keyed.join(firsts, ["x", "n", "y"])
    is_first = F.col("first").eqNullSafe(F.struct("id", "th"))
    copies = known.where(~is_first & (F.col("total") >= min_words)).select("id", "th", F.lit(0).alias("start"), F.col("n").alias("end")).distinct()
    own = known.where(is_first & (F.col("total") >= min_words)).dropDuplicates(["id", "th"]).select(F.xxhash64("id", "th", "x").alias("d"), "id", "th", "ids", "words")
    own = scratch.save(own, "own")
    lines = own.select("d", F.posexplode(F.arrays_zip("ids", "words")).alias("k", "z")).select("d", "k", F.col("z.ids").alias("line"), F.col("z.words").alias("w"))
    again = lines.groupBy("line").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("line")
    places = lines.join(again, "line")
    places = places.withColumn("run", F.expr("k - row_number() over (partition by d order by k)"))
    places = places.withColumns({"start": F.expr("min(k) over (partition by d, run)"), "total": F.expr("sum(w) over (partition by d, run)")}).where(F.col("total") >= min_words)
    suffixes = scratch.save(places.select(F.xxhash64("d", "start").alias("s"), (F.col("k") - F.col("start")).alias("o"), "line", "w", "d", "start", F.col("line").alias("r")), "suffixes0")
    ends = F.sort_array(F.collect_list(F.struct("o", "line", "w")))
    segments = suffixes.groupBy("s", "d", "start").agg(ends.alias("z")).select("s", "d", "start", F.col("z.line").alias("ids"), F.col("z.w").alias("words"))
    segments = scratch.save(segments, "segments")

    classes, step, reach = -1, 0, 1
    now = suffixes.select("s", "o", "r")
    while True:
        paired = scratch.save(now.withColumn("next", F.expr(f"lead(r, {reach}) over (partition by s order by o)")), f"paired{step}")
        distinct = paired.select("r", "next").distinct()
        ranked = scratch.save(distinct.orderBy(F.col("r").asc(), F.col("next").asc_nulls_first()).withColumn("rank", F.monotonically_increasing_id()), f"ranked{step}")
        found = ranked.count()
        names = ranked.select(F.col("r").alias("r0"), F.col("next").alias("n0"), "rank")
        now = scratch.save(paired.join(names, (F.col("r") == F.col("r0")) & F.col("next").eqNullSafe(F.col("n0"))).select("s", "o", F.col("rank").alias("r")), f"suffixes{step + 1}")
        scratch.drop(f"paired{step}", f"ranked{step}", *([f"suffixes{step}"] if step else []))
        step, reach = step + 1, 2 * reach
        if found == classes or not found:
            break
        classes = found

    order = now.join(segments.select("s", "d", "start"), "s").join(own.select("d", "id", "th"), "d")
    order = order.select("r", "id", "th", (F.col("start") + F.col("o")).alias("k"), "s", "o")
    array = scratch.save(numbered(order.orderBy("r", "id", "th", "k"), scratch, "array", "sa").drop("r"), "numbered")
    above = array.select((F.col("sa") + 1).alias("sa"), F.col("s").alias("t"), F.col("o").alias("p"))
    beside = scratch.save(array.select("sa", "s", "o").join(above, "sa"), "beside")
    near = _common(beside.select("s", "o", "t", "p", F.lit(0).cast("long").alias("g")), segments).where(F.col("common_words") >= min_words).select("s", "o", F.lit(False).alias("opens"))
    marked = array.join(near, ["s", "o"], "left").withColumn("opens", F.coalesce("opens", F.lit(True)))
    marked = scratch.save(marked.withColumn("stretch", F.expr(f"sa div {STRETCH}")), "marked")
    own_last = "last(if(opens, sa, null), true) over (partition by stretch order by sa)"
    carried = marked.groupBy("stretch").agg(F.max(F.expr("if(opens, sa, null)")).alias("to")).withColumn("from", F.expr("max(to) over (order by stretch rows between unbounded preceding and 1 preceding)")).select("stretch", "from")
    intervals = marked.withColumn("own_last", F.expr(own_last)).join(carried, "stretch").withColumn("g", F.coalesce("own_last", "from"))
    inside = scratch.save(intervals.select("g", "id", "th", "k", "s", "o"), "inside0")
    runs, step = None, 0
    while True:
        # The earliest of each interval, and how far the others agree with it; then the intervals within.
        least = inside.groupBy("g").agg(F.min(F.struct("id", "th", "k", "s", "o")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1").select("g", F.col("f.s").alias("t"), F.col("f.o").alias("p"))
        later = inside.join(least, "g").where("s != t or o != p").select("s", "o", "t", "p", "g")
        agreed = scratch.save(_common(later, segments), f"agreed{step}")
        long = agreed.where(F.col("run_words") >= min_words).select("d", "at", "upto")
        runs = long if runs is None else runs.unionByName(long)
        deeper = agreed.where("next is not null").select(F.xxhash64("g", "common", "next").alias("deep"), "s", "o")
        more = deeper.groupBy("deep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("deep")
        step += 1
        inside = scratch.save(deeper.join(more, "deep").join(inside.drop("g"), ["s", "o"]).select(F.col("deep").alias("g"), "id", "th", "k", "s", "o"), f"inside{step}")
        if inside.isEmpty():
            break
    found = runs.join(own.select("d", "id", "th"), "d").select("id", "th", F.col("at").alias("start"), F.col("upto").alias("end"))
    return found.unionByName(copies)


def _merged(spans: DataFrame) -> DataFrame:
    """(id, th, spans): each document's spans, those that meet or overlap as one."""
    before = "max(end) over (partition by id, th order by start, end rows between unbounded preceding and 1 preceding)"
    opened = spans.withColumn("opens", F.expr(f"if(coalesce(start > {before}, true), 1, 0)"))
    whole = opened.withColumn("run", F.expr("sum(opens) over (partition by id, th order by start, end rows unbounded preceding)")).groupBy("id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the lines of spans, which are places among the lines with words."""
    rows = []
    for t, gone in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if t is None or not gone:
            rows.append({"text": t, "lines": 0, "words": 0})
            continue
        out, place, lines, words, at = [], 0, 0, 0, 0
        for line in t.split("\n"):
            n = len(line.encode("utf-8", "surrogatepass").split())
            if n:
                while at < len(gone) and gone[at]["end"] <= place:
                    at += 1
                inside = at < len(gone) and gone[at]["start"] <= place
                place += 1
                if inside:
                    lines, words = lines + 1, words + n
                    continue
            out.append(line)
        rows.append({"text": "\n".join(out), "lines": lines, "words": words})
    return pa.array(rows, pa.struct([("text", pa.string()), ("lines", pa.int64()), ("words", pa.int64())]))


_cut.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}


def without_repeats(df: DataFrame, row: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input with `text` cleaned, n_lines_removed and n_words_removed."""
    scratch = Scratch(df.sparkSession)
    df, restored = set_aside(df, ("__i", "__t", "__spans", "__c", "__field", "__bits"))
    lined = scratch.save(_lined(df, row, text), "lined")
    spans = scratch.save(repeats(lined, scratch, min_words), "spans")
    cut = _merged(spans).select(F.col("id").alias("__i"), F.col("th").alias("__t"), "spans").withColumnRenamed("spans", "__spans")
    cut = scratch.finish(cut, "removed")
    # Only texts that may have a span meet the spans; the others pass without a shuffle.
    field = bit_table(cut.select(F.xxhash64("__i", "__t")), scratch, "field")
    kept = df.drop("n_lines_removed", "n_words_removed")
    near, rest = apart(kept, F.xxhash64(F.col(row), F.xxhash64(text)), field)
    met = near.join(cut, F.col(row).eqNullSafe(F.col("__i")) & (F.xxhash64(text) == F.col("__t")), "left")
    met = met.withColumn("__c", F.arrow_udf(_cut, "struct<text:string,lines:long,words:long>")(F.col(text), F.col("__spans")))
    met = met.withColumns({text: F.col("__c.text"), "n_lines_removed": F.col("__c.lines"), "n_words_removed": F.col("__c.words")})
    rest = rest.withColumns({"n_lines_removed": F.lit(0).cast("long"), "n_words_removed": F.lit(0).cast("long")})
    return restored(met.select(*rest.columns).unionByName(rest))
