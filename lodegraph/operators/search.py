"""Direct search, lexical search, rank fusion and vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodegraph.functions.text import redact_preview
from lodegraph.scratch import Scratch
from lodegraph.shipping import bounded_arrow, ship

PATTERN_LIMIT = 10 << 20


def lines(files: DataFrame) -> DataFrame:
    """(root, path, line, start, text): 1-based lines with their byte offsets. A final newline starts no line.

    Offsets are running sums inside a row, so a corpus of any size is read without a shuffle.
    """
    parts = F.split("content", "\n")
    raw = files.select("root", "path", F.when(F.col("content").endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts).alias("raw"))
    # Sums by doubling: after step r each place holds the sum of its 2^r places up to it.
    ends = F.transform("raw", lambda x: (F.octet_length(x) + 1).cast("long"))
    starts = F.transform(_running(ends), lambda upto, k: upto - F.octet_length(F.get("raw", k)) - 1)
    cut = raw.select("root", "path", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("raw"))).alias("k", "z"))
    return cut.select("root", "path", (F.col("k") + 1).cast("long").alias("line"), F.col("z.start").alias("start"), F.regexp_replace("z.raw", "\r$", "").alias("text"))


def _running(numbers: Column) -> Column:
    """Running sums of an array in one pass: arrays are joined in runs of about their root, so that no step copies all of it
    for each element."""
    width = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(numbers) - 1) / width).cast("int"), F.lit(0))), lambda r: F.slice(numbers, r * width + 1, width))
    empty = F.array().cast("array<bigint>")
    within = F.transform(runs, lambda run: F.aggregate(run, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))))
    before = F.aggregate(within, empty, lambda acc, run: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.coalesce(F.try_element_at(run, F.lit(-1)), F.lit(0)))))
    return F.flatten(F.transform(within, lambda run, r: F.transform(run, lambda x: x + F.when(r > 0, F.get(before, r - 1)).otherwise(F.lit(0)))))


def checked(pattern: str, is_regex: bool) -> str:
    """The pattern to search by; look-around and back-references are refused, as is what doesn't compile."""
    import regex

    if len(pattern) > PATTERN_LIMIT:
        raise ValueError("the pattern is too large")
    if not is_regex:
        return regex.escape(pattern, special_only=True)
    bare = re.sub(r"\\\\", "", pattern)  # without escaped backslashes
    if re.search(r"(?<!\\)\(\?(?:=|!|<=|<!|>)", bare) or re.search(r"\\(?:[1-9]|k[<{]|g[<{])", bare):
        raise ValueError("look-around and back-references are not supported")
    try:
        regex.compile(pattern, regex.MULTILINE)
    except regex.error as e:
        raise ValueError(f"the pattern is not valid: {e}") from e
    return pattern


MATCHES = {"root": pa.string(), "path": pa.string(), "line": pa.int64(), "column": pa.int64(), "end_line": pa.int64(), "end_column": pa.int64(), "start": pa.int64(), "end": pa.int64(), "line_text": pa.string()}
#: Matches, and bytes of their lines, that a worker hands on at once.
MOST_MATCHES, MOST_BYTES = 4096, 4 << 20


def direct(files: DataFrame, pattern: str, is_regex: bool = False, limit: int | None = None, previews: bool = True) -> DataFrame:
    """(root, path, line, column, end_line, end_column, start, end, preview) of every match, a row each: places are 1-based lines and columns in
    characters, and byte offsets; previews are the lines of the match, redacted, if they are asked for. Matches may span lines.
    `limit` is by path and place. Only a literal can be asked of the file's text before it leaves the JVM."""
    own = checked(pattern, is_regex)
    bounded_arrow(files.sparkSession)
    kinds = dict(list(MATCHES.items())[: None if previews else -1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(own, regex.MULTILINE)
        found = (m for batch in batches for m in matches(batch, compiled, previews))
        for rows in bounded(found):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    given = files if is_regex else files.where(F.col("content").cast("string").contains(pattern))
    found = given.select("root", "path", "content").mapInArrow(work, ", ".join(f"`{n}` {'string' if k == pa.string() else 'long'}" for n, k in kinds.items()))
    out = found.withColumn("preview", redact_preview(F.col("line_text"))).drop("line_text") if previews else found
    return out if limit is None else out.orderBy("root", "path", "start").limit(limit)


def matches(batch: pa.RecordBatch, compiled, previews: bool) -> Iterator[tuple]:
    """Rows of MATCHES of a batch of files. Places are told from the match before, so that long lines are not read again for
    each of their matches."""
    for root, path, content in zip(*batch.columns, strict=True):
        content = content.as_py()
        text = (content.decode("utf-8", "surrogateescape") if isinstance(content, bytes) else content) or ""
        own = root.as_py(), path.as_py()
        before, place, low, high, shown = -1, (0, 0, 1, 1), 0, -1, None
        for m in compiled.finditer(text):
            if m.start() == m.end() == before:  # an empty match right after another one is none
                continue
            before = m.end()
            start = _moved(text, place, m.start())
            place = end = _moved(text, start, m.end())
            row = (*own, start[2], start[3], end[2], end[3], start[1], end[1])
            if not previews:
                yield row
                continue
            if not low <= m.start() <= m.end() <= high:
                low, high = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                high = high if high >= 0 else len(text)
                shown = text[low:high].encode("utf-8", "surrogateescape").decode("utf-8", "replace").strip()
                if "\n" in text[low:high]:  # the lines of this match alone
                    high = -1
            yield (*row, shown)


def _moved(text: str, place: tuple[int, int, int, int], to: int) -> tuple[int, int, int, int]:
    """(character, byte, line, column) of a later character."""
    at, byte, line, column = place
    between = text[at:to]
    lines = between.count("\n")
    return to, byte + len(between.encode("utf-8", "surrogateescape")), line + lines, len(between) - between.rfind("\n") if lines else column + len(between)


def bounded(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of MOST_MATCHES at most; what is shown of them has about MOST_BYTES at most."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) == MOST_MATCHES or size >= MOST_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


#: Letters and digits; what lies between tokens is anything else.
IN = r"[\p{L}\p{N}]"


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that match: branches of the query are OR-ed, each with its own frequency.

    One token asks for its prefix and for itself; several ask for the phrase and for the prefix of each. One pass over
    the texts counts all branches and tokens, and its few numbers a document are written; corpus statistics are one row.
    """
    asked = [t for t in re.split(r"[^\w]+|_", query.lower()) if t]
    if not asked:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = lambda pattern: F.regexp_count(low, F.lit(pattern)).cast("double")
    words = [re.escape(t) for t in asked]
    prefixes = [count(rf"(?<!{IN}){w}") for w in words]
    if len(asked) == 1:
        branches = [prefixes[0], count(rf"(?<!{IN}){words[0]}(?!{IN})")]
    else:
        # A look-ahead, so that phrases that overlap count too.
        phrase = rf"(?<!{IN}){words[0]}(?=" + "".join(f"[^\\p{{L}}\\p{{N}}]+{w}" for w in words[1:]) + rf"(?!{IN}))"
        branches = [count(phrase), *prefixes]
    counted = docs.select(F.col(key), count(IN + "+").alias("__n"), *(c.alias(f"tf{i}") for i, c in enumerate(branches)))
    counted = Scratch(docs.sparkSession).save(counted, "counted")
    stats = counted.agg(F.count(F.lit(1)).alias("__all"), F.avg("__n").alias("__avg"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(branches))))
    scored = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(branches)))).join(F.broadcast(stats))
    norm = k1 * (1 - b + b * F.col("__n") / F.col("__avg"))
    total = F.lit(0.0)
    for i in range(len(branches)):
        idf = F.log((F.col("__all") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + F.when(idf <= 0, 1e-6).otherwise(idf) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm)
    return scored.select(key, total.alias("score"))


def fused(candidates: DataFrame, query: str, boost: float = 0.15) -> DataFrame:
    """Adds score and reasons to (node_id, name, path, artifact_class, in_degree, fts): fixed weights, no training.

    The greatest in-degree is over the candidates, as a one-row aggregate that is joined, not a global window.
    """
    q = query.lower()
    name = F.lower("name")
    top = candidates.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("__top"))
    signals = {
        "exact_name_match": F.when(name == q, 0.5).otherwise(0.0),
        "name_prefix_match": F.when((name != q) & name.startswith(q), 0.3).otherwise(0.0),
        "name_substring_match": F.when(~name.startswith(q) & name.contains(q), 0.15).otherwise(0.0),
        "path_match": F.when(F.lower("path").contains(q), 0.1).otherwise(0.0),
        "fts_lexical_match": F.least(0.1 * F.abs(F.coalesce("fts", F.lit(0.0))), F.lit(0.25)),
        "graph_degree_centrality": F.coalesce("in_degree", F.lit(0)) / F.col("__top") * boost,
        "artifact_class_code": F.when(F.col("artifact_class") == "code", 0.1).otherwise(0.0),
    }
    rows = candidates.join(F.broadcast(top))
    for k, v in signals.items():
        rows = rows.withColumn(f"__{k}", v)
    reasons = F.filter(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(f"__{k}").alias("score")) for k in signals)), lambda x: x["score"] > 0)
    total = sum((F.col(f"__{k}") for k in list(signals)[1:]), F.col("__exact_name_match"))
    return rows.withColumn("score", total).withColumn("reasons", reasons).drop("__top", *(f"__{k}" for k in signals))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; the shorter vector's length counts."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact: (key, score), k rows. Vectors of another dimension don't take part."""
    scored = vectors.where(F.size(vector) == len(query)).select(key, cosine(F.col(vector), F.array(*map(F.lit, query))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


#: Queries that are searched for in one pass over the vectors; vectors of a task of it; vectors whose scores are held at once.
BLOCK, TASK_VECTORS, TILE = 4096, 100_000, 512
#: More than products of matrices differ from sums in order; norms beyond which nothing is said of that.
MARGIN, TINY, HUGE = 1e-9, 1e-100, 1e100


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Exact: (query_id, key, score), k rows for each of queries (query_id, query).

    About `block` queries at a time go to all tasks and their results are written, at any number of queries. A task holds the
    k best of each query among its vectors: products of matrices refuse what can't be among them, the others are scored as
    `cosine` does. Vectors of another dimension than the query's don't take part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    ship(spark)
    queries = scratch.save(queries.select("query_id", "query"), "queries")
    blocks, parts = max(1, -(-queries.count() // block)), []
    spread = vectors.select(key, vector).repartition(max(spark.sparkContext.defaultParallelism, vectors.count() // TASK_VECTORS))
    schema = StructType([StructField("at", LongType()), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        names = spark.createDataFrame(pa.table({"at": pa.array(range(asked.num_rows), pa.int64()), "query_id": asked["query_id"]}))
        given = spark.sparkContext.broadcast(_by_size(asked["query"]))
        scored = spread.mapInArrow(_best_of(given, k), schema).join(F.broadcast(names), "at").select("query_id", key, "score")
        parts.append(scratch.save(scored.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r"), f"block{b}"))
        given.destroy()
    return scratch.finish(reduce(DataFrame.unionByName, parts))


def _by_size(lists: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length of vectors: their places, their numbers (NaN where null), and whether a number is null."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    sizes = pc.fill_null(pc.list_value_length(whole), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        flat = whole.take(pa.array(at)).flatten()
        numbers = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)
        out[n] = at, numbers, flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1)
    return out


def _norms(rows: np.ndarray) -> np.ndarray:
    """Square roots of sums in order, as the engine adds."""
    total = np.zeros(len(rows))
    with np.errstate(all="ignore"):
        for d in range(rows.shape[1]):
            total = total + rows[:, d] * rows[:, d]
    return np.sqrt(total)


def _best_of(given, k: int):
    """A task's k best (at, key, score) of each query: by score, NaN first and null last, then by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {n: (at, q, bad, _norms(np.where(bad[:, None], 0.0, q))) for n, (at, q, bad) in given.value.items()}
        held = {n: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)) for n in asked}
        least = {n: np.full(len(x[0]), -np.inf) for n, x in asked.items()}
        schema = None
        with np.errstate(all="ignore"):
            for batch in batches:
                schema = schema or pa.schema([pa.field("at", pa.int64()), batch.schema.field(0), pa.field("score", pa.float64())])
                keys = batch.column(0)
                own = keys.to_numpy(zero_copy_only=False) if pa.types.is_integer(keys.type) and not keys.null_count else np.array([*keys.to_pylist(), None], object)[:-1]
                for n, (places, numbers, bad) in _by_size(batch.column(1)).items():
                    for low in range(0, len(places) if n in asked else 0, TILE):
                        cut = slice(low, low + TILE)
                        q, score, rows = _candidates(numbers[cut], bad[cut], *asked[n][1:], least[n], k)
                        q, score, mine = (np.concatenate(x) for x in zip(held[n], (q, score, own[places[cut]][rows]), strict=True))
                        held[n], least[n] = _first(q, score, mine, k, len(asked[n][0]))
        for n, (q, score, mine) in held.items():
            if len(q):
                shown = pa.array([None if x == -3 else float("nan") if x == 3 else x for x in score.tolist()], pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(asked[n][0][q], pa.int64()), pa.array(mine.tolist(), schema.field(1).type), shown], schema=schema)

    return work


def _candidates(rows: np.ndarray, bad: np.ndarray, asked: np.ndarray, bad_asked: np.ndarray, norms_asked: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, row) of the pairs that can be among the k best; scores of NaN are 3, null ones -3."""
    norms = _norms(np.where(bad[:, None], 0.0, rows))
    near = (rows @ asked.T) / np.where(norms == 0, 1.0, norms)[:, None] / np.where(norms_asked == 0, 1.0, norms_asked)
    odd = lambda held, own: held | ~((own == 0) | ((own > TINY) & (own < HUGE)))
    near[odd(bad, norms)], near[:, odd(bad_asked, norms_asked)] = np.nan, np.nan
    may = ~(near < least - MARGIN)
    if len(rows) > k and np.count_nonzero(may) > 4 * k * len(asked):
        tops = np.where(np.isnan(near), -np.inf, near)
        may &= ~(near < np.partition(tops, len(rows) - k, axis=0)[len(rows) - k] - 2 * MARGIN)
    row, q = np.nonzero(may)
    dot = np.zeros(len(row))
    for d in range(rows.shape[1]):
        dot = dot + rows[row, d] * asked[q, d]
    score = dot / (norms[row] * norms_asked[q])
    score[np.isnan(score)] = 3.0
    score[bad[row] | bad_asked[q]] = -3.0
    score[((norms[row] == 0) & ~bad[row]) | ((norms_asked[q] == 0) & ~bad_asked[q])] = 0.0
    return q, score, row


def _first(q: np.ndarray, score: np.ndarray, keys: np.ndarray, k: int, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The k best of each query, and the score that a further one must have at least."""
    rank = keys
    if keys.dtype == object:
        order = {x: i for i, x in enumerate(sorted(set(keys.tolist()), key=lambda x: (x is not None, x if x is not None else 0)))}
        rank = np.array([order[x] for x in keys.tolist()], np.int64)
    order = np.lexsort((rank, -score, q))
    sorted_ = q[order]
    new = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(new, np.diff(np.r_[new, len(q)]))
    least = np.full(n, -np.inf)
    last = order[place == k - 1]
    least[q[last]] = score[last]
    stay = order[place < k]
    return (q[stay], score[stay], keys[stay]), least


def hashed_embedding(text: Column, dimension: int) -> Column:
    """Words into buckets by digest, with the sign of a further byte; unit length, or zeros where all cancel or none is."""
    number = lambda d, at, n: F.conv(F.substring(d, at, n), 16, 10).cast("long")
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda x: x != "")
    digests = F.transform(words, lambda w: F.sha2(w, 256))
    # A word's place and sign in one number, sorted: equal places are neighbours.
    coded = F.transform(digests, lambda d: F.struct((number(d, 1, 4) % dimension).cast("int").alias("b"), F.when(number(d, 7, 2) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    zeros = F.array_repeat(F.lit(0.0), dimension)
    # Through an array of one, so that the places are made once.
    raw = F.get(F.transform(F.array(coded), lambda ps: F.transform(zeros, lambda z, i: F.aggregate(F.filter(ps, lambda p: p["b"] == i), z, lambda a, p: a + p["s"]))), 0)
    return normalised(raw)


def normalised(v: Column) -> Column:
    """Of unit length; zeros stay."""
    return F.get(F.transform(F.array(v), lambda x: _unit(x)), 0)


def pseudo_embedding(text: Column, dimension: int) -> Column:
    """A digest's bytes, again and again, scaled to -1 to 1, of unit length: what the offline provider gives."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return normalised(F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(i) / 255.0 * 2.0 - 1.0))


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def overlap_score(query: str | Column, content: Column) -> Column:
    """0.5 and 0.15 for each of the query's words that the content has, 1 at most."""
    words = F.filter(F.split(F.lower(F.lit(query) if isinstance(query, str) else query), "\\s+"), lambda w: w != "")
    return F.least(F.lit(1.0), 0.5 + 0.15 * F.size(F.filter(words, lambda w: F.lower(content).contains(w))))


def put_vectors(old: DataFrame, new: DataFrame, dimension: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors of this dimension replace those of their key; others are left out without a word."""
    fit = new.where(F.size(vector) == dimension)
    return old.join(fit.select(key), key, "left_anti").unionByName(fit.dropDuplicates([key]))


def nearest_where(vectors: DataFrame, query: list[float], k: int, where: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact search among the vectors that fit a condition on their other columns."""
    return nearest(vectors.where(where), query, k, key, vector)
