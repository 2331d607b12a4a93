"""All ten operators on tables with nulls, empties, ties, repeats, no rows and clashing columns; and each one's own limits."""

import gzip
import hashlib
import io
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import bpe, cotraining, jaccard, line_dedup, media, mixing, outliers, token_counts, url_filters, warc

SF = "/root/testdata/sf0.001"
CLASH = "v id ids n key keys token text_ line spans marks mark group g h d at words leader size source_size target times taken n_tokens n_bytes over_limit distance kept score p_text p_meta base_failed n_words n_lines_removed host path rule verdict error payload archive content value declared feature start end k x y th __i __t __s __k __p __h __w __d __g __m __mark __url __id __spans".split()
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", None, "a"), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"), (None, "same text here", "de", "b"), (None, None, None, None), (6, "x" * 60_000, "en", "a"), (7, "a line of text\n" * 300, "en", "b"), (8, "naïve ퟿ 中文 😀 <|endoftext|>", "zz", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1), (4, 0), (5, 1), (5, 0), (None, 1), (6, None), (7, 0)], "doc_id long, quality int")


RUNS = {
    "token counts": lambda d, l: token_counts.with_token_counts(d, P.path("byte_bpe_50k.json")),
    "media": lambda d, l: media.media_features(d),
    "carving": lambda d, l: media.sniffed(media.store(d), carve=False),
    "bpe": lambda d, l: bpe.round_trip(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "bpe ids": lambda d, l: bpe.decoded(bpe.encoded(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "cotraining": lambda d, l: cotraining.scored(d, l),
    "outliers": lambda d, l: outliers.with_verdicts(d),
    "mixing": lambda d, l: mixing.mix(d),
    "jaccard": lambda d, l: jaccard.classes(d),
    "line dedup": lambda d, l: line_dedup.without_repeats(d),
    "url filters": lambda d, l: url_filters.with_verdicts(d.withColumn("url", F.concat(F.lit("http://a.org/"), "text")), [*url_filters.WORD_RULES]),
    "warc": lambda d, l: warc.read_archives(warc.write_archives(d, page="doc_id", url="text", payload="text")),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_is_answered(odd, labels, name):
    got = RUNS[name](odd, labels)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    if "doc_id" in got.columns:
        assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(r[0]) for r in ROWS)
        twice = [tuple(r) for r in rows if r["doc_id"] == 5]
        assert len(twice) == 2 and (name == "mixing" or twice[0] == twice[1])
    assert RUNS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_other_columns_pass(odd, labels):
    for name, new in (("token counts", {"n_tokens", "n_bytes", "over_limit"}), ("cotraining", {"p_text", "p_meta", "score", "kept"}), ("outliers", {"distance", "kept", "base_failed", "n_words"}), ("line dedup", {"n_lines_removed"}), ("url filters", {"host", "path", "rule", "verdict"})):
        r = RUNS[name](odd, labels).where("doc_id = 4").first().asDict()
        for c in CLASH:
            if c not in new and not c.startswith("__"):
                assert r[c] == f"own {c}", (name, c)
        assert all(r[c] != f"own {c}" for c in new), name


# ---- token counts


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_lengths_of_long_texts(file):
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    random.seed(7)
    parts = ["word", " two", "  ", "\n\n", "!?,", "9", "é", "中文", "\x1c", " ", "　x", "\t", "'s", "<|endoftext|>", "."]
    texts = ["".join(random.choices(parts, k=9_000)) for _ in range(6)] + ["ab" * 50_000, ("x" * 70 + "\n") * 3000, "é中" * 40_000]
    path = P.path(file)
    if file.endswith(".json"):
        t = Tokenizer.from_file(path)
        want = [len(t.encode(x, add_special_tokens=False)) for x in texts]
    elif file.endswith(".model"):
        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={}).encode_ordinary(x)) for x in texts]
    encode, splits = token_counts.load(path)
    assert token_counts.lengths(texts, encode, splits) == want and splits == (file in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    for x in texts:
        assert "".join(token_counts.pieces(x, 1000)) == x
    assert [len(p.encode()) for p in token_counts.pieces("ab c" * 3000, 1000)][:2] == [1002, 1000] and len(token_counts.pieces("é中 " * 1000, 1200)) == 5


def test_other_vocabularies_are_not_split():
    import json

    held = json.load(open(P.path("byte_bpe_50k.json")))
    assert token_counts.may_split(json.dumps(held))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split"}, {"type": "ByteLevel"}]}}, {"pre_tokenizer": {**held["pre_tokenizer"], "add_prefix_space": True}}, {"added_tokens": [{"content": "a b"}]}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"pre_tokenizer": None}):
        assert not token_counts.may_split(json.dumps({**held, **change}))


# ---- media


def test_stored_forms_by_other_readers(spark):
    texts = {k: t for k, t in enumerate(["", None, "a" * 191, "a" * 192, "a" * 193, "é" * 500, "b\n" * 9000])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    values = {r["doc_id"]: bytes(r["value"]) for r in media.store(df).collect()}
    for r in media.media_features(df).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b"\x20" * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        value = values[r["doc_id"]]
        if value[:4] == b"RIFF":
            with wave.open(io.BytesIO(value)) as w:
                held = w.readframes(w.getnframes())
        else:
            data, at = b"", 8
            while at < len(value):
                n, kind = struct.unpack_from(">I4s", value, at)
                data += value[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
                at += 12 + n
            lines = zlib.decompress(data)
            held = b"".join(lines[k + 1 : k + 193] for k in range(0, len(lines), 193))
            assert all(lines[k] == 0 for k in range(0, len(lines), 193))
        assert held == want
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(value), hashlib.sha256(value).hexdigest())
        kind = "audio/wav" if value[:4] == b"RIFF" else "image/png"
        assert r["feature"].startswith(kind) and ("corrected" in r["feature"]) == (kind == "audio/wav")


def crc(data, width, polynomial):
    out = 0
    for x in data:
        out ^= x << (width - 8)
        for _ in range(8):
            out = (out << 1) ^ polynomial if out >> (width - 1) else out << 1
            out &= (1 << width) - 1
    return out


def examples():
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    pdf += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(pdf.index(b"1 0 obj") + 22).encode() + b"\n%%EOF"
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\nxref\n0 1\ntrailer\nstartxref\n30\n%%EOF"
    pdf = pdf.replace(b"30", str(pdf.index(b"xref")).encode())
    more = pdf + b"\n2 0 obj\n<<>>\nendobj\nxref\n0 0\ntrailer\nstartxref\n%d\n%%%%EOF" % (len(pdf) + 1 + 22)
    more = more.replace(b"startxref\n%d\n%%%%EOF" % (len(pdf) + 23), b"startxref\n%d\n%%%%EOF" % more.index(b"xref", len(pdf)))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    frame = lambda n: (h := bytes([0xFF, 0xF8, 0x60, 0x00, n, 15]), h := h + bytes([crc(h, 8, 7)]), b := h + bytes(range(40, 70)), b + crc(b, 16, 0x8005).to_bytes(2, "big"))[-1]
    flac = b"fLaC" + b"\x80\x00\x00\x22" + bytes(34) + frame(0) + frame(1)
    mp3 = b"ID3\x03\x00\x00\x00\x00\x00\x05" + bytes(5) + (b"\xff\xfb\x90\x00" + bytes(413)) * 3
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    ogg = b"OggS\x00\x04" + bytes(20) + b"\x01\x05" + b"hello"
    return {
        "image/gif": b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\x00",
        "image/jpeg": b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x02\x01\x11\x00\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00ab\xff\x00c\xff\xd9",
        "video/mp4": box(b"ftyp", b"isom") + box(b"moov", b"x" * 9),
        "application/pdf": more,
        "application/zip": buffer.getvalue(),
        "application/gzip": gzip.compress(b"text " * 400_000),
        "audio/flac": flac,
        "audio/mpeg": mp3,
        "audio/ogg": ogg,
        "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"data",
        "video/avi": b"RIFF" + struct.pack("<I", 16) + b"AVI LIST" + struct.pack("<I", 4) + b"hdrl",
        "image/png": media.as_png(b"q" * 192),
        "audio/wav": media.as_wav(b"q" * 192),
    }


@pytest.mark.parametrize("kind", examples())
def test_formats(kind):
    value = examples()[kind]
    last = media.as_png(b"z" * 192)
    assert [x[:3] for x in media.sniff(value)] == [(kind, 0, len(value))]
    found = media.sniff(b"junk " + value + b"\x00\x01 between " + last)
    assert [x[:2] for x in found] == [(kind, 5), ("image/png", 5 + len(value) + 11)] and found[0][2] == 5 + len(value)
    assert [x[0] for x in media.sniff(value[: len(value) // 2])] in ([], [kind]) and (kind not in ("image/png", "image/gif", "application/zip", "application/gzip", "image/bmp", "audio/wav", "audio/ogg") or not media.sniff(value[:-1]))


def test_chance_magic_is_no_medium():
    random.seed(1)
    for _ in range(30):
        noise = b"".join(random.choice([*media.MAGIC, bytes(random.choices(range(256), k=9))]) for _ in range(200))
        assert media.sniff(noise) == []


# ---- WARC


def test_archives(spark):
    rows = [(k, f"http://x/{k}", "page %d " % (k % 7) * 40) for k in range(60)] + [(3, None, "page 3 " * 40), (None, "u", "page 3 " * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(df).collect()
    seen = []
    for a in archives:
        body = bytes(a["content"])
        assert body[:4] == struct.pack("<I", warc.SKIPPABLE)
        frames = list(warc.frames(body))
        assert frames[0][0] and len(frames) - 1 == len(list(warc.records(body)))
        middle = (frames[1][1] + frames[1][2]) // 2
        broken = list(warc.records(body[:middle] + bytes([body[middle] ^ 255]) + body[middle + 1 :]))
        assert broken[0]["error"] and all(r["error"] is None for r in broken[1:])
        seen += list(warc.records(body))
    assert len(seen) == len(rows) and all(r["error"] is None for r in seen)
    assert sorted(r["record_id"] for r in seen if r["record_type"] == "response") == sorted(["", *map(str, range(7)), "3"])
    assert all(r["refers_to"] == str(int(r["record_id"]) % 7) for r in seen if r["record_type"] == "revisit")
    raw = warc.record(1, "u", b"x", hashlib.sha256(b"x").hexdigest(), 1, None)
    assert warc.parse(raw)["error"] is None and warc.parse(raw[:-1])["error"] and warc.parse(raw.replace(b"WARC/1.1", b"XARC/1.1"))["error"] and warc.parse(raw.replace(b"WARC-Date", b"WARC-Day"))["error"] and warc.parse(raw.replace(b"\r\nx\r\n", b"\r\ny\r\n"))["error"]


# ---- URL filters


def test_rule_lists(spark):
    lines = ["! a list", "", "[Adblock Plus 2.0]", "||ads.com^", "||shop.com/sale/*/big^", "@@||good.ads.com^", "|track.net/x", "banner", "/pixel-[0-9]+\\.gif/", "end.js|", "||a.com^$third-party", "b.com##.ad", "*popup*now"]
    rules = url_filters.parsed(lines)
    assert [r.name for r in rules] == ["||ads.com^", "||shop.com/sale/*/big^", "@@||good.ads.com^", "|track.net/x", "banner", "/pixel-[0-9]+\\.gif/", "end.js|", "*popup*now"]
    assert dict((r.name, r.tokens) for r in rules)["||shop.com/sale/*/big^"] == ("shop", "com", "sale", "big") and dict((r.name, r.tokens) for r in rules)["banner"] == ()
    urls = {"http://ads.com/": "block", "http://x.ads.com/y": "block", "http://good.ads.com/": "allow", "http://badads.com/": "allow", "http://ads.community/": "allow", "http://shop.com/sale/7/big?x": "block", "http://shop.com/sale/7/bigger": "allow", "http://track.net/xyz": "block", "http://a.track.net/x": "allow", "http://q.org/mybanners": "block", "http://q.org/PIXEL-12.gif": "block", "http://q.org/the/end.js": "block", "http://q.org/end.js/more": "allow", "http://q.org/xpopup-right-nowx": "block", "http://b.com/": "allow", None: "allow", "none": "allow"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for most in (10_000, 0):  # the broadcast index, and the one that is joined by shuffle
        assert {r["url"]: r["verdict"] for r in url_filters.with_verdicts(df, rules, broadcast=most).collect()} == urls
    assert url_filters.with_verdicts(df.limit(0), rules).count() == 0 and {r["verdict"] for r in url_filters.with_verdicts(df, []).collect()} == {"allow"}


def test_boundaries_beyond_ascii(spark):
    df = spark.createDataFrame([("http://a.com/écasino/",), ("http://a.com/Kcasino",), ("http://a.com/mycasino",), ("http://A.com/CASINO",)], "url string")
    assert [r["verdict"] for r in url_filters.with_verdicts(df, list(url_filters.WORD_RULES)).orderBy("url").collect()] == ["block", "allow", "block", "block"]
    same = [url_filters.host_rule("allow", "a.b/x"), url_filters.host_rule("block", "a.b/y")]
    assert {r["rule"] for r in url_filters.with_verdicts(spark.createDataFrame([("http://a.b/x",), ("http://a.b/y",)], "url string"), same).collect()} == {"a.b/x", "a.b/y"}


# ---- classifier


def test_held_out_accuracy(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = cotraining.scored(d, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r["kept"] for r in held if r["quality"] == 1], [r["kept"] for r in held if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert len({r["score"] for r in held}) > len(held) / 2
    again = cotraining.scored(d.repartition(7), labels.where("doc_id % 3 <> 0")).collect()
    assert {(r["doc_id"], r["kept"]) for r in again} == {(r["doc_id"], r["kept"]) for r in cotraining.scored(d, labels.where("doc_id % 3 <> 0")).collect()}


# ---- outliers


def test_robust_distances(spark):
    """The centre and scatter of many random starts, run to the end, and the same verdicts."""
    random.seed(11)
    vocabulary = [f"{'abcdefghij'[k % 10] * (1 + k % 7)}{k}" for k in range(400)]
    texts = []
    for k in range(240):
        w = [random.choice(vocabulary) for _ in range(random.randint(60, 400))]
        if k % 24 == 5:  # a tenth of them full of symbols
            w = [x if j % 3 else "###$$$" for j, x in enumerate(w)]
        texts.append((k, " ".join(w), "en", "s"))
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    stats = outliers.with_statistics(df).withColumns(outliers.transformed()).orderBy("doc_id").collect()
    x = np.array([[r[f] for f in outliers.FEATURES] for r in stats])
    h, best = int(np.ceil(outliers.SUPPORT * len(x))), None
    generator = np.random.default_rng(3)
    for _ in range(60):
        part = generator.choice(len(x), 8, replace=False)
        for _ in range(60):
            c, s = x[part].mean(0), np.cov(x[part].T, bias=True) + 0.01 * np.eye(x.shape[1])
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(part):
                break
            part = new
        logdet = np.linalg.slogdet(s)[1]
        if best is None or logdet < best[0]:
            best = (logdet, c, s)
    _, c, s = best
    z = x - c
    for j, f in enumerate(outliers.FEATURES):
        z[:, j] = np.maximum(z[:, j], 0) if f in outliers.ONE_SIDED else z[:, j]
    d = np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z)
    want = d / max(np.median(d), 0.5) * outliers.CHI_MEDIAN <= outliers.CUTOFF * outliers.CHI_MEDIAN
    got = [r["kept"] for r in outliers.with_verdicts(df).orderBy("doc_id").collect()]
    assert got == want.tolist() and sum(not k for k in got) == 10


def test_many_groups_meet_by_a_join(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted((r["doc_id"], r["distance"], r["kept"]) for r in outliers.with_verdicts(d).collect())
    monkeypatch.setattr(outliers, "BROADCAST_GROUPS", 0)
    assert sorted((r["doc_id"], r["distance"], r["kept"]) for r in outliers.with_verdicts(d).collect()) == want


# ---- mixing


def test_keys_keep_their_order_at_all_weights(spark):
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"), F.lit("s").alias("source"))
    keys = [r["k"] for r in df.select(mixing.sampling_key(F.col("doc_id"), F.col("text"), F.lit(1e-6)).alias("k")).collect()]
    assert len(set(keys)) == len(keys) and 0 < min(keys) and max(keys) < 1 << mixing.KEY_BITS
    light = F.when(F.col("doc_id") % 2 == 0, 0.05).otherwise(1.0)
    rows = mixing.mix(df, share=0.5, most=1.0, weight=light).collect()
    taken = [sum(r["taken"] > 0 for r in rows if r["doc_id"] % 2 == odd) for odd in (0, 1)]
    u = np.random.default_rng(1).random((2, 50_000))
    order = np.concatenate([-np.log(u[0]) / 0.05, -np.log(u[1])])
    cut = np.sort(order)[50_000]
    want = [(order[:50_000] < cut).sum(), (order[50_000:] < cut).sum()]
    assert sum(taken) == 50_000 and all(abs(a - b) < 900 for a, b in zip(taken, want, strict=True))


def test_selection_is_the_prefix_of_the_keys(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = mixing.sampling_key(F.col("doc_id"), F.col("text"), mixing.quality_weight("text"))
    keys = {r["doc_id"]: r["k"] for r in d.select("doc_id", key.alias("k")).collect()}
    rows, by = mixing.mix(d).collect(), {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    for group in by.values():
        size, target = group[0]["source_size"], group[0]["target"]
        epochs, left = int(target // size), target - int(target // size) * size
        total = 0
        for r in sorted(group, key=lambda r: (keys[r["doc_id"]], r["doc_id"])):
            total += r["size"]
            once = total - r["size"] / 2 <= left
            assert r["times"] == min(2, epochs + (once and left > 0)), (r, left, total)


def test_copies_of_one_row_straddle_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL", 10)
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source")).repartition(6)
    rows = mixing.mix(df).collect()
    assert len(rows) == 5000 and abs(sum(r["taken"] for r in rows) - 30_000) <= 4 and {r["times"] for r in rows} == {1, 2}


def test_targets(spark):
    sizes = spark.createDataFrame([("b", 100), ("a", 1000), (None, 10), ("B", 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # By code point: B, a, b, none weigh 3, 1, 2, 3 of 1,740; B, b and none are full at 100, 200, 20, the rest is a's.
    assert got["B"] == 100 and got[None] == 20 and got["b"] == 200 and abs(got["a"] - 1420) < 1e-6


# ---- Jaccard, line dedup


def test_sketches_bound_the_difference():
    random.seed(2)
    for _ in range(200):
        a = set(random.sample(range(1, 1 << 60), random.randint(1, 300)))
        b = set(random.sample(sorted(a), random.randint(0, len(a)))) | set(random.sample(range(1, 1 << 60), random.randint(0, 200)))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if len(y):
            assert jaccard.sketch_distance(jaccard.sketch(x), jaccard.sketch(y)) <= len(a ^ b) and jaccard.sketch_distance(jaccard.sketch(x), jaccard.sketch(x)) == 0


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_linked_sets_share_a_key(num, den):
    random.seed(num)
    for _ in range(300):
        n = random.choice([1, 2, 5, 20, 77, 300, 1500])
        a = {random.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(random.randint(0, max(1, n // 4))):
            if random.random() < 0.5 and len(b) > 1:
                b.remove(random.choice(sorted(b)))
            else:
                b.add(random.randrange(1 << 64))
        if den * len(a & b) < num * len(a | b):
            continue
        keys = [jaccard.block_keys(np.array(sorted(s), np.uint64), num, den) for s in (a, b)]
        shared = set(k for _, ks in keys[0] for k in ks.tolist()) & set(k for _, ks in keys[1] for k in ks.tolist())
        assert shared, (len(a), len(a ^ b))
        for own in keys:
            assert any(len(shared & set(ks.tolist())) >= need for need, ks in own)


def test_longest_agreement_with_any_earlier_copy(spark):
    """The first copy has the long line only; a later one has more of the run."""
    long, tail, more = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(20)), " ".join(f"c{k}" for k in range(5))
    rows = [(1, long + "\nother"), (2, long + "\n" + tail + "\nelse"), (3, "start\n" + long + "\n" + tail + "\n" + more), (4, long + "\n" + tail + "\n" + more + "\nown")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: tail + "\nelse", 3: "start\n" + more, 4: "own"}


def test_copies_do_not_overlap(spark):
    six = "a b c d e f"
    rows = [(1, "\n".join([six] * 10)), (2, "\n".join(f"{k} {six}" for k in range(9))), (3, "\n".join(["z"] * 120))]
    got = {r["doc_id"]: r["n_lines_removed"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 70}


def test_line_dedup_by_the_definition(spark):
    from brute_lines import removed

    for seed in range(3):
        random.seed(seed)
        parts = ["a b c", "d e", "f g h i", "", "j", "k l m n o p"]
        run = [random.choice(parts) for _ in range(12)]
        rows = []
        for k in range(30):
            own = [random.choice(parts) for _ in range(random.randint(0, 9))]
            cut = random.randint(0, 8)
            rows.append((random.choice([k, 3, None]), "\n".join(own + run[cut : cut + random.randint(0, 9)] * random.choice([1, 1, 2]))))
        rows.append((99, "\n".join(["t u v"] * 40)))
        rows += rows[:3]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        order = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        want = removed(rows, 10, order.get)
        got = sorted(repr((r["doc_id"], r["text"], r["n_lines_removed"])) for r in line_dedup.without_repeats(df, min_words=10).collect())
        assert got == sorted(repr((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), ())), len(want.get((i, t), ())))) for i, t in rows)
