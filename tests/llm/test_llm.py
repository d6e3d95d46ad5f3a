"""The training-data operators on small, odd tables, against plain versions."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from terracell.llm import op01_token_orc as op1
from terracell.llm import op02_kneser_ney_lang as op2
from terracell.llm import op03_host_quality as op3
from terracell.llm import op04_media_tiles as op4
from terracell.llm import op05_prefix_bpe as op5
from terracell.llm import op06_bounded_ring as op6
from terracell.llm import op07_best_fit_packing as op7
from terracell.llm import op08_nbsvm_quality as op8
from terracell.llm import op09_hashed_maxent_lm as op9
from terracell.llm import op10_circulant_minhash as op10
from terracell.llm.queries import vocabulary

#: Extra columns, with names that the operators use themselves.
EXTRA = "id long, rep long, key string, n int, hash string, component string, row int, cell int, size string, base double, data string, tokens string"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"


def rows_of(texts):
    r = random.Random(3)
    return [(i, t, r.choice(["en", "de"]), r.choice(["a", "b", None]), 1, 2, "k", 3, "h", "c", 4, 5, "s", 0.5, "d", "t") for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    words = ["".join(r.choice("abcdeöñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    long = [" ".join(r.choice(words) for _ in range(n)) for n in (3, 30, 60, 120, 400)]
    near = long[3].split()
    near[-1] = "changed"
    odd = [None, "", " \t\n", "a", "A b\nA b\n\nc", "x " * 200, "漢字 \u0085 \x1c é́", "🙂" * 70, "w" * 5000, " ".join(words * 60), "The  end<|endoftext|> it's  12,5%%"]
    found = long + [" ".join(near), long[3].upper().lower(), long[3]] + odd
    return [*enumerate(found), (None, "no id"), (5, " ".join(near)), (7, long[3])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_tokens(spark, docs, empty, texts, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    op1.write(docs, str(tmp_path / "t"), vocabulary("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert counted(op1.digests(op1.with_starts(spark, str(tmp_path / "t"))).collect()) == counted(want)
    assert op1.read(spark, str(tmp_path / "t")).where("id = 4").count() == 1
    op1.write(empty, str(tmp_path / "e"), vocabulary("word_bpe_49k.json"))
    assert op1.with_starts(spark, str(tmp_path / "e")).count() == 0


def test_language(spark, empty, docs):
    r = random.Random(2)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(30))
    rows = [(i, make("aeionrst" if i % 2 else "uüklmzß"), ["de", "en"][i % 2]) for i in range(200)]
    model = op2.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.model.langs == ["de", "en"]
    p = np.exp(-model.model.costs(["ae", "z"]))
    assert (p > 0).all() and (p < 1).all()
    got = {x.id: x for x in op2.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang in rows)
    odd = {x.id: x for x in op2.identify(docs, model).collect()}
    assert {odd[k].lang_pred for k in (8, 9, 10)} == {"und"} and odd[8].rejected and all(0 <= x.score <= 1 for x in odd.values())
    assert op2.fit(empty) is None and op2.identify(docs, None).count() == docs.count() and op2.identify(empty, model).count() == 0
    assert op2.accepted(docs, model).columns == docs.columns


def plain_kneser_ney(counts, alphabet):
    """Interpolated Kneser-Ney of one language by dictionaries: P(last character of a window)."""
    orders = {op2.ORDER: dict(counts)}
    for n in range(1, op2.ORDER):
        orders[n] = collections.Counter(g[1:] for g in {w[op2.ORDER - n - 1 :] for w in counts})

    def p(window, n):
        if n == 0:
            return 1 / (len(alphabet) + 1)
        grams, below = orders[n], p(window, n - 1)
        own = {g: v for g, v in grams.items() if g[:-1] == window[len(window) - n : -1]}
        once, twice = sum(v == 1 for v in grams.values()), sum(v == 2 for v in grams.values())
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
        total = sum(own.values())
        if not total:
            return below
        return max(own.get(window[len(window) - n :], 0) - discount * (window[len(window) - n :] in own), 0) / total + discount * len(own) / total * below

    return lambda window: p(window, op2.ORDER)


def test_kneser_ney_against_dictionaries():
    counts = {"x": collections.Counter(), "y": collections.Counter()}
    for lang, words in (("x", ["ab", "abc", "ba", "ab", "cab"]), ("y", ["cc", "ca", "cca"])):
        for w in words:
            s = "\x02" * 4 + w + "\x03"
            counts[lang].update(s[k : k + 5] for k in range(len(w) + 1))
    m, alphabet = op2.Model(counts), "abc\x03"
    points = lambda window: np.array([[ord(c) for c in window]], np.uint32)
    for k, lang in enumerate(m.langs):
        model = plain_kneser_ney(counts[lang], alphabet)
        for past in ("\x02\x02\x02\x02", "\x02\x02\x02a", "\x02\x02ab", "\x02abc", "zzzq"):
            got = [m.probabilities(points(past + c))[0][k] for c in alphabet + "?"]
            assert abs(sum(got) - 1) < 1e-5  # the last one stands for all characters not met
            assert np.allclose(got, [model(past + c) for c in alphabet + "?"], atol=1e-6)
    assert np.allclose(m.costs(["abc", "q", "ca"]), [m.costs([w])[0] for w in ("abc", "q", "ca")])


def test_odd_letters_and_long_words(spark):
    make = [(i, t, lang) for i in range(60) for t, lang in (("the nation of ion one hint", "en"), ("der ist und nicht mit für", "de"))]
    model = op2.fit(spark.createDataFrame(make, "doc_id long, text string, lang string"))
    long = "nation" * 300_000  # one word of 1.8 million letters
    rows = [(1, "½ ② Ⅷ"), (2, "4²"), (3, "the nation Ⅷ"), (4, long), (5, "日本" * 200_000)]
    got = {r.id: r for r in op2.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].rejected and got[3].lang_pred == got[4].lang_pred == "en" and got[5].rejected
    repeated = spark.createDataFrame([(7, "the nation", "en")] * 400 + make, "doc_id long, text string, lang string")
    assert op2.fit(repeated).model.langs == ["de", "en"]


def test_long_words_elsewhere(spark):
    from terracell.llm.common import MEMORY, WordCodes, WordHashes

    long = "ab" * 5_000_000  # a word of 10 MB
    table = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x")], "doc_id long, text string")
    assert {r.doc_id: r.n_shingles for r in op10.groups(table).collect()} == {1: 1, 2: 1, 3: 1}
    assert op8.classify(table, None).count() == 3 and [r.n_tokens for r in sorted(op9.score(table).collect())] == [2, 3, 2]
    codes = WordCodes()
    _ = codes["x" * (MEMORY + 1)]
    assert codes.full() and len(WordHashes()) == 0
    hashes = WordHashes()
    assert hashes[long.encode()] == xxhash.xxh3_64_intdigest(long.encode()) and len(hashes) == 0


def test_hosts(docs, empty, texts):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    got = op3.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert counted(got) == counted((i, *brute(t)) for i, t in texts)
    assert op3.judge(empty).count() == 0


def test_bad_host(spark):
    rows = [(i, "word " * 3 if i % 10 < 9 or i >= 500 else " ".join(f"w{i}x{k}" for k in range(60)), "bad" if i < 500 else "worse") for i in range(1000)]
    rows += [(i, " ".join(f"w{i}x{k}" for k in range(60)), f"good{i % 3}") for i in range(1000, 1600)]
    got = op3.host_verdicts(op3.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert {r.host for r in got if r.host_bad} == {"worse"}


@pytest.mark.parametrize("n_hosts", [100, 3_000])
def test_one_bad_host_among_many(spark, n_hosts):
    n = F.when(F.col("h") == 2, 20).otherwise(500)
    table = spark.range(n_hosts).withColumnRenamed("id", "h").withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    share = F.when(F.col("h").isin(0, 2), 1.0).when(F.col("h") == 1, 0.65).when(F.col("h") == 3, 0.4).otherwise(0.05)  # of failing documents
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")]
    measured = table.select(F.col("k").alias("doc_id"), F.concat(F.lit("h"), "h").alias("host"), F.lit(60).cast("long").alias("n_words"), F.lit(240).cast("long").alias("word_chars"), *zero, (F.col("k") <= share * n).alias("base_failed"))
    got = op3.host_verdicts(measured).where("host_bad").collect()
    assert {(r.host, r.n_docs) for r in got} == {("h0", 500), ("h1", 500), ("h2", 20)}


@pytest.mark.parametrize("weight", [0.25, 2.5, 400.0])
def test_prior_weight(spark, weight):
    """Hosts drawn from a beta prior of known weight, against the formula in plain numbers; a rogue host makes the prior lighter for the others only."""
    rng = np.random.default_rng(7)
    n = rng.integers(20, 400, 600)
    f = rng.binomial(n, rng.beta(0.3 * weight, 0.7 * weight, 600))

    def plain(n, f):
        p, total = f.sum() / n.sum(), n.sum()
        excess = (n * (f / n - p) ** 2).sum() / (p * (1 - p)) - (len(n) - 1)
        within = excess / (total - (n**2).sum() / total - (len(n) - 1))
        return 5.0 if excess <= 0 else min(5.0, max(1.0, 1 / within - 1))

    want = plain(n, f)
    assert abs(want - min(5.0, max(1.0, weight))) < 0.6
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(n, f, strict=True)], "n long, f long")
    sums = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("q"))
    got = sums.select(op3.prior_weight(F.col("k"), F.col("n"), F.col("s"), F.col("f"), F.col("q"))).first()[0]
    assert abs(got - want) < 1e-6


def test_prior_of_few_hosts(spark):
    of = lambda k, n, s, f, q: spark.range(1).select(op3.prior_weight(*(F.lit(float(v)) for v in (k, n, s, f, q)))).first()[0]
    assert of(0, 0, 0, 0, 0) == of(1, 30, 900, 3, 0.3) == of(2, 60, 1800, 0, 0) == of(2, 60, 1800, 60, 60) == of(2, 2, 2, 1, 1) == 1.0
    assert of(2, 60, 1800, 6, 0.6) == 5.0  # equal rates
    assert of(2, 60, 1800, 30, 30) == 1.0  # one fails always, one never


@pytest.mark.parametrize("alike", [False, True])
def test_hosts_sql(spark, alike):
    """All of judge()'s verdicts against the query's SQL, where some hosts are bad, small or without a name, and the others' rates differ or are alike."""
    import duckdb

    from terracell.llm.queries import _hosts_sql

    r = random.Random(12)
    hosts = {"good": (400, 0.05), "fair": (300, 0.4), "most": (300, 0.7), "worst": (200, 1.0), "small": (19, 1.0), "least": (20, 1.0), "quiet": (30, 0.0), None: (50, 1.0)}
    if alike:
        hosts = {"least": (20, 1.0), "small": (19, 1.0), "good": (400, 0.05), "fair": (300, 0.05), "quiet": (30, 0.05), None: (50, 1.0), "worst": (20, 0.95)}
    rows = [(" ".join(f"w{r.random()}" for _ in range(10 if r.random() < bad else 60)), h) for h, (n, bad) in hosts.items() for _ in range(n)]
    rows += [("# " * 60 + " ".join(f"w{r.random()}" for _ in range(200)) + "####" * 300, "signs") for _ in range(40)]
    docs = [(i, t, h) for i, (t, h) in enumerate(rows)]
    got = {x.doc_id: (x.host_bad, x.kept) for x in op3.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    measured = op3.measure(spark.createDataFrame(docs, "doc_id long, text string, source string")).toPandas()  # noqa: F841
    want = duckdb.sql(f"WITH m AS (SELECT * EXCLUDE (base_failed) FROM measured), {_hosts_sql()} SELECT doc_id, host_bad, NOT base_failed AND NOT host_bad FROM judged").fetchall()
    assert got == {i: (bad, kept) for i, bad, kept in want}
    assert {h for i, _, h in docs if got[i][0]} >= {"worst", "signs"} and not any(got[i][0] for i, _, h in docs if h in ("good", "fair", "small", "quiet", None))


def test_media(spark, docs, empty, texts):
    got = {(r.doc_id, r.payload_sha256): r for r in op4.text_digests(docs).collect()}
    for i, t in texts:
        x = (t or "").encode()
        p = x + bytes(-len(x) % 64 if x else 64)
        r = got[i, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(x), len(p), zlib.crc32(p[-64:])) and r.media_bytes > len(p)
    assert op4.text_digests(empty).count() == 0
    image = np.random.default_rng(0).integers(0, 256, (7, 5, 3), np.uint8)
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 5, 7, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(bytes(image[6 - y, :, ::-1].ravel()) + b"\0" for y in range(7))
    ppm = b"P6 # note\n5 7\n255\n" + image.tobytes()
    assert (op4.decode(bmp) == image).all() and (op4.decode(ppm) == image).all()
    assert (op4.decode(b"P1\n2 1\n1 0") == [[[0], [255]]]).all() and (op4.decode(b"P4\n2 1\n\x80") == [[[0], [255]]]).all()
    small, whole = op4.area_resize(image, 3, 2), np.kron(image, np.ones((3, 2, 1)))
    assert np.allclose(small, whole.reshape(3, 7, 2, 5, 3).mean(axis=(1, 3)))
    empty_bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 0, 0, 1, 24, 0, 0, 0, 0, 0, 0)
    huge = struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 2**31 - 1, -(2**31), 1, 32, 0, 0, 0, 0, 0, 0)
    bad = [b"P6 9", b"P5 99999999999999999999 99999999999999999999 255\n", b"P2\n1 1\n255\n300", b"P2\n1 1\n255\n-5", b"P2\n1 1\n255\n" + b"9" * 400, b"P5 0 4 255\n", b"P5 -1 4 255\n", empty_bmp, b"BM" + huge, b"BM", b"P4 100000 100000\n\0", b"P1 3 3\n1 0", b"P2 2 1 255\nx y", b""]
    rows = op4.tiles(spark.createDataFrame([(1, bytearray(ppm)), (2, None), *[(3 + k, bytearray(x)) for k, x in enumerate(bad)]], "id long, media binary")).collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.id)] == [True] + [False] * (1 + len(bad))
    assert all(r.tile is None and r.dhash is None for r in rows if r.id > 1)
    # tile and hash by plain loops
    one = next(r for r in rows if r.id == 1)
    boxes = lambda h, w: [[sum(float(image[y, x].mean()) * max(0, min(y + 1, (i + 1) * 7 / h) - max(y, i * 7 / h)) * max(0, min(x + 1, (j + 1) * 5 / w) - max(x, j * 5 / w)) for y in range(7) for x in range(5)) / (7 / h * 5 / w) for j in range(w)] for i in range(h)]
    grey = [[math.floor(v * 256 + 0.5) for v in line] for line in boxes(8, 9)]
    assert int(one.dhash, 16) == int("".join(str(int(a < b)) for line in grey for a, b in zip(line[:-1], line[1:], strict=True)), 2)
    import io

    tile = np.load(io.BytesIO(one.tile))
    assert tile.shape == (16, 16, 3) and np.allclose(tile.mean(axis=2), boxes(16, 16), atol=1)
    first = next(r for r in got.values() if r.doc_id == 3)
    payload = np.frombuffer(texts[3][1].encode() + bytes(-len(texts[3][1].encode()) % 64), np.uint8).reshape(-1, 64, 1)
    assert bytes(first.tile) == op4.tile_of(payload) and first.feature[:16] == op4.dhash(payload)


def test_prefix_bpe(docs, empty, texts):
    import public_tokenizers
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = op5.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = counted(op5.digests(docs, path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    ids = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in texts]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == counted((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids)
    assert op5.digests(empty, path, public_tokenizers.PATTERN).count() == 0
    back = op5.decode(op5.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert counted((r.id, bytes(r.data)) for r in back) == counted((i, (t or "").encode()) for i, t in texts)
    bpe, r = op5.PrefixBPE(ranks), random.Random(4)
    for _ in range(200):
        old = bytes(r.choice(b"the nation") for _ in range(50))
        k = r.randrange(50)
        new = old[:k] + bytes(r.choice(b"xyz") for _ in range(r.randrange(3))) + old[k + r.randrange(3) :]
        table = bpe.extend(old, [])
        assert bpe.tokens(table) == bpe.merges(old)
        assert bpe.edited(old, table, new, k) == bpe.extend(new, [])
        assert bpe.extend(old + b" more", list(table)) == bpe.extend(old + b" more", [])


def test_ring(spark, docs, empty, texts):
    got = op6.assign(docs, shards=4).collect()
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    n = collections.Counter(r.shard for r in got)
    assert max(n.values()) - min(n.values()) <= 1
    assert op6.assign(empty).count() == 0
    one_id = spark.range(20000).selectExpr("cast(null as long) as doc_id", "cast(id % 15000 as string) as text")
    keys = one_id.selectExpr("shiftrightunsigned(xxhash64(doc_id, cast(octet_length(text) + 1 as long), crc32(cast(text as binary))), 52) as segment").groupBy("segment").count()
    assert keys.agg(F.max("count")).first()[0] < 40  # texts of one id lie all over the ring
    n = collections.Counter(r.shard for r in op6.assign(one_id).collect())
    assert sum(n.values()) == 20000 and max(n.values()) - min(n.values()) <= 1
    many = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'t' as text")  # a third of one key
    n = collections.Counter(r.shard for r in op6.assign(many).collect())
    assert sum(n.values()) == 4000 and max(n.values()) - min(n.values()) <= 1
    # one key after the other, clockwise, each to the first shard with room
    counts = {k: random.Random(k).randrange(5) for k in range(0, 4096, 3)}
    points, total = op6.ring(5, 16), sum(counts.values())
    room, want = [total // 5 + (s < total % 5) for s in range(5)], collections.Counter()
    for k in sorted(counts):
        at = next((j for j, p in enumerate(points) if p[0] >= k), len(points))
        for _ in range(counts[k]):
            j = next(j for j in range(at, at + len(points)) if room[points[j % len(points)][1]])
            room[points[j % len(points)][1]] -= 1
            want[k, points[j % len(points)][1]] += 1
    found = collections.Counter()
    for segment, low, high, shard, _ in op6.layout(counts, 5, 16, 0.0):
        found[segment, shard] += high - low
    assert found == want
    home = lambda shards: {r.doc_id: r.shard for r in op6.assign(spark.range(3000).selectExpr("id as doc_id", "'' as text"), shards, slack=0.25).collect()}
    a, b = home(8), home(9)
    assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)  # plain hashing would move eight in nine


def test_packing(spark, docs, empty, texts):
    caps = (64, 256, 1024)
    got = op7.pack(docs, caps).collect()
    sizes, bins = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.doc_id] += r.n_units
        bins[r.bin, r.capacity].append((r.bin_offset, r.n_units))
    want = collections.Counter()
    for i, t in texts:
        want[i] += len((t or "").encode()) + 1
    assert sizes == want and len({b for b, _ in bins}) == len(bins)
    for (_, cap), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert cap == min(c for c in caps if c >= at)
    assert op7.pack(empty).count() == 0
    # one item at a time into the fullest bin that holds it, by one of the policies
    r = random.Random(6)
    hist = collections.Counter(r.randint(1, 1024) for _ in range(500))
    policy, room = (256, 256, 1024), []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            fits = [x for x in room if x[0] >= length]
            if fits:
                best = min(fits)
            else:
                cap = policy[sum(c < length for c in caps)]
                best = [cap, cap]
                room.append(best)
            best[0] -= length
    cost = lambda contents: sum(op7.sequence_cost(min(c for c in caps if c >= x)) for x in contents)
    _, found = op7.planned(hist, caps, policy)
    assert cost([c for _, _, c, n in found for _ in range(n)]) == pytest.approx(cost([cap - x for x, cap in room]))
    # the plan's sizes are those of least cost of all policies, so of all shorter lists too
    hist = collections.Counter(r.randint(5, 230) for _ in range(500))
    every = [op7.total_cost(op7.planned(hist, caps, p)[1]) for p in op7.policies(caps)]
    assert op7.total_cost(op7.plan(hist, caps)[1]) <= 1.001 * min(every) and len(every) == 6
    assert max(every) > 1.02 * min(every)
    # against the best of all packings, by every way to part few items
    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    for seed in range(6):
        items = [random.Random(seed * 100 + k).randint(10, 700) for k in range(7)]
        least = min(cost([sum(p) for p in parts]) for parts in partitions(items) if max(map(sum, parts)) <= 1024)
        assert op7.total_cost(op7.plan(collections.Counter(items), caps)[1]) <= 1.12 * least
    # one length that most rows have is ranked in several tasks, each place is taken once
    op7.SALTED, before = 300, op7.SALTED
    try:
        same = op7.pack(spark.range(2000).selectExpr("cast(null as long) as doc_id", "repeat('x', if(id % 3 = 0, cast(id % 50 as int), 60)) as text"), caps).collect()
    finally:
        op7.SALTED = before
    assert len({(x.bin, x.bin_offset) for x in same}) == 2000
    assert {x.n_units for x in op7.pack(spark.range(5).selectExpr("id as doc_id", "id * 10 as n"), caps, length_col="n").collect()} == {1, 11, 21, 31, 41}


def test_quality(spark, docs, empty):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    rows = [(i, " ".join((word().upper() + "!!") if i % 4 == 0 else word() for _ in range(80))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = op8.fit(table, labels, most=300)
    got = {x.id: x.score for x in op8.classify(table, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 != 0) for i in got)
    assert all(0 <= x.score <= 1 for x in op8.classify(docs, model).collect())
    assert op8.fit(empty, labels) is None and op8.fit(table, labels.where("quality = 1")) is None
    # an id repeated in both tables reaches the fit once; the fitted weights are those of a dense solver of the same dual problem
    twice = op8.fit(table.union(table.where("doc_id = 8").crossJoin(spark.range(50)).select("doc_id", "text")), labels.union(labels.where("doc_id = 8")), most=300)
    assert np.array_equal(twice.table, model.table) and twice.slope == model.slope
    small = [np.array(sorted(r.sample(range(40), 6))) for _ in range(30)]
    y = np.array([int(x[0] < 6) for x in small])
    c = op8.Classifier(small, y, np.zeros(30, bool), passes=400)
    vectors = np.zeros((30, 41))
    for k, x in enumerate(small):
        vectors[k, x] = c.scale[x] / np.sqrt((c.scale[x] ** 2).sum() + 1e-9)
    vectors[:, 40] = 1
    sign, bound = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 30 / (2 * y.sum()), 30 / (2 * (30 - y.sum())))
    q, alpha = (vectors @ vectors.T) * np.outer(sign, sign), np.zeros(30)
    for _ in range(20000):  # projected gradient
        alpha = np.clip(alpha - 0.05 * (q @ alpha - 1), 0, bound)
    dense = (alpha * sign) @ vectors
    assert np.allclose([c.margin(x) for x in small], vectors @ dense, atol=2e-2)
    assert op8.classify(empty, model).count() == 0 and op8.accepted(docs, model).columns == docs.columns


def test_language_model(spark, docs, empty, texts):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b" "]
    c = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in texts:
        k = tokens(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in k)
        want[i, held(i), len(k), sum(c[w] > 0 for w in k), n, round(base, 6)] += 1
    got = op9.score(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert op9.score(empty).count() == 0


def test_language_model_is_a_function_of_the_table(spark):
    r = random.Random(11)
    kinds = {k: [f"{k}{x}" for x in range(300)] for k in "abc"}
    texts = [" ".join(r.choice(kinds["abc"[i % 3]]) for _ in range(r.randint(20, 80))) for i in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for parts in (1, 4, 16):
        rows = {x.doc_id: x for x in op9.score(table.repartition(parts), shard=20_000).collect()}
        held = [x for x in rows.values() if x.held_out]
        assert sum(x.score for x in held) > sum(x.base_score for x in held)  # likelier than by frequencies alone
        found.append([rows[i].score for i in range(400)])
    assert np.allclose(found[0], found[1], rtol=1e-6) and np.allclose(found[0], found[2], rtol=1e-6)


def test_language_model_sums_to_one(spark, monkeypatch):
    """Over all words, those outside the classes and the unknown one included, after several histories."""
    for name, value in (("HEAD", 12), ("FREQUENT", 20), ("CLASSES", 4)):
        monkeypatch.setattr(op9, name, value)
    monkeypatch.setattr(op9, "PAST", 5)
    r = random.Random(13)
    n = r.choices(range(30), [1 / (k + 1) for k in range(30)], k=3000)
    counts = collections.Counter(n)
    order = sorted(counts, key=lambda k: (-counts[k], k))
    head, kinds = order[:12], np.array([r.randrange(3) for _ in range(12)])
    kind = lambda w: kinds[head.index(w)] if w in head else 3
    one, two, joint = np.zeros((12, 5)), np.zeros((12, 5)), np.zeros((5, 5, 4))
    rest = collections.defaultdict(lambda: np.zeros((2, 5)))
    for a, b, w in zip(n, n[1:], n[2:]):
        joint[kind(b), kind(a), kind(w)] += 1
        if w in head:
            one[head.index(w), kind(b)] += 1
            two[head.index(w), kind(a)] += 1
        else:
            rest[w] += [np.eye(5)[kind(b)], np.eye(5)[kind(a)]]
    bias, u, v, norm = op9.head_weights(one, two, joint, kinds)
    outside = op9.Inside(np.array([x[0] for x in rest.values()]), np.array([x[1] for x in rest.values()]), op9.shares_of(joint[:, :, 3]))
    for _ in range(op9.STEPS):
        outside.step(joint[:, :, 3] / (outside.total() + 0.5))
    norm[:, :, 3] = np.log(outside.total() + 0.5)
    for b in range(5):
        for a in range(5):
            for k in range(3):
                if (kinds == k).any():
                    assert abs(np.exp(bias[kinds == k] + u[kinds == k, b] + v[kinds == k, a] - norm[b, a, k]).sum() - 1) < 1e-9
            assert abs(np.exp(outside.bias + outside.u[:, b] + outside.v[:, a] - norm[b, a, 3]).sum() + 0.5 / np.exp(norm[b, a, 3]) - 1) < 1e-9
    # the frequent words' likelihood inside their class grew by the features
    gain = sum(joint[kind(b), kind(a), kind(w)] > 0 and (bias[head.index(w)] + u[head.index(w), kind(b)] + v[head.index(w), kind(a)] - norm[kind(b), kind(a), kind(w)]) - np.log((counts[w] + 0.5) / sum(counts[x] + 0.5 for x in head if kind(x) == kind(w))) for a, b, w in zip(n, n[1:], n[2:]) if w in head)
    assert gain > 0
    w = np.random.default_rng(0).normal(size=(op9.FIRST[3], 4)).astype(np.float32)
    assert np.allclose(op9.probabilities(w, np.array([[1, 5000, 9000]] * 3)).sum(axis=1), 1)


def test_language_model_hashes_each_distinct_word_once(monkeypatch):
    """Words and their order as of a plain split, however they are spread over texts; bytes that are not UTF-8 and other white space stay in words."""
    r, asked, plain = random.Random(17), [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: asked.append(w) or plain(w))
    texts = [b"", b" \t ", b"\xc3\x84\xff\xfe A\x85b\x1c \x00"] + [bytes(r.choice(b" \t\n\x0b\x0c\rAbZ\x1c\xc3\xa4\xe3\x80\x80\x85") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for column in (pa.array(texts, pa.binary()), pa.array(texts, pa.binary()).slice(2, 9), pa.array([], pa.binary())):
        asked.clear()
        hashes, place, n = op9.distinct_words(column)
        words = [re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) for t in column.to_pylist()]
        assert n.tolist() == [len(x) for x in words] and hashes[place].tolist() == [plain(w) for x in words for w in x]
        assert len(asked) == len(set(asked)) == len({w for x in words for w in x})


def test_language_model_counts_hash_each_distinct_word_once(spark, monkeypatch):
    """More words than a memory held, met twice: each is hashed once for the counts of its slice."""
    asked, plain = collections.Counter(), xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: asked.update([w]) or plain(w))

    class Rows:
        """Keeps the function that Spark would run."""

        select = groupBy = agg = lambda self, *_: self

        def mapInArrow(self, fn, schema):  # noqa: N802
            self.fn = fn
            return self

    text = b" ".join([b"w%d" % k for k in range(310_000)] * 2)
    out = list(op9.count_words(Rows()).fn(iter([pa.RecordBatch.from_arrays([pa.array([text, b""])], names=["data"])])))
    assert sum(b.num_rows for b in out) == 310_000 and {n for b in out for n in b.column(1).to_pylist()} == {2}
    assert len(asked) == 310_000 and set(asked.values()) == {1}


def test_language_model_steps_and_score_match_a_plain_model():
    """Batches against one token at a time: rows met once, several and many times, sums far beyond what exp can hold, and a last batch of few tokens."""
    r = np.random.default_rng(19)
    n = op9.BATCH + 37
    f = np.stack([np.minimum(r.zipf(a, n), 4000) + at for a, at in zip((1.3, 1.5, 1.2), op9.FIRST[:3], strict=True)]).T
    y, first = r.integers(0, 5, n), r.normal(size=(op9.FIRST[3], 5)).astype(np.float32)
    for scale in (1, 100):
        w, squares, used = first.astype(np.float64) * scale, np.zeros(first.shape), np.zeros(len(first))
        for lo in range(0, n, op9.BATCH):
            g = np.zeros(first.shape)
            logits = w[f[lo : lo + op9.BATCH]].sum(axis=1)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for x, k, row in zip(p, y[lo:], f[lo:], strict=False):
                for i in row:
                    g[i] += x - np.eye(5)[k]
                    used[i] += 1
            squares += g * g
            w -= 0.1 * g / np.sqrt(squares + 1e-3)
        got = [first * np.float32(scale), np.zeros_like(first), np.zeros(len(first), np.float32)]
        op9.steps(*got, f, y, 0.1)
        assert (got[2] == used).all() and used.max() > 100 and np.allclose(got[1], squares, rtol=1e-3, atol=1e-3) and np.allclose(got[0], w, rtol=1e-4, atol=2e-4)
    words, classes = np.array([op9.END_HASH, 5, 6, 7, 8], np.uint64), np.array([0, 1, 1])
    space, wide = op9.Space(words, classes), r.normal(size=(op9.FIRST[3], op9.CLASSES))
    bias, u, v, norm = r.normal(size=5), r.normal(size=(5, op9.PAST)), r.normal(size=(5, op9.PAST)), r.normal(size=(op9.PAST, op9.PAST, op9.CLASSES))
    x = space.sequence([op9.packed(np.array([1, 3, 5, 2, 4, 0])), op9.packed(np.array([0]))], [np.array([99], np.uint64).tobytes(), b""])
    want = []
    for i, row in enumerate(space.features(x)):
        number, one, two, kind = (x[k][i] for k in ("number", "one", "two", "class"))
        p = np.exp(wide[row].sum(axis=0))
        own = bias[number] + u[number, one] + v[number, two] if number < 5 else 0
        want.append((np.log(p[kind] / p.sum()) + own - norm[one, two, kind]) / np.log(10))
    assert np.allclose(op9.Model(space, wide, bias, u, v, norm).log10(x), want, atol=1e-5)


def test_near_duplicates(spark, docs, empty, texts):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    r = random.Random(9)
    base = [f"t{k}" for k in range(300)]
    more = [(i, t) for i, t in texts if i is not None]
    for i in range(100, 160):  # copies with a few changes each: pairs on both sides of the limit, chains of links
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(300)] = f"c{r.randrange(99)}"
        more.append((i, " ".join(w)))
    sets = [(i, shingles(t)) for i, t in more]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    got = op10.groups(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == counted((i, len(x), top(i), top(i) == i) for i, x in sets)
    odd = op10.groups(docs).collect()
    assert len(odd) == len(texts) and [r.kept for r in odd if r.doc_id is None] == [False]
    assert op10.groups(empty).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(10)
    rows = [(i, " ".join("".join(r.choice("aeionrst") for _ in range(5)) for _ in range(60)), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, rows[0][1], "en", "s", 1) for i in range(5)] + [(300, "12 34", "en", "s", 1), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(120))
    assert xxhash.xxh64_intdigest(b"") and F


def test_pipeline_near_copies(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")

    def changed(p, n):  # one word differs, in five of n shingles: n - 5 of n + 5 are shared
        w = [f"{p}w{k}" for k in range(n + 4)]
        return " ".join(w), " ".join([*w[: n // 2], "changed", *w[n // 2 + 1 :]])

    rows = [(10 * p + k, t) for p, n in enumerate((46, 45, 50, 44, 60)) for k, t in enumerate(changed(p, n))]  # 41 of 51, 40 of 50, 45 of 55, 39 of 49, 55 of 65
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == [0, 10, 20, 30, 31, 40]


def test_pipeline_repeated_and_missing_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    t = {p: " ".join(f"{p}{k}" for k in range(60)) for p in "abcdef"}
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (3, "c"), (3, "d"), (None, "e"), (5, "e"), (4, "e"), (6, "f"), (None, None), (None, ""), (7, None), (7, None)]
    table = spark.createDataFrame([(i, t.get(p, p), n) for n, (i, p) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, table, str(tmp_path))
    assert got.columns == table.columns
    named = {x: p for p, x in t.items()}
    assert counted((r.doc_id, named.get(r.text, r.text)) for r in got.collect()) == counted([(1, "a"), (None, "b"), (2, "c"), (3, "d"), (4, "e"), (6, "f"), (None, None), (None, ""), (7, None), (7, None)])


def test_words_and_marks_encode_as_whole_texts():
    import public_tokenizers

    from terracell.llm.op01_token_orc import WordTokenizer

    odd = ["", "  ", "a\0b \0 c", "İstanbul İ x", "é é ́a", "x" * 100 + " y", "don't 's they'll <|endoftext|> 日本語 テスト", "tab\tin word", "a., b.. c, d!? e. f;́ x. \ny, \n", "it's, ok. ", "a\u0085b c\x1fd", "ʼn ﬁ ß Å"]
    tok = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 1)
    assert tok.longest > 0  # the probes agree
    odd += [" <|endoftext|> ", "a<|endoftext|>b <|ENDOFTEXT|> c", "<|startoftext|> x <|endoftext"]
    assert 49407 in tok.tokenizer.encode(" <|endoftext|> ", add_special_tokens=False).ids
    for texts in (odd * 2, odd[:1], []):
        for together in (1, 1 << 20):
            ids, n = tok.encode(texts, together)
            want = [x.ids + [1] for x in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_chunks_are_looked_up_once_and_frequent_ones_stay():
    from terracell.llm.common import ChunkCache

    asked, looked = [], []
    cache = ChunkCache(lambda new: asked.append(list(new)) or [[int(x)] * int(x) for x in new], most=40)
    cache.codes = type("Counted", (type(cache.codes),), {"__getitem__": lambda self, x: looked.append(x) or dict.__getitem__(self, x)})(40)
    want = lambda chunks: [int(x) for x in chunks for _ in range(int(x))]
    often = [str(i) for i in range(5)]
    assert cache(often * 100).tolist() == want(often * 100) and looked == often  # each distinct chunk of a call, once
    for lo in range(5, 200, 20):
        chunks = often + [str(i) for i in range(lo, lo + 20)]
        ids, n = cache.sequences(chunks)
        assert ids.tolist() == want(chunks) and n.tolist() == list(map(int, chunks)) and len(cache.codes) <= 60
    assert sum(x == "3" for new in asked for x in new) == 1 and cache([]).tolist() == []


def test_memories_last_over_tasks(spark):
    import os
    import uuid

    import pyarrow as pa

    from terracell.llm.common import kept

    tag = uuid.uuid4().hex

    def each(batches):
        made = []
        kept(("test", tag), lambda: made.append(1) or object())
        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "made": [len(made)], "n": [rows]})

    rows = spark.range(0, 64, 1, 32).mapInArrow(each, "pid long, made long, n long").collect()
    assert len(rows) == 32 and sum(r.made for r in rows) == len({r.pid for r in rows}) < 32


def test_texts_share_chunks_and_prefixes_see_only_tokens_that_end_there():
    import public_tokenizers

    ranks = op5.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    enc, r = op5.TextEncoder(ranks, public_tokenizers.PATTERN), random.Random(6)
    texts = ["", " ", "a  b", "the nation", "thenation the", "x" * 100 + " y", "é naïve 日本語, ok? \n", " lead", "trail ", "it's 12,5%\n\nZ"] * 2
    ids, n = enc.encode_all(texts)
    want = [[i for p in enc.find(t) for i in enc.bpe.piece(p.encode())] for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    decimal, data = enc.joined(ids, n)
    assert decimal == [",".join(map(str, x)).encode() for x in want] and data == [t.encode() for t in texts]
    bpe = op5.PrefixBPE(ranks)
    for _ in range(300):
        word = "".join(r.choices(["th", "e", "ion", "é", "ß", "q", "and", "日"], k=r.randint(1, 8))).encode()
        state = b""
        for end in range(1, len(word) + 1):
            state, found = bpe.step(state + word[end - 1 : end])
            assert [t for t, _ in found] == [ranks[x] for x in (word[i:end] for i in range(end)) if x in ranks and bpe.stands(ranks[x])]
        assert bpe.prefix(word) == bpe.extend(word, [])[-1]


def test_language_costs_do_not_depend_on_memory_and_frequent_words_stay():
    r, scored = random.Random(5), collections.Counter()
    counts = {lang: collections.Counter("".join(r.choices(letters, k=5)) for _ in range(500)) for lang, letters in (("de", "uüklmzß"), ("en", "aeionrst"))}
    model = op2.Model({k: dict(v) for k, v in counts.items()})
    plain = model.costs
    model.costs = lambda words: scored.update(words) or plain(words)
    make = lambda: "".join(r.choices("aeioüßz", k=r.randint(3, 9)))
    texts = [" ".join(["the", "nation", *(make() for _ in range(20))]).encode() for _ in range(60)]
    small = op2.Scorer(model, most=50)
    got = [x for lo in range(0, 60, 3) for x in small.score_all(texts[lo : lo + 3])]
    assert scored["nation"] == 1  # met in every text
    for data, (cost, n) in zip(texts, got, strict=True):
        words = data.decode().split()
        assert n == sum(len(w) + 1 for w in words) and np.allclose(cost, sum(plain([w])[0] for w in words), rtol=1e-5)


def test_latin_words_skip_only_rules_that_change_nothing():
    import public_tokenizers

    from terracell.llm.op01_token_orc import LATIN, WordTokenizer

    tok, r = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), None), random.Random(8)
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    words = LATIN + ["".join(r.choices(letters, k=r.randint(1, 20))) for _ in range(3000)]
    assert tok.bare is not None and tok._latin(["łódź"]) is None
    ids, n = tok._latin(words)
    want = [x.ids for x in tok.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_files(spark, tmp_path):
    """Row indexes, Bloom filters and run-length encoding are in the files; filters on ids read few rows."""
    table = spark.range(6000).selectExpr("id * 3 as doc_id", "repeat('word and word ', cast(id % 7 as int)) as text")
    op1.write(table, str(tmp_path / "t"), vocabulary("word_bpe_49k.json"), index_rows=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [str(f) for f in (tmp_path / "t").glob("*.orc")]
    kinds, rows = set(), 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        own = reader.rows()
        for k, stripe in enumerate(reader.getStripes()):
            footer = own.readStripeFooter(stripe)
            kinds |= {str(x.getKind()) for x in footer.getStreamsList()}
            assert str(footer.getColumns(5).getKind()).startswith("DIRECT_V2")  # integer run-length encoding of tokens' column or lengths
        rows += reader.getNumberOfRows()
        own.close()
    assert rows == 6000 and {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert op1.read(spark, str(tmp_path / "t")).where("id = 2997").select("n_tokens").collect() and op1.read(spark, str(tmp_path / "t")).where("id = 2998").count() == 0
    one_id = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts small tables into one part
    op1.write(one_id.repartition(4), str(tmp_path / "n"), vocabulary("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r.n for r in op1.read(spark, str(tmp_path / "n")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(parts) == 4000 and max(parts) < 2500  # rows without an id are dealt over tasks


def test_page_hosts_sql(spark):
    import os

    import duckdb

    from terracell.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert counted(queries.page_hosts(spark, sf).select("host", "n_docs", "host_bad").collect()) == counted(con.execute(f"SELECT host, n_docs, host_bad FROM ({queries.oracle_sql()['page_hosts']})").fetchall())
