"""Small cases of every corpus operator: exact comparisons, nulls, empties, repeats, clashes."""

import collections
import datetime as dt
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinsplit.llm import bitpack, bpe, decontaminate, flac, jaccard_join, language_id, license_scan, quality, toxicity, url_filter

PATH8, PATH5 = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", "  \n", "a", "x" * 3000, "Wórd don't 12 😀", "Same text here, twice.", "Same text here, twice."]


def docs(spark, texts=ODD, **more):
    rows = [(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_bpe(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH5), special_tokens={})
    got = bpe.decode(bpe.encode(docs(spark).withColumn("ids", F.lit("old")), PATH5, P.PATTERN), PATH5).collect()
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.score == "clash"
    row = bpe.op5(docs(spark, ["hello world"]), PATH5, P.PATTERN).first()
    ids = np.array(enc.encode_ordinary("hello world"), "<u4").tobytes()
    assert row.n_tokens == len(ids) // 4 and row.ids_sha256 == hashlib.sha256(ids).hexdigest() and row.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.op5(docs(spark, []), PATH5, P.PATTERN).count() == 0


def test_bpe_of_higher_order_functions(spark):
    ranks = bpe.read_ranks(PATH5)
    words = ["", "a", " the", "idiots", " mentenré", "日本", "x9!", "aaaaaaaa"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.encode_words(F.col("w"), PATH5).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: bpe.fold(w.encode(), ranks) if w else [] for w in words}


def test_long_words_fold_alike():
    ranks, rng = bpe.read_ranks(PATH5), random.Random(1)
    for _ in range(200):
        w = "".join(rng.choice("abcde é") for _ in range(rng.randint(2, 60))).encode()
        assert w in ranks or bpe.fold(w, ranks) == bpe._fold_long(w, ranks)


def test_packed_files(spark):
    t = Tokenizer.from_file(PATH8)
    t.encode_special_tokens = True
    got = bitpack.op8(docs(spark), PATH8).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    by_id = {None: ODD[3]} | {i: x for i, x in enumerate(ODD) if i != 3}
    start = 0
    for r in got:
        ids = np.array(t.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(ODD) and bitpack.op8(docs(spark, []), PATH8).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_any_width(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 9001, dtype=np.uint64).astype(np.uint32)
    r = bitpack.Reader(bitpack.write_file([(7, ids[:4000]), (None, ids[:0]), (9, ids[4000:])], bits))
    assert (r.ids(0, 10**9) == ids).all() and (r.ids(4090, 20) == ids[4090:4110]).all() and r.ids(9001, 5).size == 0
    with pytest.raises(ValueError):
        bitpack.pack(np.array([2**bits], np.uint64), bits)


def test_words_split_as_the_library_does():
    t = Tokenizer.from_file(PATH8)
    t.encode_special_tokens = True
    texts = ["Wo̊rd! don't. a-b- x.y, İI É. W̊, é. I'LL 's q' 3, a3. ΑΣ. ﬁ,", "\x1c x y   z", "<|endoftext|> a<|endoftext|>."]
    for got, text in zip(bitpack.WordCodec(PATH8).encode(texts), texts):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids + [1]


def test_special_tokens_as_the_library_reads_them(spark):
    t = Tokenizer.from_file(PATH8)
    texts = ["a <|endoftext|> b", "x<|startoftext|><|endoftext|>. Y!", "<|ENDOFTEXT|> <|endoftext|", "<|endoftext|>", "<|endoftext|>, é<|endoftext|>", "plain. Words!"]
    got = bitpack.op8(docs(spark, [*texts[:3], "", *texts[3:]]).filter("doc_id is not null"), PATH8).orderBy("doc_id").collect()
    start = 0
    for r, text in zip(got, texts, strict=True):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_flac_round_trips_and_seeks(spark):
    rng = random.Random(2)
    for p in (b"", b"a", b" " * 192, bytes(range(256)) * 40, rng.randbytes(9000), bytes([0, 255]) * 5000, "été ".encode() * 3000):
        s = flac.encode(p)
        assert flac.decode(s) == p
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        assert (flac.read_samples(s, 4000, 300)[:, 0] == x[4000:4300]).all()
    for at in (60, len(s) // 2, len(s) - 1):
        with pytest.raises(flac.FlacError):
            flac.decode(s[:at] + bytes([s[at] ^ 4]) + s[at + 1 :])
    rows = flac.op7(docs(spark)).collect()
    for r in rows:
        text = ODD[3] if r.doc_id is None else ODD[r.doc_id]
        p, n = flac.payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    by_id = {r.doc_id: r[1:] for r in rows}
    assert len(rows) == len(by_id) == len(ODD) and by_id[6] == by_id[7]
    media = flac.to_media(docs(spark))
    assert flac.describe(media).count() == len(ODD)
    assert sorted(r.sample_offset for r in flac.pcm_blocks(media).filter("doc_id = 4").collect()) == [0]


class Bits:
    """A writer of the format's bit fields, apart from the encoder under test."""

    def __init__(self):
        self.text = ""

    def put(self, value: int, width: int):
        self.text += f"{value & ((1 << width) - 1):0{width}b}" if width else ""
        return self

    def rice(self, values, k: int):
        for v in values:
            u = 2 * v if v >= 0 else -2 * v - 1
            self.text += "0" * (u >> k) + "1"
            self.put(u, k)
        return self

    def data(self) -> bytes:
        text = self.text + "0" * (-len(self.text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def foreign_crc(data: bytes, poly: int, width: int) -> bytes:
    crc = 0
    for byte in data:
        crc ^= byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc >> (width - 1) else crc << 1) & ((1 << width) - 1)
    return crc.to_bytes(width // 8, "big")


def lpc(bits, x, width, taps, shift, parts, method):
    """An LPC subframe in Rice partitions, the last of which is not coded."""
    order = len(taps)
    bits.put(0, 1).put(31 + order, 6).put(0, 1)
    for v in x[:order]:
        bits.put(v, width)
    bits.put(6, 4).put(shift, 5)
    for t in taps:
        bits.put(t, 7)
    r = [x[i] - (sum(t * x[i - 1 - j] for j, t in enumerate(taps)) >> shift) for i in range(order, len(x))]
    bits.put(method, 2).put(parts.bit_length() - 1, 4)
    size, at = len(x) // parts, 0
    for p in range(parts):
        own = r[at : at + size - (order if p == 0 else 0)]
        at += len(own)
        if p == parts - 1:
            bits.put(-1, 4 + method).put(20, 5)
            for v in own:
                bits.put(v, 20)
        else:
            bits.put(6, 4 + method).rice(own, 6)


def foreign_stream(left, right, block, seek=None, variable=False):
    """16-bit stereo as other encoders write it: LPC, partitions, each channel layout, wasted bits."""
    frames, offsets, at = [], [], 0
    for i, start in enumerate(range(0, len(left), block)):
        a, b = left[start : start + block], right[start : start + block]
        layout = (1, 8, 9, 10)[i % 4]
        side = [x - y for x, y in zip(a, b)]
        first, second = {1: (a, b), 8: (a, side), 9: (side, b), 10: ([(x + y) >> 1 for x, y in zip(a, b)], side)}[layout]
        number = start if variable else i
        coded = bytes([number]) if number < 128 else bytes([0xC0 | number >> 6, 0x80 | number & 63]) if number < 2048 else bytes([0xE0 | number >> 12, 0x80 | number >> 6 & 63, 0x80 | number & 63])
        head = bytes([0xFF, 0xF8 | variable, 7 << 4 | 9, layout << 4 | 4 << 1]) + coded + (len(a) - 1).to_bytes(2, "big")
        head += foreign_crc(head, 0x07, 8)
        bits = Bits()
        lpc(bits, first, 16 + (layout == 9), [3, -1], 1, 4 if len(a) % 4 == 0 else 1, i % 2)
        wide = 16 + (layout in (8, 10))
        if all(v % 4 == 0 for v in second):  # two wasted bits
            bits.put(0, 1).put(1, 6).put(1, 1).put(1, 2)
            for v in second:
                bits.put(v >> 2, wide - 2)
        else:
            bits.put(0, 1).put(1, 6).put(0, 1)
            for v in second:
                bits.put(v, wide)
        body = head + bits.data()
        frames.append(body + foreign_crc(body, 0x8005, 16))
        offsets.append((start, at, len(a)))
        at += len(frames[-1])
    raw = np.stack([left, right], 1).astype("<i2").tobytes()
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | len(left)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    table = b"".join(s.to_bytes(8, "big") + o.to_bytes(8, "big") + n.to_bytes(2, "big") for s, o, n in (seek and [offsets[k] for k in seek] or [])) + (b"\xff" * 8 + bytes(10) if seek else b"")
    meta = b"\x00" + len(info).to_bytes(3, "big") + info + (b"\x03" + len(table).to_bytes(3, "big") + table if table else b"") + b"\x84" + (8).to_bytes(3, "big") + bytes(8)
    return b"fLaC" + meta + b"".join(frames)


@pytest.mark.parametrize("seek", [None, [0], [2, 5]])
@pytest.mark.parametrize("variable", [False, True])
def test_flac_reads_streams_of_others(seek, variable):
    rng = random.Random(4)
    left = [int(9000 * np.sin(i / 9)) + rng.randint(-200, 200) for i in range(2100)]
    right = [(v // 3 + rng.randint(-99, 99)) // 4 * 4 for v in left]
    left[600:1200] = [v + d for v, d in zip(right[600:1200], [4 * rng.randint(-9, 9) for _ in range(600)])]
    stream = foreign_stream(left, right, 256, seek, variable)
    x = flac.decode_samples(stream)
    assert x.tolist() == [list(p) for p in zip(left, right)]
    assert flac.read_samples(stream, 1000, 700).tolist() == x[1000:1700].tolist()
    with pytest.raises(flac.FlacError):
        flac.decode_samples(stream[:-40] + bytes([stream[-40] ^ 1]) + stream[-39:])


def test_flac_needs_no_seek_table():
    p = bytes(random.Random(6).choices(b"abc \n\xff\xf8", k=9000))
    s = flac.encode(p)
    info = flac.read_info(s)
    size = 18 * len(info.points)
    bare = s[:42].replace(b"\x00\x00\x00\x22", b"\x80\x00\x00\x22", 1) + s[info.first_frame :]
    short = s[:42] + b"\x83" + (18).to_bytes(3, "big") + s[46:64] + s[info.first_frame :]
    assert size == 54 and flac.decode(bare) == flac.decode(short) == p
    assert flac.read_samples(bare, 5000, 10).tolist() == flac.read_samples(s, 5000, 10).tolist()


def test_media_are_stored_and_read_back(spark):
    frame = docs(spark, [*ODD, "long text of many words " * 3000])
    media = flac.store_media(frame.select("doc_id", "text"))
    assert media.inputFiles() and flac.describe(media).count() == len(ODD) + 1
    pcm = flac.pcm_blocks(media).collect()
    whole = flac.payload("long text of many words " * 3000)[0]
    own = sorted((r.sample_offset, bytes(r.pcm)) for r in pcm if r.doc_id == 8)
    assert [o for o, _ in own] == list(range(0, len(whole), flac.BLOCK)) and b"".join(b for _, b in own) == whole
    assert sum(r.doc_id is None for r in pcm) == 1 and flac.op7(docs(spark, [])).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def near_copies():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(120)]
    out, chain = [], base
    for k in range(40):
        w = base.copy()
        for j in rng.sample(range(120), 2):
            w[j] = f"x{k}_{j}"
        out.append(" ".join(w))
    for k in range(12):
        chain = chain.copy()
        chain[(k * 6) % 120] = f"c{k}"
        out.append(" ".join(chain))
    out += [" ".join(f"o{rng.randint(0, 500)}" for _ in range(rng.randint(1, 60))) for _ in range(25)]
    return [*out, *out[:2], "", None, " \n", "A b", "a B", "é"]


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    rows = list(enumerate(near_copies()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_join.join(frame).collect())
    assert got == brute_components(rows)
    kept = sorted(r.doc_id for r in jaccard_join.deduplicate(frame.withColumn("n_chars", F.length("text"))).collect())
    assert kept == sorted(d for d, _, c in got if d == c)


def test_copies_in_two_tasks_hide_no_block(spark):
    """Two pairs of near copies, each with its passage in the same two other texts, all of it in two partitions."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    c, d = ([word() for _ in range(16)] for _ in range(2))
    whole = [[*c, *d, *(word() for _ in range(6))] for _ in range(2)]
    texts = [" ".join(w) for w in (*whole, c, [*c[:-1], "last"], d, [*d[:-1], "last"])]
    rows = list(enumerate(texts * 2))
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.join(frame).collect()) == brute_components(rows)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    points = rng.poisson(2, (300, 64)).astype(np.int64)
    points[100:160] = points[:60] + (rng.random((60, 64)) < 0.02)
    tree = jaccard_join.RTree(points)
    for q in points[::7]:
        assert sorted(tree.partners(q).tolist()) == [i for i, p in enumerate(points) if np.minimum(p, q).sum() >= jaccard_join.needed(p.sum(), q.sum())]


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (15, 40, 60)]
    changed = items[1].split()
    changed[7] = changed[19] = changed[30] = "other"
    around = lambda t: " ".join([*(word() for _ in range(30)), t, *(word() for _ in range(30))])
    texts = [around(items[0].upper()), around(" ".join(changed)), around(items[2].replace(" ", ", ")), around(""), None, "", around(" ".join(items[1].split()[:6]))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, "too short"])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [3, 4, 5, 6]
    assert decontaminate.decontaminate(frame, bench.limit(0)).count() == 7


def test_two_substitutions_in_thirteen_words_never_hide_a_seed():
    for gone in itertools.combinations(range(13), 2):
        assert any(all(m[k] == "0" or p + k not in gone for k in range(len(m))) for m in decontaminate.MASKS for p in range(13 - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 14))
def test_no_allowed_substitutions_hide_an_item(n):
    words = decontaminate.hashes(" ".join(f"w{i}" for i in range(n)))
    index = decontaminate.Index([(7, words)])
    for k in range(n - int(np.ceil(0.8 * n)) + 2):
        for gone in itertools.combinations(range(n), k):
            changed = words.copy()
            changed[list(gone)] += np.uint64(1)
            found = index.leaks(changed)
            assert found == ([(7, 0, n - k, n)] if n - k >= 0.8 * n else []), gone


def test_short_items_and_signs_beyond_ascii(spark):
    items = ["Paris", "to be or not", "one two three four five", "“Quoted” words — and 😀more…", "", None, "…"]
    texts = ["in PARIS.", "to be or", "to be, or not!", "one two tree four five", "one two tree fore five", "quoted words and more", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = [(0, 0), (2, 1), (3, 2), (5, 3)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()) == want
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()) == [1, 4, 6, 7]


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ne", "ri", "to", "lu"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "moronic", "idiots"])
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    model = toxicity.train(labelled(600, 1))
    held = labelled(200, 2)
    p = model.scorer()([t for t, _ in held])
    assert np.mean([(x >= 0.5) == bool(y) for x, y in zip(p, held) for x, y in [(x, y[1])]]) > 0.95
    assert model.word_score("idiotts") > model.word_score("bane")
    frame = toxicity.score(docs(spark), model)
    assert frame.filter("score is null").count() == 0 and frame.count() == len(ODD)
    assert toxicity.train([]).scorer()(["x", None])[0] == pytest.approx(0.5)


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join("".join(rng.choice("ba ne ri to lu ka mi so".split()) for _ in range(3)) for _ in range(60)) + "."
    junk = lambda: " ".join(w + rng.choice(["%%%", "$$$"]) for w in good().split())
    x = lambda texts: np.array([quality.features(t) for t in texts])
    model = quality.train(x([good() for _ in range(200)]), x([good() for _ in range(240)] + [junk() for _ in range(60)]))
    assert 0.7 < model.prior < 0.9
    assert (model.scores(x([good() for _ in range(100)])) >= 0.3).mean() > 0.95 and (model.scores(x([junk() for _ in range(100)])) < 0.3).all()
    frame = quality.score(docs(spark), model)
    assert frame.filter("score is null or score < 0 or score > 1").count() == 0
    with pytest.warns(UserWarning, match="too few"):
        assert quality.train(x([]).reshape(0, quality.N_FEATURES), x([]).reshape(0, quality.N_FEATURES)).scores(x([""]))[0] == 0.5


def test_quality_where_labels_list_every_document(spark, monkeypatch):
    monkeypatch.setattr(quality, "UNLABELLED_ROWS", 40)
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice("ba ne ri to lu ka mi so".split()) for _ in range(3)) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else good().replace(" ", " %%% ")) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    tallies = []
    monkeypatch.setattr(quality, "estimate_prior", lambda p, tally, own=quality.estimate_prior: tallies.append(tally) or own(p, tally))
    got = {r.doc_id: r.predicted for r in quality.op2(frame, labels).collect()}
    assert np.mean([got[i] == int(i % 3 > 0) for i, _ in rows]) > 0.9
    assert tallies[0].sum() == sum(zlib.crc32(str(i).encode()) % 5 == 0 or i % 7 == 0 for i, _ in rows)


def test_language(spark):
    de, en = "der die das und nicht ein ich werden haben schule", "the and that with have this from they which school"
    rng = random.Random(6)
    text = lambda words, n=40: " ".join(rng.choice(words.split()) for _ in range(n))
    model = language_id.train([(text(de), "de") for _ in range(30)] + [(text(en), "en") for _ in range(30)])
    got = language_id.predict(docs(spark, [text(de), text(en), text(de, 30) + " " + text(en, 10), None, "", "123 ++"]).withColumn("lang_pred", F.lit(1)), model).collect()
    assert [r.lang_pred for r in got] == ["de", "en", "de", "und", "und", "und"]
    assert 0.6 < got[2].score < 0.9 and got[3].score == 0.0
    assert language_id.train([]).predictor()(["abc"]) == [("und", 0.0)]


PROSE = ["Some ordinary lines about the weather and the town.", "A second one, of no interest at all.", "He took the work to the public library under the bridge."]


@pytest.fixture(scope="module")
def licence_model():
    return license_scan.train(PROSE * 20)


def test_licences(spark, licence_model):
    texts = ["Intro line.\nReleased under the MIT License.\nEnd.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "He lost his driving license.", None, "", "Nothing here.", "Released under the ISC License.", "GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in license_scan.scan(frame, licence_model).collect()}
    assert got == {(0, 1): ("MIT", True), (1, 0): ("Apache-2.0", True), (2, 0): ("GPL", True), (3, 0): ("CC-BY-NC", True), (8, 0): ("unknown", False), (9, 0): ("GPL", True), (10, 1): ("MIT", True)}


def test_a_wrapped_licence_is_one_paragraph(spark, licence_model):
    grant = license_scan.NOTICES["MIT"][2]
    text = "A title\n\n" + textwrap.fill(grant, 60) + "\n \n" + textwrap.fill(license_scan.NOTICES["Apache-2.0"][3], 40) + "\nThe end."
    rows = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licence_model).collect()
    assert sorted((r.paragraph, r.family, r.n_words) for r in rows)[0] == (1, "MIT", len(license_scan.tokens(grant))) and {r.family for r in rows} == {"MIT", "Apache-2.0"}


def licences_by_hand(rows, model):
    out = []
    for doc_id, text in rows:
        for k, p in enumerate(re.split(license_scan._PARAGRAPH_BREAK, text) if text is not None else []):
            words = license_scan.tokens(p)
            if found := license_scan.classify(words, model):
                out.append((doc_id, k, found[0], pytest.approx(found[1], abs=1e-5), pytest.approx(found[2], abs=1e-5), len(words)))
    return out


def test_licences_against_plain_python(spark, licence_model):
    rng = random.Random(9)
    notices = [t for texts in license_scan.NOTICES.values() for t in texts]

    def text():
        parts = [license_scan._variation(rng.choice(notices).split(), rng, ["weather", "bridge", "Tree.", "x", "9"]) if rng.random() < 0.5 else rng.choice(PROSE).split() for _ in range(rng.randint(1, 5))]
        return rng.choice(["\n", ".\n", "\n\n"]).join(" ".join(p) for p in parts)

    rows = [(i, text()) for i in range(150)] + [(200, None), (201, ""), (202, "\n\n"), (203, " ".join(["plain words of no licence"] * 5000) + " Released under the MIT License."), (None, "Released under the MIT License.")]
    rows += rows[:3]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, family string")
    key = lambda r: (r[0] is None, r[0], r[1], r[2])
    got = sorted((tuple(r[c] for c in ("doc_id", "paragraph", "family", "probability", "similarity", "n_words")) for r in license_scan.scan(frame, licence_model).collect()), key=key)
    assert got == sorted(licences_by_hand(rows, licence_model), key=key) and len(got) > 150


def test_names_of_families_held_out(licence_model):
    """Of families the model never saw few are given a name; of those it saw, most the right one and hardly any a wrong one."""
    trials = license_scan.held_out_families([license_scan.tokens(p) for p in PROSE], seed=50)
    named = lambda t: t[1] in license_scan.FAMILIES and t[2] >= licence_model.least and t[3] >= licence_model.near
    strange, known = ([t for t in trials if (t[0] == license_scan.UNKNOWN) == s] for s in (True, False))
    assert sum(map(named, strange)) < 0.1 * len(strange)
    assert sum(named(t) and t[1] == t[0] for t in known) > 0.6 * len(known) and sum(named(t) and t[1] != t[0] for t in known) < 0.02 * len(known)


def test_licence_query_learns_from_the_corpus(spark):
    rows = [(i, f"{PROSE[i % 3]}\nLine {i} goes on.") for i in range(40)] + [(99, "Licensed under the Apache License, Version 2.0."), (100, None)]
    got = license_scan.op1(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.family) for r in got] == [(99, "Apache-2.0")]
    assert license_scan.op1(docs(spark, [])).count() == 0


def test_url_filter_against_brute_force(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [("a.example", day(10), "add", "x"), ("a.example", day(20), "remove", "x"), ("a.example", day(30), "add", "y"), ("EXAMPLE.org", day(5), "add", "z"), ("b.example.org", day(7), "add", "w"), ("b.example.org", day(7), "remove", "w"), (None, day(1), "add", "x"), ("c.example", None, "add", "x"), ("c.example", day(1), "keep", "x")]
    urls = ["http://a.example/p", "https://u:p@SUB.a.example:80/?q", "http://b.example.org.", "http://c.example/", "nonsense", None, "http://xa.example"]
    captures = [(u, day(n) if n >= 0 else None, "old") for u in urls for n in (-1, 4, 7, 10, 19, 20, 31)]
    frame = spark.createDataFrame(captures, "url string, fetched date, blocked string")
    listed = spark.createDataFrame(entries, "key string, entry_date date, action string, category string")

    def expected(url, at):
        host = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]+)", (url or "").lower())
        host = host[1].rstrip(".") if host else ""
        hit = set()
        for k in {k.lower() for k, *_ in entries if k}:
            if at and (host == k or host.endswith("." + k)):
                own = [e for e in sorted((d, a, c) for key, d, a, c in entries if key and key.lower() == k and d and a in ("add", "remove")) if e[0] <= at]
                if own and own[-1][1] == "add":
                    hit.add(own[-1][2])
        return bool(hit), len(hit), min(hit, default=None)

    want = sorted(((u or "", str(a)), expected(u, a)) for u, a, _ in captures)
    for limit in (url_filter.BROADCAST_ROWS, 0):
        url_filter.BROADCAST_ROWS, kept = limit, url_filter.BROADCAST_ROWS
        got = url_filter.evaluate(frame, listed).collect()
        url_filter.BROADCAST_ROWS = kept
        assert sorted(((r.url or "", str(r.fetched)), (r.blocked, r.n_matches, r.category)) for r in got) == want


def test_jaccard_odd_rows(spark):
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(70_000))
    same = " ".join(f"v{k}" for k in range(40))
    rows = [(5, long), (6, long + " end"), (7, same), (None, same), (7, same), (7, "another text of the same id here"), (8, None), (9, ""), (None, None), (10, same.upper()), (None, "lone text of a row without id")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component_id string, node int").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op4(frame).collect()), key=str)
    assert got == sorted([(5, 69_996, 5), (6, 69_997, 5), (7, 36, 7), (None, 36, 7), (7, 36, 7), (7, 3, 7), (8, 0, 8), (9, 0, 9), (None, 0, None), (10, 36, 7), (None, 3, None)], key=str)
    kept = jaccard_join.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(((r.doc_id, (r.text or "")[:12]) for r in kept.collect()), key=str) == sorted([(5, long[:12]), (7, same[:12]), (7, "another text"), (8, ""), (9, ""), (None, ""), (None, "lone text of")], key=str)
    assert jaccard_join.op4(frame.limit(0)).count() == 0 and jaccard_join.deduplicate(frame.limit(0)).count() == 0


def test_copies_over_many_partitions_against_brute_force(spark, monkeypatch):
    """Every row of a set of queries (ids divisible by 50) against all rows: no link is missed, wherever copies lie."""
    rng = random.Random(21)
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.randint(20, 90))] for _ in range(30)]
    rows = []
    for i in range(400):
        words = base[min(int(rng.expovariate(0.4)), 29)].copy()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    want = brute_components(rows)
    for parts, least in ((2, 20), (7, 2)):  # the second time any shingle met twice counts as frequent
        monkeypatch.setattr(jaccard_join, "LEAST_COUNT", least)
        frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        got = sorted(tuple(r) for r in jaccard_join.join(frame).collect())
        assert [r for r in got if r[0] % 50 == 0] == [r for r in want if r[0] % 50 == 0] and got == want


def test_url_filter_odd_rows(spark):
    entries = spark.createDataFrame([("a.example", dt.date(2024, 1, 1), "add", "x")] * 2 + [("a.example", dt.date(2024, 1, 1), "add", None)], "key string, entry_date date, action string, category string")
    captures = spark.createDataFrame([("http://a.example/" + "p" * 100_000, dt.date(2024, 2, 1), 3, "old"), ("http://a.example/", dt.date(2024, 2, 1), 1, "old"), ("http://a.example/", dt.date(2024, 2, 1), 1, "old"), (None, None, None, None)], "url string, fetched date, _host int, n_matches string")
    got = url_filter.evaluate(captures, entries)
    assert got.columns == ["url", "fetched", "_host", "blocked", "n_matches", "category"]
    assert sorted((r._host or 0, r.blocked, r.n_matches, r.category) for r in got.collect()) == [(0, False, 0, None), (1, True, 1, "x"), (1, True, 1, "x"), (3, True, 1, "x")]
    assert url_filter.evaluate(captures, entries.limit(0)).filter("blocked").count() == 0 and url_filter.evaluate(captures.limit(0), entries).count() == 0
