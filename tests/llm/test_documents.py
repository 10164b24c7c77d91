"""Operators over documents, against brute force, on small and awkward tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import audio, components, decontaminate, jaccard, packing, pii, quality, sharding, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, row string, sid long, clean boolean"


def make(spark, rows):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "b", "r", 1, False) for i, t in rows], SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (6, "word " * 30_000), (7, "é😀 日本 <|endoftext|> it's 4111 1111 1111 1111"), (8, "a b c d e f g h i j k l"), (9, "A B C D E F G H I J K L m")]


@pytest.fixture(scope="module")
def awkward(spark):
    return make(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


# --- words -----------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_patterns():
    import re

    texts = ["Ab c1-d", "", "é ÉA  x y", "a_b;c\x0bd", "日本 語", "z"]
    data, offsets = words.utf8(pa.array([*texts, None]))
    for member, pattern in ((words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words.NONSPACE, r"[^\x20\x09-\x0D]+")):
        starts, ends, first = words.spans(data, offsets, member)
        got = [words.lowered(data[a:b]).tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
        want = [re.findall(pattern, low(t)) for t in texts] + [[]]
        assert got == [w for ws in want for w in ws] and np.diff(first).tolist() == [len(w) for w in want]
        h = words.hashes(data, starts, ends)
        assert len(set(h.tolist())) == len(set(got))


# --- personal data -----------------------------------------------------------------------------------------------


PERSONAL = [
    "a@b.c_d@e.f x@y.z. 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.3.00255",
    "é" * 5 + "a@b.co 4111 1111 1111 1111 and +1 (499) 555-6503 4111-1111-1111-11111",
    "a@b" + ".c" * 20_000,
    "1" * 20_000,
    "1-" * 10_000 + "1",
    "IBAN: DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE89370400440532013001",
    "my ssn: 123-45-6789 123-45-6789; ssn 000-12-3456 isbn 123-45-6789",
    "+" * 20 + "1234567890123 +12 34567890 +(1) +1234567890123456",
    "version 1.2.3.4 server 10.0.0.1 call +49 30 1234567",
    "%%@x.y a.@b.c -@-.- @a.b a@.b",
    "😀a@b.co😀 4242424242424242😀",
    "",
    None,
]


def test_pii_against_plain_patterns(spark):
    rows = pii.find(spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string"))
    for r in rows.collect():
        want = pii.brute_force(PERSONAL[r["doc_id"]])
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) == want[5], r["doc_id"]
        for s in r["spans"]:
            assert 0 <= s["score"] <= 1
    scores = {r["doc_id"]: [s["score"] for s in r["spans"]] for r in rows.collect()}
    assert scores[8][:2] == [0.4, 0.9]


ACCOUNTS = [
    ("IBAN ES91 2100 0418 4502 0005 1332 BIC CAIXESBB", "IBAN [IBAN] BIC CAIXESBB"),
    ("AT61 1904 3002 3457 3201 SWIFT", "[IBAN] SWIFT"),
    ("pay PL61 1090 1014 0000 0712 1981 2874 Madrid, SE45 5000 0000 0583 9825 7466 X", "pay [IBAN] Madrid, [IBAN] X"),
    ("ES9121000418450200051332 DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 ok", "[IBAN] [IBAN] [IBAN] ok"),
    ("REF AB12 ES91 2100 0418 4502 0005 1332", "REF AB12 [IBAN]"),
    ("NO93 8601 1117 947 BIC MT84MALT011000012345MTLCAST001S", "[IBAN] BIC [IBAN]"),
    ("ES91 2100 0418 4502 0005 1333 BIC", "ES91 2100 0418 4502 0005 1333 BIC"),
    ("SSN: 123-45-6789, 234-56-7890", "SSN: [SSN], [SSN]"),
    ("SSN: 123-45-6789 and forty more characters go by here, then 234-56-7890", "SSN: [SSN] and forty more characters go by here, then 234-56-7890"),
]


def test_accounts_and_numbers_are_found_whole(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ACCOUNTS)], "doc_id long, text string")
    for r in pii.find(df).collect():
        text = ACCOUNTS[r["doc_id"]][0]
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) == pii.brute_force(text)[5], text
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == [t for _, t in ACCOUNTS]


def test_pii_is_native_and_takes_awkward_rows(spark, awkward, empty):
    found = pii.find(awkward)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.count() == len(AWKWARD) and pii.find(empty).count() == 0
    red = pii.redact(awkward)
    assert red.columns == awkward.columns and "Python" not in red._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in red.collect()}
    assert got[7]["text"].endswith("it's [CARD]") and got[7]["n_chars"] == len(got[7]["text"])
    assert got[1]["text"] is None and got[1]["n_chars"] is None and got[6]["text"] == "word " * 30_000 and got[8]["row"] == "r"


def test_redaction_leaves_no_base_span(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.redact(df).collect():
        assert r["text"] is None or pii.brute_force(r["text"])[:4] == (0, 0, 0, 0), r


# --- quality ------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("held_out", "quality", "predicted", "score").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 500 and sum(r["quality"] == r["predicted"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    # calibrated: among scores near one, nearly all are good
    high = [r["quality"] for r in out if r["score"] > 0.95]
    assert sum(high) / len(high) > 0.95


def test_quality_folds_and_inputs(spark, awkward):
    rows = quality.scored(awkward, quality.Model(*[np.zeros(0)] * 6, np.array([0.5]), trained=False)).collect()
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["score"] == 0.5 and r["predicted"] == 0
    same = [quality.statistics(pa.array(["x y z", None, "x y z"]))[k].tolist() for k in (0, 1, 2)]
    assert same[0] == same[2] and same[1] == [0.0] * len(quality.STATISTICS)


def test_quality_without_use_of_labels(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert not quality.fit(awkward, labels).trained
        assert quality.keep_good(awkward, labels).count() == len(AWKWARD)
    assert quality.scored(empty, quality.fit(empty, none)).count() == 0


def test_quality_keeps_all_columns(spark):
    good = ["the cat and the dog went out to see the house by the river", "it was a long day and we had to walk home in the rain"]
    bad = ["*** $$$ ### ***", "spam spam spam spam spam spam spam"]
    rows = [(i, (good if i % 2 else bad)[i // 2 % 2] + f" {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = make(spark, [*rows, *AWKWARD])
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len({i for i, _ in rows if i % 2} - ids) == 0 and not {i for i, _ in rows if i % 2 == 0 and i > 9} & ids


def test_fit_is_the_plain_ridge_fit(spark):
    """Weights and scores against one numpy fit over all labelled rows at once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    marks = {r["doc_id"]: float(r["quality"] > 0) for r in labels.where("quality IS NOT NULL").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] in marks]
    x, y = quality.statistics(pa.array([t for _, t in texts])), np.array([marks[i] for i, _ in texts])
    centre, scale = x.mean(0), np.sqrt(np.maximum(1e-6, (x * x).mean(0) - x.mean(0) ** 2))
    rng = np.random.default_rng(quality.SEED)
    frequency, phase = rng.normal(size=(x.shape[1], quality.FEATURES)) / (2 * np.sqrt(x.shape[1])), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.cos(np.clip((x - centre) / scale, -8, 8) @ frequency + phase) * np.sqrt(2 / quality.FEATURES), np.ones((len(x), 1))])
    weight = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y)
    raw = lambda m: z @ m
    np.testing.assert_allclose(raw(model.weight), raw(weight), atol=1e-5)
    got = model.score(x)
    # calibration keeps the order of the plain scores, and stands near the labels
    order = np.argsort(raw(weight))
    assert (np.diff(got[order]) >= -1e-3).all() and abs(got.mean() - y.mean()) < 0.05 and ((got >= quality.CUTOFF) == (y > 0)).mean() > 0.95


def test_isotonic():
    got = quality.isotonic(np.arange(6), np.array([0, 1, 0, 2, 1, 3.0]), np.array([1, 1, 1, 2, 1, 3]))
    np.testing.assert_allclose(got, [0, 0.5, 0.5, 1, 1, 1])
    assert (np.diff(got) >= 0).all()


# --- audio ----------------------------------------------------------------------------------------------------------


def test_audio_round_trip(spark, awkward, empty):
    texts = dict((i, t) for i, t in AWKWARD)
    rows = audio.audio_features(audio.store(awkward)).collect()
    assert len(rows) == len(AWKWARD) and audio.audio_features(audio.store(empty)).count() == 0
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        table = pa.ipc.open_stream(io.BytesIO(r["tensor"])).read_all()
        kind = table.schema.field("log_mel").type
        assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.TENSOR_FRAMES, audio.MELS]
        assert table["start_ms"][0].as_py() == 0 and all(a.as_py() < b.as_py() for a, b in zip(table["start_ms"], table["end_ms"], strict=True))
        assert table.num_rows == -(-r["n_frames"] // audio.TENSOR_FRAMES)
    twice = [r for r in rows if r["doc_id"] == 5]
    assert twice[0] == twice[1] and twice[0]["feature"] == next(r for r in rows if r["doc_id"] == 4)["feature"]


def test_stored_clip_is_a_wav(spark):
    import wave

    r = audio.store(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    with wave.open(io.BytesIO(bytes(r["media"]))) as w:
        assert (w.getnframes(), w.getframerate(), w.getsampwidth()) == (64, audio.RATE, 1)
        assert w.readframes(3) == b"abc"


@pytest.mark.parametrize("up, down", [(1, 2), (2, 3), (3, 2), (1, 1), (5, 4)])
def test_resample_is_the_full_convolution(up, down):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 501):
        x = rng.normal(size=n)
        h = audio.low_pass(up, down)
        wide = np.zeros(n * up)
        wide[::up] = x
        np.testing.assert_allclose(audio.resample(x, up, down), np.convolve(wide, h)[len(h) // 2 :][: len(wide)][::down], atol=1e-12)


def plain_feature(text):
    """The feature of a text by sums over single samples, frames and bins."""
    raw = text.encode()
    raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    x = np.array([(b - 128) / 128 for b in raw])
    t = np.arange(-24, 25) / 2
    h = np.sinc(t) * np.hamming(49)
    h /= h.sum()
    y = [sum(h[24 - k] * x[2 * m + k] for k in range(-24, 25) if 0 <= 2 * m + k < len(x)) for m in range(len(x) // 2)]
    y += [0] * (200 - len(y))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(40), mel(4000), 22)]
    rows = []
    for at in range(0, len(y) - 199, 80):
        w = [y[at + i] * (0.5 - 0.5 * np.cos(2 * np.pi * i / 200)) for i in range(200)]
        power = [abs(sum(w[i] * np.exp(-2j * np.pi * k * i / 256) for i in range(200))) ** 2 for k in range(129)]
        band = lambda j: sum(p * max(0, min((f - edge[j]) / (edge[j + 1] - edge[j]), (edge[j + 2] - f) / (edge[j + 2] - edge[j + 1]))) for p, f in zip(power, np.arange(129) * 31.25, strict=True))
        rows.append([np.log(band(j) + 1e-6) for j in range(20)])
    mels = np.array(rows)
    energy = mels.mean(1)
    on, cuts, start = False, [], 0
    for i, e in enumerate([*energy, -np.inf]):
        level = (e - energy.min()) / max(energy.max() - energy.min(), 1e-12)
        if not on and level >= 0.6:
            on, start = True, i
        elif on and level < 0.4:
            on = False
            cuts.append((start, i))
    if energy.max() - energy.min() < 1e-9:
        cuts = []
    return mels, f"frames={len(mels)};segments={len(cuts)};active={sum(b - a for a, b in cuts)};mean=" + ",".join(f"{v:.2f}" for v in mels.mean(0)) + ";std=" + ",".join(f"{v:.2f}" for v in mels.std(0))


def test_features_against_plain_sums(spark, monkeypatch):
    texts = ["", "short", "The quick brown fox. " * 30, "aaaa zzzz é😀 " * 40]
    for at_once in (1, 3, 1024):
        monkeypatch.setattr(audio, "FRAMES_AT_ONCE", at_once)
        for text in texts:
            raw = text.encode()
            samples = np.frombuffer(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), np.uint8)
            np.testing.assert_allclose(audio.clip_mels(samples, 16_000)[0], plain_feature(text)[0], atol=1e-8)
    rows = audio.audio_features(audio.store(make(spark, list(enumerate(texts))))).collect()
    assert {r["doc_id"]: r["feature"] for r in rows} == {i: plain_feature(t)[1] for i, t in enumerate(texts)}


def test_long_clips_take_bounded_memory():
    import tracemalloc

    samples = np.random.default_rng(1).integers(32, 127, 4_000_000).astype(np.uint8)
    tracemalloc.start()
    audio.clip_mels(samples, 16_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 + 4 * len(samples)


def test_segments_open_and_close():
    e = np.array([0, 0.5, 0.7, 0.5, 0.45, 0.3, 0.5, 1.0, 0.41])
    assert audio.segments(e) == [(2, 5), (7, 9)]
    assert audio.segments(np.ones(5)) == []
    tone = np.sin(np.arange(8000) * 2 * np.pi * 1000 / 8000)
    loudest = audio.log_mels(tone, 8000).mean(0).argmax()
    assert audio.mel_bank(8000)[loudest, 32] > 0


# --- decontamination ---------------------------------------------------------------------------------------------


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def longest_common(text, items):
    """Words of the longest run that a text and any item share, by comparing all places."""
    words, best = plain_words(text), 0
    for _, item in items:
        above = [0] * (len(words) + 1)
        for w in plain_words(item):
            above = [0, *(above[k] + 1 if words[k] == w else 0 for k in range(len(words)))]
            best = max(best, *above)
    return best


def test_suffixes_are_in_order():
    rng = np.random.default_rng(8)
    for n, bits in ((0, 2), (1, 2), (60, 2), (300, 3), (300, 20)):
        ids = np.append(rng.integers(0, min(1 << bits, 5), n), 0)
        line = decontaminate.Line(ids, bits, 63 // bits if bits > 8 else 2)
        whole = lambda p: ids[p : p + line.left[p]].tolist()
        got = line.suffixes(n + 1)
        assert sorted(got.tolist()) == np.flatnonzero(ids).tolist()
        assert [whole(p) for p in got] == sorted(whole(p) for p in got)


def test_large_benchmarks_stay_small_in_memory():
    import pickle
    import tracemalloc

    rng = np.random.default_rng(2)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 60_000, 100)).encode()) for i in range(2000)]
    tracemalloc.start()
    index = decontaminate.TestIndex(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a tenth of a block's words
    assert len(index.order) == 200_000 and peak < 150e6 and len(pickle.dumps(index, 5)) < 30e6
    text = b"q " + items[7][1][20:300]
    found = decontaminate.scan_shard(index, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    assert found["items"] == {"7"} and found["n_hit"] >= 30


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["aa", "B", "c1", "é", "dd", "e"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25])) if i else None) for i in range(12)] + [(12, ""), (13, "zz"), (14, "q " * 40)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    docs += [(100 + i, f"new {t} words") for i, t in items] + [(200, None), (201, "q " * 100)]
    docs += [(300, docs[5][1]), (300, docs[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (60, 12 << 20):
        for r in decontaminate.match_report(make(spark, docs), benchmark, block_bytes=block_bytes).collect():
            want = decontaminate.brute_force(dict(docs)[r["doc_id"]], items)
            got = (r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest())
            assert got == want, (r["doc_id"], block_bytes)
            longest, best = longest_common(dict(docs)[r["doc_id"]], items), r["longest"]
            assert longest == (best["length"] if best else 0)
            if best:
                own, other = (plain_words(x)[y : y + longest] for x, y in ((dict(docs)[r["doc_id"]], best["word_start"]), (dict(items)[int(best["item_id"])], best["item_word_start"])))
                assert own == other and len(own) == longest


def test_longest_matches(spark):
    long = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(10, 20))
    r = decontaminate.match_report(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([("b", long)], "item_id string, text string")).first()
    assert [tuple(m) for m in r["matches"]] == [("b", 2, 5, 25), ("b", 28, 10, 10)]


def test_decontaminate_keeps_rows_as_they_are(spark, awkward, empty):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    clean = decontaminate.decontaminate(awkward, benchmark)
    assert clean.schema == awkward.schema
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in AWKWARD if i not in (8, 9))
    two = benchmark.unionByName(spark.createDataFrame([(2, "one")], "item_id long, text string"))
    by_block = decontaminate.decontaminate(awkward, two, block_bytes=1)
    assert sorted(str(r["doc_id"]) for r in by_block.collect()) == sorted(str(i) for i, _ in AWKWARD if i not in (4, 5, 8, 9))
    assert decontaminate.decontaminate(awkward, benchmark.limit(0)).count() == len(AWKWARD)
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = ["", "  a  b\n\n", "İstanbul ΑΣ Σ it's DON'T ½ x² ٣٤ 12345 é café <|endoftext|> a<|startoftext|>b\ttab ***... w,.x", "日本語 한국어 ǅ ﬁͅ 😀😀 ạ̀ o'clock's", "Ab,. ab.. |x| 'S", " x y"]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    flat, begin = packing.WordEncoder(path).encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want


#: Letters whose normal form or lower case can end in a mark, and everything of the basic plane's first third.
FUZZED = ["aB1 .,!'sİıIß", "éé́İ<|>endoftext .,", "ΣσςΑ .,", *("".join(map(chr, range(a, b))) + " .,!?;" for a, b in ((0x980, 0xA00), (0xA00, 0xA80), (0x900, 0x980), (0xF00, 0x1000), (0x590, 0x600), (0xFB00, 0xFB50), (0x21, 0x2FFF)))]


def test_encoder_equals_the_tokenizer_on_random_strings():
    rng, own = random.Random(5), packing.WordEncoder(packing.tokenizer_path())
    for alphabet in FUZZED:
        texts = ["".join(rng.choice(alphabet) if rng.random() < 0.7 else rng.choice(" .,aZ9İ|;") for _ in range(rng.randint(1, 14))) for _ in range(6000)]
        flat, begin = own.encode(pa.array(texts))
        want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == want
    for text in ("BELEDİYESİ. Ankara", "পাহাড়, নদী"):
        flat, _ = own.encode(pa.array([text]))
        assert flat.tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, pieces, capacity):
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted((str(p[0]), *p[1:]) for p in pieces)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, awkward, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = []
    for i, x in AWKWARD:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        pieces += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack_documents(awkward).collect()
    n = check_packed(rows, pieces, 2048)
    assert n == -(-sum(p[3] for p in pieces) // 2048)
    assert packing.pack_documents(empty).count() == 0


def test_packing_in_rounds(spark):
    rng = random.Random(5)
    pieces = [(i, 0, 0, rng.choice([rng.randrange(1, 100), rng.randrange(500, 1100)]), i) for i in range(3000)]
    df = spark.createDataFrame(pieces, packing.PIECES).repartition(16)
    n = check_packed(packing.pack(df, 1000 + 100, fan_in=40).collect(), pieces, 1100)
    best = -(-sum(p[3] for p in pieces) // 1100)
    one = len(set(packing.best_fit([p[3] for p in pieces], 1100)))
    assert best <= n <= one * 1.05 + 2
    alone = [(i, 0, 0, 700, 0) for i in range(200)]
    assert check_packed(packing.pack(spark.createDataFrame(alone, packing.PIECES), 1000, fan_in=10).collect(), alone, 1000) == 200


# --- sharding ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1, 1 << 24])
def test_sharding(spark, awkward, bucket_bytes):
    rows = sharding.shard(awkward, 3, bucket_bytes=bucket_bytes).collect()
    assert sorted(str(tuple(r["row"])) for r in rows) == sorted(str(tuple(r)) for r in awkward.collect())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {str(tuple(r["row"])): (r["shard"], r["slot"]) for r in sharding.shard(awkward, 3, bucket_bytes=bucket_bytes).collect() if r["row"]["doc_id"] != 5}
    assert again == {str(tuple(r["row"])): (r["shard"], r["slot"]) for r in rows if r["row"]["doc_id"] != 5}


def test_sharding_is_a_plain_scatter_and_shuffle(spark, monkeypatch):
    docs = make(spark, [(i, f"text {i}") for i in range(300)]).repartition(3).cache()
    rows = [(r["origin"], r["doc_id"], r["bucket"]) for r in docs.select(F.monotonically_increasing_id().alias("origin"), "doc_id").withColumn("bucket", F.pmod(F.xxhash64(F.lit(sharding.SEED), "origin"), F.lit(32))).collect()]
    order = []
    for b in range(32):
        own = sorted((o, i) for o, i, k in rows if k == b)
        np.random.default_rng((sharding.SEED, b)).shuffle(own)
        order += [i for _, i in own]
    edge = [s * 300 // 8 for s in range(9)]
    want = {order[at]: (s, at - edge[s]) for s in range(8) for at in range(edge[s], edge[s + 1])}
    for limit in (10**6, 0):
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(sharding, "GROUP", 5)
        assert {r["row"]["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs).collect()} == want


def test_sharding_edges(spark, empty):
    assert sharding.shard(empty).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(make(spark, [(1, "a"), (2, None)]), 8).collect()) == [(3, 0), (7, 0)]
    order = [sharding.fisher_yates(4, (k,)).tolist() for k in range(2000)]
    first = np.bincount([o[0] for o in order], minlength=4)
    assert (np.abs(first - 500) < 120).all()


# --- near copies ---------------------------------------------------------------------------------------------------


def near_copies(seed, families, size, length, change, common=()):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for f in range(families):
        base = [word() for _ in range(length)]
        for _ in range(size):
            t = [word() if rng.random() < change else w for w in base]
            rows.append(" ".join([*t, *common]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_against_all_pairs(spark):
    passage = [f"p{i}" for i in range(12)]
    rows = near_copies(1, 6, 12, 60, 0.02, passage) + [(1000 + i, t) for i, t in near_copies(2, 1, 60, 40, 0.015)]
    rows += [(2000 + i, "a b c d e f g") for i in range(5)] + [(2100, "A  b\nc d e f g"), (2200, "a b"), (2201, "b a"), (2202, "a b")]
    rows += [(3000 + i, " ".join(passage + [f"x{i}"])) for i in range(40)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n")]
    want = jaccard.brute_force(rows)
    for block in (3, 512):
        jaccard.BLOCK = block
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(make(spark, rows)).collect()}
        assert got == want
    jaccard.BLOCK = 512


def test_jaccard_over_the_shuffled_paths(spark, monkeypatch):
    rows = near_copies(7, 5, 10, 50, 0.02)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "WINDOW_SHINGLES", 50)
    monkeypatch.setattr(jaccard, "MOST_FREQUENT", 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(make(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)


@pytest.mark.parametrize("threshold", [50, 75, 90])
def test_jaccard_thresholds(spark, threshold):
    rows = near_copies(11, 4, 8, 30, 0.03)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(make(spark, rows), threshold=threshold).collect()}
    assert got == jaccard.brute_force(rows, threshold=threshold)


def test_exact_threshold_links():
    assert jaccard.reaches(3, 3, 4) and not jaccard.reaches(2, 3, 3)
    for n in range(1, 400):
        least = next(s for s in range(n + 1) if 100 * s >= 75 * n)
        assert jaccard.leading(n) == n - least + min(jaccard.SHARED, least)


def test_linked_sets_share_leading_shingles():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**62, int(rng.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            ranks = rng.integers(0, 3, 1 << jaccard.SLOT_BITS).astype(np.uint8)
            x, y = (jaccard.in_order(s, ranks, jaccard.leading(len(s)))[0] for s in (a, b))
            least = [-(-75 * len(s) // 100) for s in (a, b)]
            assert len(np.intersect1d(x, y)) >= min(jaccard.SHARED, *least)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    base = rng.poisson(2, (40, jaccard.GROUPS))
    point = (base[rng.integers(0, 40, 300)] + rng.poisson(0.05, (300, jaccard.GROUPS))).astype(np.int32)
    size = point.sum(1)
    node = np.sort(rng.integers(0, 9, 300))
    node[40:200] = 3
    node.sort()
    forest = jaccard.Forest(node, point, size)
    heads, of = np.unique(node, return_inverse=True)
    rows = np.arange(0, 300, 7)
    q, r = forest.search(of[rows], point[rows], size[rows], 75)
    got = sorted(zip(rows[q].tolist(), r.tolist(), strict=True))
    want = [(k, i) for k in rows.tolist() for i in range(300) if node[i] == node[k] and jaccard.reaches(np.minimum(point[i], point[k]).sum(), size[i], size[k])]
    assert got == want and len(forest.levels) == 2 + (max(np.bincount(node)) > 256)


def short_documents(n):
    """Documents of seven words that share one shingle, some with a near copy."""
    rows = [(i, f"s1 s2 s3 s4 s5 x{i} y{i}") for i in range(n)]
    return rows + [(n + i, f"s1 s2 s3 s4 s5 x{i} y{i} z{i}") for i in range(0, n, 1000)]


def test_jaccard_of_a_large_group_verifies_few_pairs(spark, monkeypatch):
    """Members of one group link with a part of each other; what is compared does not grow with the square of their number."""
    rng = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in rng.integers(0, 2000, 150)], []
    for i in range(300):
        edited = set(np.flatnonzero(rng.random(150) < 0.015).tolist())
        rows.append((i, " ".join(f"e{i}x{k}" if k in edited else w for k, w in enumerate(base))))
    asked = []
    own = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: own(asked.append(jaccard.cut(pairs)) or asked[-1], *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(make(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)
    assert sum(p.count() for p in asked) < 10 * len(rows)


def test_jaccard_hashes_texts_of_meetings_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    own = jaccard._sets

    def counted(batches, *a):
        for x in own(batches, *a):
            read.add(len(x[2]))
            yield x

    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(30)) + f" {i}") for i in range(40)]
    ranks = np.full(1 << jaccard.SLOT_BITS, jaccard.CROWDED, np.uint8)
    ranks[: len(ranks) // 2] = 0
    monkeypatch.setattr(jaccard, "_sets", counted)
    assert jaccard.cut(jaccard.companions(jaccard.meetings(make(spark, rows), ranks))).count() > 0
    assert read.value == len(rows)


def test_jaccard_of_many_short_documents_with_a_shingle(spark):
    rows = short_documents(20_000)
    docs = make(spark, rows)
    met = jaccard.meetings(docs, np.zeros(1 << jaccard.SLOT_BITS, np.uint8))
    members = jaccard.cut(jaccard.companions(met))
    nodes = members.select(F.col("pivot").alias("key"), "sid").distinct()
    # one node holds all sets; below it, no set is copied for other sets
    assert jaccard.probe_rows(members, nodes, None, 75).count() < 4 * len(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: i - 20_000 if i >= 20_000 else i for i, _ in rows}


def test_links_come_through_the_trees(spark, monkeypatch):
    rows = near_copies(7, 5, 10, 50, 0.02)
    asked = []
    own = jaccard.searched
    monkeypatch.setattr(jaccard, "searched", lambda *a: asked.append(jaccard.cut(own(*a))) or asked[-1])
    label = jaccard.jaccard_components(make(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in label} == {i: c for i, (_, c) in jaccard.brute_force(rows).items()}
    pairs = [x.count() for x in asked]
    assert pairs[0] > 0 and sum(pairs) < 50 * 49 / 4
    # no tree, no link
    monkeypatch.setattr(jaccard, "searched", lambda *a: own(*a).limit(0))
    alone = jaccard.jaccard_components(make(spark, rows)).collect()
    assert len({r["component_id"] for r in alone}) == len({r["set_id"] for r in alone}) > 30


def test_points_bound_overlap():
    rng = np.random.default_rng(4)
    for n, m in ((10, 2000), (900, 1100), (5000, 5000), (20_000, 17_000)):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, m, dtype=np.int64).astype(np.uint64)]))
        p, q = (jaccard.unpacked([jaccard.packed(jaccard.points(x))])[0].astype(int) for x in (a, b))
        assert len(np.intersect1d(a, b)) <= np.minimum(p, q).sum() <= min(len(a), len(b))
        p, q = (jaccard.packed(jaccard.points(x, jaccard.groups(len(x)))) for x in (a, b))
        assert len(np.intersect1d(a, b)) <= jaccard.most_shared(p, len(a), q, len(b)) <= min(len(a), len(b))


def test_jaccard_of_long_documents(spark):
    rows = near_copies(5, 2, 4, 1500, 0.002, [f"p{i}" for i in range(900)]) + [(100 + i, t) for i, t in near_copies(6, 3, 1, 5000, 0)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(make(spark, rows)).collect()}
    assert got == jaccard.brute_force(rows)


def test_one_of_each(spark, awkward, empty):
    kept = jaccard.one_of_each(awkward)
    assert kept.schema == awkward.schema
    want = {i for i, (_, c) in jaccard.brute_force([r for r in AWKWARD if r[0] is not None]).items() if i == c}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [*want, None]))
    assert jaccard.one_of_each(empty).count() == 0


def test_one_of_each_goes_by_texts_not_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (7, a + " more"), (7, b), (8, b), (7, c), (7, c), (None, c + " x"), (None, "d " + a), (None, "e f g h i j"), (None, "e f g h i j"), (9, None), (9, None), (9, ""), (None, ""), (None, None)]
    docs = make(spark, rows).repartition(3)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [x for x in got if x[1]] == sorted([(3, a), (7, b), (7, c), (None, "e f g h i j")], key=str)
    assert sorted(str(i) for i, t in got if not t) == ["9", "None", "None"]


def test_components_by_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    by_stars, by_one = ({r["vertex"]: r["component"] for r in components.components(df, one_task=n).collect()} for n in (0, 10**6))
    assert by_stars == by_one and by_one[130] == 100 and by_one[201] == 200
    assert components.components(df.limit(0)).count() == 0 and components.components(df.limit(0), one_task=-1).count() == 0
