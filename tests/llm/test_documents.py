"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from salesloom.llm import arrow, bpe, minhash, packing, quality, run_index, slots

WORDS = [f"{a}{b}" for a in "ka lo mi nu re sa to vu".split() for b in "ren tal mos dig pex".split()]


def _prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


BASE = _prose(1, 120)
PASSAGE = _prose(2, 60)
TEXTS = [
    (0, BASE),
    (1, BASE),  # an exact copy
    (2, BASE.replace(BASE.split()[60], "changed", 1)),  # a near copy
    (3, _prose(3, 40) + " " + PASSAGE + " " + _prose(4, 30)),
    (4, PASSAGE + "\n" + _prose(5, 80)),  # shares a passage, no near copy
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (8, "three little words"),
    (9, "three little words"),
    (10, "ab" * 700),  # repeats itself
    (11, "é" * 150 + _prose(6, 60)),
    (12, _prose(7, 30_000)),
    (13, "#$%| " * 80 + _prose(8, 60)),
    (None, _prose(9, 70)),
    (15, "one line\n" * 60 + _prose(10, 55)),
    (16, "# * $ % " * 30),
    (17, "a\x00b 漢字かな\u200b 12,345 don't  stop\r\n"),
]
ROWS = [(i, t, "en" if n % 2 else None, "web", len(t or "")) for n, (i, t) in enumerate(TEXTS)] + [(3, TEXTS[3][1], "en", "web", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "bytes", "row", "length", "shard", "slot", "grp", "n_words", "anchor", "band", "root", "_text", "sequence_id")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return frame.withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _raw(text):
    return (text or "").encode()


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec._ranks, special_tokens={}
    )


def test_bpe_is_the_librarys_and_decodes(docs, none, codec, library):
    got = bpe.decode(bpe.encode(docs, codec), codec).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), _raw(t)) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(none, codec).count() == 0


def test_bpe_on_odd_characters(codec, library):
    rnd = random.Random(5)
    points = [*range(0x20, 0x7F), 0x0A, 0x1C, 0x85, 0xA0, 0x3000, 0x558, 0x33318, 0x1F600, 0xAC00, 0xFFFF]
    for _ in range(500):
        text = "".join(chr(rnd.choice(points)) for _ in range(rnd.randrange(50)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), text
    assert codec._whole.get(b"\xff\xff no token") is None


def test_packing(docs, none):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = packing.pieces(docs, ranks, public_tokenizers.PATTERN)
    items = cut.withColumn("crc", F.crc32("ids")).persist()
    placed = packing.packed(items)
    rows = placed.collect()
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={}
    )
    want, tokens = Counter(), 0
    for i, t, *_ in ROWS:
        ids = [*encoding.encode_ordinary(t or ""), 0]
        tokens += len(ids)
        first = len(ids) % 2048 or 2048
        borders = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(borders, borders[1:])):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in rows) == want
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= -(-tokens // 2048) + 1
    whole = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(placed).collect()}
    assert whole == dict(ends)
    assert packing.packed(packing.pieces(none, ranks, public_tokenizers.PATTERN)).count() == 0


def test_ids_are_those_of_the_tokenizers_library(spark):
    """Texts that hold the end mark: at the start, at the end, twice, inside a word, broken, and after white space."""
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", f"{mark}x", f"x  {mark}", mark, mark * 3, f"in{mark}side", "<|endof text|>", f" \n {mark} \n ", f"<|{mark}|>", "don't", "", None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        added=packing.added_tokens(path),
    )
    library = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in cut.collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_plan_replaces_the_smallest_by_two():
    # greedy 6 + 3 leaves 1 of 10; 2 + 2 in the place of 3 fills it
    made = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert made.sequences == 2
    first = {made.length[k]: made.each[k] for k in range(len(made.length)) if made.base[k] == 0}
    assert first == {6: 1, 2: 2}
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_shards_are_even_and_gapless(spark, docs, none):
    rows = slots.shard(docs, 3, 64).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len(_raw(t)) + 8, zlib.crc32(_raw(t))) for i, t, *_ in ROWS
    )
    for shard in {r["shard"] for r in rows}:
        places = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert slots.shard(none, 3, 64).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    load = [r["b"] for r in slots.shard(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 24 and max(load) - min(load) <= 60


def test_a_new_shard_only_takes():
    load = {i: 10 + i % 7 for i in range(640)}
    even = slots.SlotMap.even(5, 640).rebalanced(load)
    more = even.grown(load)
    assert more.version == even.version + 1
    assert all(a == b or b == 5 for a, b in zip(even.owner, more.owner))
    held = Counter()
    for slot, shard in enumerate(more.owner):
        held[shard] += load[slot]
    assert abs(held[5] - sum(load.values()) / 6) < 20


def _counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_figures(docs, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = quality.judged(docs).collect()
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in rows) == Counter((i, *_counts(t)) for i, t, *_ in ROWS)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.judged(none).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rows = [(i, _prose(i, 80), "en", f"s{i % 2}", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in _prose(i, 80).split()), "en", "s0", 0) for i in range(40)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(40))


def test_quality_rejects_repeated_lines_and_words_alone(spark):
    """Outliers in one figure only, which pass the base rules; a little of the same is kept."""
    plain = lambda seed: [f"w{seed}x{n:03}" for n in range(120)]
    lines = lambda words, size: [" ".join(words[i : i + size]) for i in range(0, len(words), size)]
    rows = [(i, "\n".join(lines(plain(i), 6)), "en", "s", 0) for i in range(200)]
    for i in range(20):
        made = lines(plain(300 + i), 6)
        rows.append((1000 + i, "\n".join(made + ["----"] * 13), "en", "s", 0))  # 12 of 33 lines
        rows.append((2000 + i, " ".join(plain(400 + i) + plain(400 + i)[:35]), "en", "s", 0))  # 70 of 155 words
        rows.append((3000 + i, "\n".join(made + ["----"] * 2), "en", "s", 0))
    judged = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert not any(r["base_failed"] for r in judged)
    kept = {r["doc_id"]: r["kept"] for r in judged}
    assert all(k == (i < 1000 or i >= 3000) for i, k in kept.items())


def test_mcd_matches_numpy(spark):
    """The last concentration step, worked out again in numpy from the kept documents."""
    rows = [(i, _prose(i, 60 + i % 90), "en", "s", 0) for i in range(200)]
    figures = quality.figures(quality.counted(spark.createDataFrame(rows, SCHEMA))).select("grp", *quality.FIGURES).persist()
    shape = quality.estimates(figures).collect()[0]
    points = np.array([[r[f] for f in quality.FIGURES] for r in figures.collect()])
    low = np.array([[shape[f"l{max(i, j)}{min(i, j)}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    centre = np.array([shape[f"m{i}"] for i in range(4)])
    d = (np.linalg.solve(low, (points - centre).T) ** 2).sum(axis=0)
    near = points[np.argsort(d)[: int(0.75 * 200)]]
    assert np.allclose(near.mean(axis=0), centre, atol=0.02)
    covariance = np.cov(near.T, bias=True) * quality._CONSISTENCY + np.diag(np.square(quality.FLOORS))
    assert np.allclose(covariance, low @ low.T, atol=0.003)


def test_near_duplicates(docs, none):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    want = {i: i for i, *_ in ROWS} | {1: 0, 2: 0, 6: 5, 9: 8}
    assert classes == want
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.one_of_each(docs).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(set(want.values()))


def test_near_duplicates_follow_weighted_jaccard(spark):
    """A chain and a large group of copies, each with changes, against all pairs."""
    rnd = random.Random(4)
    texts = {}
    base = _prose(50, 150).split()
    for i in range(60):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(60, 100):
        texts[i] = _prose(i, 120)
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    df = minhash.frequencies(frame)
    assert df.documents == 100
    ids = list(texts)
    links = {limit: {i: i for i in ids} for limit in (0.8, 0.83)}

    def find(parent, i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        part = ids[n + 1 :]
        alike = minhash.similarities(pa.array([texts[a]] * len(part), pa.string()), pa.array([texts[b] for b in part], pa.string()), df)
        for b, s in zip(part, alike):
            for limit, parent in links.items():
                if s >= limit:
                    low, high = sorted((find(parent, a), find(parent, b)))
                    parent[high] = low
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame).collect()}
    true = {i: find(links[0.8], i) for i in ids}
    # nothing is joined that should not be, and no pair clear of the limit stays apart
    assert all(true[i] == true[c] for i, c in got.items())
    assert all(got[i] == got[find(links[0.83], i)] for i in ids)
    assert got == true


@pytest.mark.parametrize("cell", [minhash.CELL_ROWS, 40])
def test_near_duplicates_among_pages_of_a_template(spark, monkeypatch, cell):
    """One large bucket of texts just below the limit, each with one partner just above it: every pair is found, in one cell or many."""
    monkeypatch.setattr(minhash, "CELL_ROWS", cell)
    template, texts = _prose(70, 154), {}
    for i in range(150):
        for side in (0, 1):
            shared, own = (f"s{i}x{n}" for n in range(3)), (f"u{side}x{i}x{n}" for n in range(11))
            texts[2 * i + side] = " ".join([template, *shared, *own])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df = minhash.frequencies(frame)
    alike = lambda a, b: minhash.similarities(pa.array([texts[i] for i in a]), pa.array([texts[i] for i in b]), df)
    pairs, others = alike(range(0, 300, 2), range(1, 300, 2)), alike([0] * 298, range(2, 300))
    limit = float(pairs.min() + others.max()) / 2
    assert 0.75 < others.max() < limit < pairs.min()
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame, limit).collect()}
    assert got == {i: i // 2 * 2 for i in texts}


def test_one_of_each_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "k", 7), (2, "a b c", "l", 8), (3, None, "m", 9)], "doc_id long, text string, _key string, _id int")
    assert sorted(map(tuple, minhash.one_of_each(docs).collect())) == [(1, "a b c", "k", 7), (3, None, "m", 9)]


def test_samples_follow_the_weights_of_repeated_lines(spark):
    """A line repeated in long documents that otherwise differ: samples agree as often as the weights are shared."""
    line = " ".join(f"line{n}" for n in range(14))
    texts = [f"{line} " * 200 + " ".join(f"own{i}x{n}" for n in range(150)) for i in range(40)]
    texts += [f"{line} " * 200, _prose(71, 400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = minhash.frequencies(frame)
    found = minhash.shingles(pa.array(texts))
    bands, samples = minhash.signed(found, df.weights(found))
    marks = np.array([list(m) for m in samples])
    true = minhash.similarities(pa.array([texts[0]] * 40), pa.array(texts[1:41]), df)
    assert true.min() > 0.8
    agree = (marks[1:41] == marks[0]).mean(axis=1)
    assert abs(agree.mean() - true.mean()) < 0.06 and agree.min() >= minhash.LEAST_AGREEMENT
    assert all(set(bands[0]) & set(b) for b in bands[1:41])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame).collect()}
    assert got == {i: 0 if i < 41 else i for i in range(42)}


@pytest.mark.parametrize("words", [8, 60, 3000])
def test_samples_are_the_least_draws_of_all_shingles(monkeypatch, words):
    """Passing shingles over changes no sample, and texts agree in the share of weight they have in common."""
    rnd = random.Random(words)
    base = [f"w{n}" for n in range(words)]
    texts = []
    for _ in range(40):
        changed = list(base)
        for _ in range(max(1, words // 100)):
            changed[rnd.randrange(words)] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(changed))
    texts += ["", None, "one"]
    found = minhash.shingles(pa.array(texts))
    weights = found.times * (1 + 0.5 * (found.hash % np.uint64(1000)).astype(float) / 1000)
    weights[::7] *= 40
    got = minhash._samples(found, weights)
    monkeypatch.setattr(minhash, "_PASSED", 1e12)
    assert (got == minhash._samples(found, weights)).all()
    monkeypatch.setattr(minhash, "_PASSED", 0.1)
    assert (got == minhash._samples(found, weights)).all()
    vectors = [(found.hash[found.row == i], weights[found.row == i]) for i in range(40)]
    true = [minhash._alike(vectors[i], vectors[j]) for i in range(40) for j in range(i)]
    agree = [(got[i] == got[j]).mean() for i in range(40) for j in range(i)]
    assert abs(np.mean(true) - np.mean(agree)) < 0.08 and not got[40].any() and got[42].all()


def test_weighted_jaccard_by_hand(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d e f"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = minhash.frequencies(frame)
    idf = lambda n: 1 + minhash.IDF_SPAN * np.log(3 / n) / np.log(4)
    got = minhash.similarities(pa.array([texts[0]]), pa.array([texts[1]]), df)[0]
    assert got == pytest.approx(idf(3) / (idf(3) + idf(2) + idf(1)))


def _without_repeats(rows, length):
    places = Counter()
    for raw in rows:
        places.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if places[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def test_repeats_are_removed(docs, none):
    small = docs.where("doc_id IS NULL OR doc_id <> 12")
    raws = [(i, _raw(t)) for i, t, *_ in ROWS if i != 12]
    want = Counter(zip((i for i, _ in raws), _without_repeats([r for _, r in raws], 200)))
    rows = run_index.removed(small).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in rows) == want
    for r in rows:
        assert r["spans"] == sorted(r["spans"]) and len(set(r["spans"])) == len(r["spans"])
        assert r["text"] == bytes(r["kept"]).decode("utf-8", "ignore")
    assert run_index.removed(none).count() == 0


def test_regions_of_a_crowded_anchor_are_counted(spark):
    """A phrase in differing surroundings, some shared: no anchor over the bound is indexed in one task, nothing is lost."""
    phrase, raws = _prose(80, 24), []
    for i in range(60):
        before, after = _prose(1000 + i // 3, 40), _prose(2000 + i // 2, 40)
        raws.append(f"{before} {phrase} {after}".encode())
    frame = spark.createDataFrame([(i, r.decode()) for i, r in enumerate(raws)], "doc_id long, text string").repartition(3)
    rows = run_index._keyed(frame)
    found = run_index._occurrences(rows, run_index._bitmap(run_index._anchors(rows)))
    bound = 4000
    crowded = {r["anchor"] for r in run_index._crowded(found, bound).collect()}
    held = Counter()
    for r in found.collect():
        held[r["anchor"]] += len(r["bytes"])
    assert crowded == {a for a, n in held.items() if n > bound} and crowded
    got = {}
    for r in run_index.repeats(frame, bound).collect():
        got[bytes(r["key"])] = run_index._covered(r["stretches"])
    kept = []
    for raw in raws:
        ends = [0, *got.get(hashlib.md5(raw).digest(), []), len(raw)]
        kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2])))
    assert kept == _without_repeats(raws, 200) and kept != raws


def test_index_finds_every_repeat():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        letters = rnd.integers(0, rnd.integers(1, 4), 400, dtype=np.uint8)
        cuts = np.sort(rnd.choice(np.arange(1, 400), 5, replace=False))
        owner = np.searchsorted(cuts, np.arange(400), side="right")
        found = run_index.shared_with_neighbours(letters, owner, 12) >= 12
        ends = np.append(cuts, 400)[owner]
        strings = [letters[i : i + 12].tobytes() if i + 12 <= ends[i] else None for i in range(400)]
        times = Counter(s for s in strings if s)
        assert found.tolist() == [bool(s) and times[s] > 1 for s in strings]


def _lettered(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(seed)
    letters = rnd.integers(0, rnd.integers(1, 5), n, dtype=np.uint8) * np.uint8(60)
    return letters, np.unique(np.cumsum(rnd.random(n) < 0.03), return_inverse=True)[1]


def test_suffixes_are_sorted_as_plain_words(monkeypatch):
    """An indirect sort of a block takes several times as long; larger blocks than words have room for may need it."""
    plain = np.argsort
    for wide in (False, True):
        if wide:
            monkeypatch.setattr(run_index, "_place_bits", lambda bits: 0)
        for seed in range(40):
            letters, owner = _lettered(seed, 1 + 9 * seed)
            stop = np.cumsum(np.bincount(owner))[owner]
            want = sorted(range(len(letters)), key=lambda i: (letters[i : stop[i]].tobytes(), owner[i]))
            with monkeypatch.context() as patch:
                patch.setattr(np, "argsort", plain if wide else None)
                assert run_index.suffix_order(letters, owner).tolist() == want


def test_working_sets_are_small():
    """Arrays of a slice or a block are read many times over: they are to stay in a cache."""
    parts = [_prose(i, 50).encode()[:300] for i in range(run_index.INDEX_BYTES // 300)]
    texts = pa.RecordBatch.from_pydict({"text": [_prose(i, 400) for i in range(256)]})

    def peak(run) -> int:
        run()
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    slices = list(arrow.sized_slices([texts], "text", run_index.SLICE_BYTES))
    assert len(slices) > 1
    assert peak(lambda: [run_index.regions(*run_index._laid_out(s["text"])) for s in slices]) < 12 << 20
    assert peak(lambda: run_index.repeated_windows(parts, [1] * len(parts))) < 16 << 20


def test_anchors_do_not_depend_on_the_slice(monkeypatch):
    """Hashes that differ in few bits only, so that their order hangs on how many are looked at."""
    plain = run_index._mix
    monkeypatch.setattr(run_index, "_mix", lambda x: plain(x) >> np.uint64(44))
    text = np.frombuffer(_prose(5, 100).encode(), np.uint8)
    rest = np.frombuffer(_prose(6, 40000).encode(), np.uint8)
    anchor, _, first, windows = run_index.regions(text, np.array([0, len(text)]))
    within = run_index.regions(np.concatenate([text, rest]), np.array([0, len(text), len(text) + len(rest)]))
    here = within[1] == 0
    assert within[0][here].tolist() == anchor.tolist()
    assert within[2][here].tolist() == first.tolist() and within[3][here].tolist() == windows.tolist()


def test_equal_windows_choose_equal_anchors():
    text = np.frombuffer((_prose(1, 200) + PASSAGE * 3).encode(), np.uint8)
    data, borders = np.concatenate([text, text[100:900]]), np.array([0, len(text), len(text) + 800])
    anchor, number, first, windows = run_index.regions(data, borders)
    assert windows.sum() == len(text) - 199 + 601
    chosen = {}
    for a, f, w in zip(anchor.tolist(), first.tolist(), windows.tolist()):
        for i in range(f, f + w):
            assert chosen.setdefault(data[i : i + 200].tobytes(), a) == a


def test_pipeline(spark, docs, tmp_path):
    folder = str(tmp_path)
    prose = [(100 + i, _prose(100 + i, 90), "en", "web", 1) for i in range(30)]
    frame = spark.createDataFrame(ROWS + prose, SCHEMA)
    frame.write.parquet(f"{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, folder).collect()
    texts = {}
    stages = dict(corpus_pipeline.STAGES)
    good = {r["doc_id"] for r in quality.judged(frame).where("kept").collect()}
    once = minhash.one_of_each(frame.where(F.col("doc_id").isNull() | F.col("doc_id").isin([i for i in good if i is not None])))
    for r in run_index.removed(once).collect():
        if r["doc_id"] in good:
            texts[r["doc_id"]] = r["text"]
    assert {r["doc_id"] for r in packed} == set(texts)
    assert list(stages) == ["quality_rules", "near_dedup", "suffix_dedup", "pack"]
    assert 100 in texts and 6 not in texts and 1 not in texts
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_pipeline_gives_the_ids_of_its_sequences(spark, tmp_path):
    texts = {i: _prose(200 + i, 90) for i in range(20)}
    frame = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in texts.items()], SCHEMA)
    placed = dict(corpus_pipeline.STAGES)["pack"](spark, frame, str(tmp_path)).persist()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = placed.collect()
    for r in rows:
        ids = [*encoding.encode_ordinary(texts[r["doc_id"]]), 0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
    assert sum(len(r["ids"]) for r in packing.sequences(placed).collect()) == 4 * sum(r["length"] for r in rows)
