"""Hard negatives, the conversation trie and SentencePiece against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from salesloom.llm import hard_negatives, piece_bpe, prefix_trie

VECTORS = "vec_id long, embedding array<double>, label int, rank string, score string"


def plain_mining(rows, every=100, scale=256):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (vec_id, label if vec_id % 7 else (label + 1) % 10, tuple(int(x) * scale if abs(x) > 2**40 else math.floor(x * scale) for x in vector))
        if row not in kept:
            kept.append(row)
    limit = (1 << 63) - 1
    out = []
    for a, label, one in kept:
        if a % every:
            continue
        scored = [(max(-limit, min(limit, sum(x * y for x, y in zip(one, two)))), b, other) for b, other, two in kept if b != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, b, _ in [s for s in scored if s[2] == label][:5]:
            window = [s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(a, b, r + 1, n, p, s) for r, (s, n, _) in enumerate(window)]
    return sorted(out)


def mined(spark, rows):
    return sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))


def test_mining_equals_plain_search(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 64)  # several blocks, several parts of anchors
    monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 40)
    draw = random.Random(5)
    rows = []
    for i in range(400):
        near = draw.random() < 0.5
        vector = [(1.0 if near and d == i % 3 else 0.0) + draw.gauss(0, 0.3) for d in range(8)]
        rows.append((i * 10, vector, draw.randrange(3), "r", "s"))
    rows += [(5000 + i, rows[0][1], i % 2, "r", "s") for i in range(60)]  # one vector many times: ties
    assert mined(spark, rows) == plain_mining(rows)


def test_mining_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1, "r", "s"),
        (1, [1.0, 2.0], 2, "r", "s"),
        (1, [1.0, 2.0], 2, "r", "s"),  # a repeated row counts once
        (2, [1.0], 2, "r", "s"),  # shorter: zeros are put behind it
        (3, [0.0, 0.0], 2, "r", "s"),
        (4, [], 3, "r", "s"),
        (5, None, 2, "r", "s"),
        (6, [1.0, None], 2, "r", "s"),
        (8, [1.0, nan], 2, "r", "s"),
        (9, [inf, 1.0], 2, "r", "s"),
        (10, [1.0, 1.0], None, "r", "s"),
        (None, [1.0, 1.0], 2, "r", "s"),
        (100, [-1.0, -0.5], 2, "r", "s"),
        (11, [0.9, 2.0], 3, "r", "s"),
        (12, [-3.0, -3.0], -4, "r", "s"),
    ]
    assert mined(spark, rows) == plain_mining(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(0, [], 1, "", ""), (1, [], 1, "", ""), (2, [], 2, "", "")]) == plain_mining(
        [(0, [], 1), (1, [], 1), (2, [], 2)]
    )


def test_mining_of_huge_numbers(spark):
    rows = [(0, [1e7, 3e7], 1), (1, [1e7, 2.9e7], 1), (2, [1e7, 2.8e7], 2), (3, [1e300, 1e300], 2), (4, [-1e306, 5.0], 1), (100, [3e5, -2e5], 2)]
    rows = [(*r, "", "") for r in rows]
    assert mined(spark, rows) == plain_mining(rows)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        taken = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(math.fmod(conv, 100))
        new = tuple(own.get(base, [])[:taken] + turns[taken:])
        for depth in range(len(new) + 1):
            members[new[:depth]].append(conv)
        ended[new].append(conv)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        digest = hashlib.sha256(",".join(map(str, sorted(ended[node]))).encode()).hexdigest()
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), kids(node), sum(not kids(n) for n in under), saved, digest))
    return sorted(out, key=lambda r: r[:2])


CONVERSATIONS = "conv_id long, turn long, role string, text string, place string, size string, depth string"


def built(spark, rows, **bounds):
    frame = spark.createDataFrame([(*r, "p", "s", "d") for r in rows], CONVERSATIONS)
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(frame), **bounds).collect()), key=lambda r: r[:2])


def conversations():
    draw = random.Random(8)
    rows = []
    for conv in [*range(-8, 30), *range(100, 130), *range(215, 225)]:
        rows += [(conv, turn, draw.choice(["user", "bot"]), draw.choice(["a", "bé", ""])) for turn in range(draw.randint(1, 9))]
    rows += [(conv, turn, "user", f"long {turn}") for conv in (300, 301, 302) for turn in range(20 + conv % 2)]
    rows += [(400, None, None, None), (400, None, None, "x"), (400, 1, "user", "a"), (400, 1, "user", "a"), (None, 1, "user", "a")]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"stretch": 3, "box_bytes": 1}, {"stretch": 1, "box_bytes": 500}])
def test_trie_equals_plain_nodes(spark, bounds):
    assert built(spark, conversations(), **bounds) == plain_trie(conversations())


def test_trie_of_no_rows(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "a", "b")]) == []


def test_trie_of_copies_and_very_long_texts(spark):
    rows = [(conv, turn, "user", "x" * 100_000) for conv in range(100, 140) for turn in range(3)]
    assert built(spark, rows, box_bytes=100) == plain_trie(rows)


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_bpe.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(codec):
    draw, known = random.Random(4), list(codec._known.ids)
    texts = ["", " ", "  a  b ", "\n", "a\tb", "ﬁ①", "\x00a", "é日本🙂", "▁a ▁", "<0x41>", "<s>", "a" * 5000, " " * 100, "the" * 3000]
    for _ in range(3000):
        texts.append("".join(draw.choice(known).replace("▁", " ") for _ in range(draw.randint(0, 12))))
        texts.append("".join(draw.choice(" a\n▁  theé日\x00🙂") for _ in range(draw.randint(0, 30))))
        texts.append(" " * draw.randint(0, 50) + draw.choice(known) + " " * draw.randint(0, 40))
        texts.append("".join(chr(draw.randint(32, 0xD7FF)) for _ in range(draw.randint(0, 10))))
    return texts


def test_pieces_equal_the_library(pieces):
    codec, library = pieces
    texts = odd_texts(codec)
    ours = [np.frombuffer(codec.encode(t), "<i4") for t in texts]
    theirs = library.encode(texts, num_threads=1)
    assert [ids.tolist() for ids in ours] == theirs
    decoded = codec.decode_all(np.concatenate(ours), np.cumsum([0, *map(len, ours)]))
    assert decoded == [library.decode(ids) for ids in theirs]


def test_any_ids_decode_as_by_the_library(pieces):
    codec, library = pieces
    draw = random.Random(6)
    for _ in range(3000):
        ids = [draw.choice([draw.randint(0, 300), draw.randint(0, 31999), draw.randint(131, 258)]) for _ in range(draw.randint(0, 8))]
        assert codec.decode_all(np.array(ids, np.int64), np.array([0, len(ids)])) == [library.decode(ids)]


def test_tokens_stand_side_by_side_if_their_text_gives_them(pieces):
    codec, _ = pieces
    draw, numbers = random.Random(7), list(codec._known.ids.values())
    name = {i: p for p, i in codec._known.ids.items()}
    for _ in range(3000):
        one, two = draw.choice(numbers), draw.choice(numbers)
        text = [t[0] for t in piece_bpe.merged(name[one] + name[two], codec._known.rank)]
        assert codec.side_by_side(one, two) == (text == [name[one], name[two]])


def test_documents_through_spark(spark, pieces):
    codec, library = pieces
    texts = [None, "", "a b", "a b", "é\n" * 10, " x" * 2000]
    rows = [(i if i != 3 else None, t, "ids", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = piece_bpe.decode(piece_bpe.encode(docs, codec), codec).collect()
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in found] == [
        (i, library.encode(t or ""), t or "") for i, t in zip([0, 1, 2, None, 4, 5], texts)
    ]
    assert piece_bpe.decode(piece_bpe.encode(docs.limit(0), codec), codec).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert piece_bpe.decode(nothing, codec).first()["decoded"] == ""
