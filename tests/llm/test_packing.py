import collections
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer, prose):
    encoder, r = packing.Encoder(PATH), random.Random(1)
    pieces = ["it's", "don't", "'S", "\"'s", "''s", "4's", "x'VE'll", "½²ªº×÷¡¿", "...", "###", "#%$'t'", "ÀÉß", "İ", "ΣΑΣ", "é", "ẛ̣", "\x1c", "\x85", "\xa0", "<|endoftext|>",
              "<|startoftext|>", "“hi”", "ŉ", "ﬁ", "\x00", "\x7f", "Ŀ", "ĳ", "ı", "日本", "🙂", "3.14", "_", " ", "\n", "\t\r", "the", "The", "ZZZ", "a1b2", "'"]
    texts = ["".join(r.choice(pieces) + r.choice(["", "", " "]) for _ in range(r.randrange(12))) for _ in range(4000)] + [prose(1, 500), "", " ", "x" * 5000]
    letters = "abcdefghijklmnopqrstuvwxyzéèüñß"
    texts += [" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(200)) for _ in range(150)]
    wrong = [t for t in texts if np.frombuffer(encoder.ids(t), "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []


def test_every_piece_has_its_place(docs_of, prose, tokenizer):
    rows = [None, "", "one", "one", *(prose(k, 40 * k + 1) for k in range(60)), "long text " * 6000]
    got = packing.packed(docs_of(rows), PATH, 256).collect()
    want = collections.Counter()
    for d, t in enumerate(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 256)):
            want[d, k, s, len(ids[s:s + 256]), zlib.crc32(np.array(ids[s:s + 256], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check(got, 256)


def check(rows, size):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= -(-sum(r.length for r in rows) // size) * 1.05 + 1


def test_repeated_rows_and_no_rows(docs_of, prose):
    rows = packing.packed(docs_of([(1, prose(1, 30))] * 50 + [(None, "x")] * 3), PATH, 256).collect()
    assert len(rows) == 53
    check(rows, 256)
    assert packing.packed(docs_of([]), PATH).collect() == []


def test_fullest_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        left = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(0, 60)
        sums = {0}
        for n, c in left.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(room, left, sorted(left, reverse=True))
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= left[n] for n, k in got.items())


def test_patterns_use_up_the_counts():
    r = random.Random(3)
    counts = {n: r.randrange(1, 2000) for n in r.sample(range(1, 2049), 900)}
    patterns = packing.plan_patterns(counts)
    used = collections.Counter()
    for times, pattern in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            used[n] += times * k
    assert used == counts and len(patterns) <= 3 * 2048
    assert sum(t for t, _ in patterns) <= 1.03 * sum(n * c for n, c in counts.items()) / 2048
