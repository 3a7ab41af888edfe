import random
import re

import numpy as np
import pyarrow as pa

from notelake.llm import exchange as X
from notelake.llm import suffixes
from notelake.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes_agree_with_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t\x0b\x1f ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None]
    seen = {}
    got = []
    for t in T.text_blocks(pa.array(texts, pa.large_string()), limit=200):
        start, end, doc = T.words(t)
        for a, b, d, h in zip(start, end, doc, T.word_hash(t.data, start, end), strict=True):
            w = t.data[a:b].tobytes().decode()
            got.append((t.first + int(d), w))
            assert seen.setdefault(w, h) == h
    assert got == [(i, w) for i, x in enumerate(texts) for w in WORD.findall(x or "")]
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_block_is_hashed_the_same_everywhere():
    word = "x" * (3 << 20)
    a, b = (next(iter(T.text_blocks(pa.array([t], pa.large_string())))) for t in (word, "a " + word + " b"))
    (ha,), hb = T.word_hash(a.data, *T.words(a)[:2]), T.word_hash(b.data, *T.words(b)[:2])
    assert ha == hb[1]


def test_packing_round_trip():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    c = np.arange(1000, dtype=np.uint32)
    table = X.pack(3, 7, h, c)
    row, h2, c2 = X.unpack(table, np.uint64, np.uint32)
    assert (h2 == h).all() and (c2 == c).all() and len(set(row)) == table.num_rows <= 7
    a, b = X.stretch(X.squeeze(h, c), np.uint64, np.uint32)
    assert (a == h).all() and (b == c).all()


def test_suffix_arrays_against_sorting():
    for few in (24, 1, 1000):
        suffixes.FEW = few
        for seed in range(40):
            rng = random.Random(seed)
            letters = rng.choice([b"a", b"ab", bytes(range(97, 123))])
            texts = sorted((bytes(rng.choice(letters) for _ in range(rng.randint(0, 50))) * rng.randint(1, 3) for _ in range(rng.randint(1, 40))), key=len, reverse=True)
            size = np.array([len(t) + 1 for t in texts])
            raw = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
            _, s = np.unique(np.repeat(np.arange(len(texts)), size) * 257 + raw, return_inverse=True)
            sa = suffixes.suffix_arrays(s.astype(np.int64), size)
            base, want = 0, []
            for n in size:
                part = s[base : base + n].tolist()
                want += [base + i for i in sorted(range(n), key=lambda i: part[i:])]
                base += n
            assert sa.tolist() == want
            phi, common = suffixes.common_prefixes(s, sa, np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            for i, j in enumerate(phi):
                if j >= 0:
                    h = 0
                    while s[i + h] == s[j + h]:
                        h += 1
                    assert common[i] == h
    suffixes.FEW = 24
