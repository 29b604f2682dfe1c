"""Where operators once did less than the whole job."""

import random

import numpy as np

from quillmere.llm import secrets, spm


def test_spm_draws_every_occurrence_on_its_own():
    enc = spm.Encoder(spm.default_path(), rate=0.3, seed=5)
    text = " ".join(["internationalization"] * 40)
    got = enc.encode([text, text, text], [1, 2, 1])
    assert got[0] == got[2] != got[1]
    # the parts of a text, told apart by decoding: every piece with a blank before it starts one
    starts = {i for i, p in enumerate(enc.v.pieces) if p.startswith(spm.BLANK)}
    ways, now = set(), []
    for i in np.frombuffer(got[0] + got[1], np.int32).tolist():
        if i in starts and now:
            ways.add(tuple(now))
            now = []
        now.append(i)
    assert len(ways) > 10


def test_spm_trees_equal_merging():
    rng = random.Random(1)
    enc = spm.Encoder(spm.default_path(), rate=0.3, seed=5)
    words = ["internationalization", "the", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 90, "Ünïcode", "你好🙂", "segmentation", "▁", "a-b_c/d"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(20)] + [None, "", "  two  blanks "]
    keys = [rng.randrange(-(2**63), 2**63) for _ in texts]
    got = enc.encode(texts, keys)
    for text, key, ids in zip(texts, keys, got, strict=True):
        parts = spm.PART.findall(spm.BLANK + text.replace(spm.BLANK, spm.LITERAL).replace(" ", spm.BLANK)) if text else []
        draws = spm.mix64(np.arange(len(parts), dtype=spm.U64) + spm.mix64(np.array([key & (2**64 - 1)], spm.U64)))
        alone = [enc.finish(*enc.merge(enc.start([p]), draws[k : k + 1]))[0] for k, p in enumerate(parts)]
        assert b"".join(alone) == ids
        assert enc.decode(np.frombuffer(ids, np.int32).tolist()) == (text or "")
    assert enc.encode(texts, keys) == got


def test_secrets_short_or_without_digits_are_scored():
    rng = random.Random(2)
    letters = lambda k: "".join(rng.choices("BCDFGHJK", k=k))
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(6, 9))) for _ in range(600)]
    model = secrets.Model([("assign", letters(10)) for _ in range(300)] + [("", w) for w in words[:400]])
    say = lambda: " ".join(rng.choices(words[400:], k=30))
    for value in [letters(10) for _ in range(20)] + [letters(40) for _ in range(20)]:
        text = f"{say()} {value} {say()}"
        at = text.index(value)
        assert secrets.all_spans(text, model, 1.0, {}) == ([], [("format", at, at + len(value))])
    for _ in range(50):
        assert secrets.all_spans(f"{say()} 4263429643439180", model, 1.0, {}) == ([], [])


def test_spm_forgetting_changes_nothing():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    big, small = spm.Encoder(spm.default_path(), rate=0.3, seed=5), spm.Encoder(spm.default_path(), rate=0.3, seed=5, cached=300)
    for _ in range(2):
        for k in range(0, 60, 5):
            assert small.encode(texts[k : k + 5], range(k, k + 5)) == big.encode(texts[k : k + 5], range(k, k + 5))
    assert big.part.n > 2000 and small.part.n < big.part.n
