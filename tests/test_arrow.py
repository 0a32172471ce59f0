"""Ordered functions on literal cases."""

import hashlib

from granary.functions import arrow as ar


def test_nearness():
    assert ar.nearness(["a", "b"], []) == 0 and ar.nearness(["a", "b"], ["x", "a"]) == 1
    far = ["a"] + ["x"] * 29 + ["b"]
    assert ar.nearness(["a", "b"], far) == 12 / 30
    assert ar.nearness(["a", "b"], far + ["a"]) == 1


def test_decoded():
    assert ar.decoded("ё".encode()) == "ё" and ar.decoded("ё".encode("cp1251")) == "ё"
    assert ar.decoded(b"\xff\xfe\x98\x04") == "\u0498" and ar.decoded(b"") == ""


def test_hashed():
    v = ar.hashed("Ab ab", 64)
    assert abs(float((v * v).sum()) - 1) < 1e-6 and (ar.hashed("ab", 64) == v).all()
    assert not ar.hashed("", 64).any() and not ar.hashed("!?", 64).any()


def test_hashed_values():
    """Places and signs from the digests of each gram, added one by one."""
    text, dims = "Насос ab насос x1", 64
    want = [0.0] * dims
    for word in ["насос", "ab", "насос", "x1"]:
        edged = f"^{word}$"
        for gram in [word] + [edged[i : i + n] for n in (3, 4) for i in range(len(edged) - n + 1)]:
            digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
            want[int.from_bytes(digest[:4], "little") % dims] += 1 if digest[4] % 2 else -1
    norm = sum(x * x for x in want) ** 0.5
    assert [round(float(x), 5) for x in ar.hashed(text, dims)] == [round(x / norm, 5) for x in want]
