"""Secret scans against patterns written anew, on texts full of hits, and the battery's share in a decision."""

import math
import random
import string
import time

from sparkdraw.llm import secrets


def base_by_hand(text):
    """(start, kind, end) of the fixed patterns, by walking over the text."""
    out, n = [], len(text)
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    at = 0
    while at < n:
        # Letters in either case: only ASCII ones, as str.lower would also fold the long s.
        name = next((w for w in names if "".join(c.lower() if c.isascii() else c for c in text[at : at + len(w)]) == w), None)
        end = None
        if name:
            j = at + len(name)
            j += j < n and text[j] in "\"'"
            while j < n and text[j] == " ":
                j += 1
            if j < n and text[j] in ":=":
                j += 1
                while j < n and text[j] == " ":
                    j += 1
                j += j < n and text[j] in "\"'"
                k = j
                while k < n and text[k] in string.ascii_letters + string.digits + "+/_.=-":
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        out.append((at, 0, k))
        at = end or at + 1
    for kind, head, letters, least in ((1, "AKIA", string.ascii_uppercase + string.digits, 20), (2, "", "0123456789abcdef", 24)):
        at = 0
        while at < n:
            j = at + len(head)
            if text.startswith(head, at) and j < n and text[j] in letters:
                while j < n and text[j] in letters:
                    j += 1
                if j - at >= least:
                    out.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(out)


def test_fixed_patterns_against_a_walk():
    rng = random.Random(21)
    parts = ["token", "TOKEN", "Api_Key", "apikey", "passwd", "password", "secret", "=", ":", " ", "  ", '"', "'", "abc", "x1/+=", "AKIA", "AKIAQ", "Q" * 17, "0af" * 8, "g", "\n", "é", "ſecret", "_", "."]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 18)))
        assert sorted(secrets.base_spans(text)) == base_by_hand(text), text


def test_long_texts_full_of_hits():
    rng = random.Random(22)
    words = [("token=" if i % 2 else "") + "".join(rng.choices(string.ascii_letters + string.digits, k=40)) for i in range(24_000)]
    began = time.process_time()
    found = secrets.spans_of(" ".join(words))
    assert time.process_time() - began < 5 and len(found) >= 23_500
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))  # noqa: B905
    assert {s["kind"] for s in found} == {"assign", "random"}


def test_spans_that_touch_a_fixed_one_are_left_out():
    rng = random.Random(23)
    for _ in range(200):
        text = " ".join(rng.choice(["secret:", "secret: ", "", "AKIA"]) + "".join(rng.choices(string.ascii_letters + string.digits + "/", k=rng.randrange(5, 50))) for _ in range(rng.randrange(1, 9)))
        base = secrets.base_spans(text)
        for s, _, e in secrets.random_spans(text, base):
            assert not any(a < e and s < b for a, _, b in base)


def test_each_test_of_the_battery_can_reject():
    rng = random.Random(24)
    letters = string.ascii_uppercase + string.ascii_lowercase + string.digits
    plain = "".join(rng.choices(letters, k=120))
    tests, against = secrets.battery(plain, "base62")
    assert min(tests) > 0.01 and against[0] > math.log(100)
    skewed = "".join(rng.choices(letters[:5] + letters[-5:], k=120))
    assert secrets.battery(skewed, "base62")[0][0] < 1e-6
    halves = "".join(rng.choices(letters[:31], k=60)) + "".join(rng.choices(letters[31:], k=60))
    assert secrets.battery(halves, "base62")[0][1] < 1e-6 and secrets.battery(halves, "base62")[0][2] < 1e-3
    for body in (skewed, halves):
        assert secrets.log_e_value(body) == -math.inf
    assert secrets.log_e_value(plain) > math.log(1000) and secrets.log_e_value("word" * 30) == -math.inf and secrets.log_e_value("é" * 30) is None


def test_pair_counts_follow_their_law():
    """Mean and variance of equal pairs and of runs under an ordinary source, as the battery takes them."""
    rng = random.Random(25)
    alphabet = dict(secrets.ENCODINGS)["base36"]
    shares = [math.exp(secrets.MODELS[0][c]) for c in alphabet]
    low = [secrets.battery("".join(rng.choices(alphabet, shares, k=60)), "base36")[1] for _ in range(2000)]
    for part in range(2):
        # E-values have a mean of 1 at most under the null; the calibrator keeps it near 1.
        assert sum(math.exp(e[part]) for e in low) / len(low) < 1.3
