import random

import pytest

from quantloom.llm import secrets

SCAN = secrets.EntropyScan(secrets.Scan())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@pytest.mark.parametrize("characters", [LOWER + DIGITS, UPPER + "234567", UPPER + DIGITS, UPPER + LOWER + DIGITS])
@pytest.mark.parametrize("size", [20, 24, 32, 40])
def test_random_keys_of_common_alphabets_are_found(characters, size):
    rng = random.Random(size)
    missed = sum(not SCAN.spans("".join(rng.choice(characters) for _ in range(size))) for _ in range(1000))
    assert missed < 60


def test_words_with_a_digit_are_no_secrets(docs):
    letters = "".join(c for r in docs.limit(50).collect() for c in r.text if "a" <= c <= "z")
    rng = random.Random(2)
    at = [rng.randrange(len(letters) - 20) for _ in range(1000)]
    assert sum(bool(SCAN.spans(letters[i:i + 19] + "7")) for i in at) < 250
    assert not SCAN.spans("internationalization2") and not SCAN.spans("2024-01-15T10-30-00") and not SCAN.spans("2024-01-15_report_final_v2")


def test_allow_list_covers_only_windows_it_touches():
    key = "q7Zk2Wm9Xv4Rt8Lp3Nc6Hb5Jd1Gf0Ys"
    for part in ("example", "qwertyuiop", "0123456789abcdef"):
        (a, kind, b), = SCAN.spans(f"{part}/{key}")
        assert a >= len(part) and b == len(part) + 1 + len(key)
    assert SCAN.spans(f"2024-01-15-{key}") and not SCAN.spans("example" + key[:15])
