"""Labelled training texts for the field of :mod:`wellspark.llm.pii`: invented sentences with spans that are personal data
or secrets, and with look-alikes that are not. Every corpus gets the same field, whatever its documents hold.

Secrets are random keys of mixed letters and digits, values assigned to a credential's name and strings in issuers'
formats. Look-alikes are checksums and commit ids, UUIDs, page slugs, identifiers, paths, order and part numbers, long
numbers, and addresses, cards and phone numbers that fail their check. The number of examples is a parameter and the
only bound; a seed names the set.
"""

from __future__ import annotations

import random
import string

WORDS = ("the report on north river shows that many small firms moved their stock before winter and some of them asked "
         "for more time while others paid in spring after a long talk with the bank about new terms").split()
LETTERS = string.ascii_letters + string.digits
HASH_WORDS = ("commit", "sha256", "md5", "checksum", "revision", "digest", "hash", "build", "id", "")
SECRET_WORDS = ("bearer", "secret", "key", "use", "login", "credential", "")


def random_key(rng: random.Random, low: int = 24, high: int = 64, alphabet: str = LETTERS) -> str:
    n = rng.randint(low, high)
    while True:
        key = "".join(rng.choices(alphabet, k=n))
        if any(c.isdigit() for c in key) and any(c.isalpha() for c in key):
            return key


def identifier(rng: random.Random) -> str:
    parts = [rng.choice(WORDS) for _ in range(rng.randint(4, 7))] + [str(rng.randint(1, 2030))]
    kind = rng.randrange(4)
    if kind == 0:
        return "-".join(parts)
    if kind == 1:
        return "_".join(parts)
    if kind == 2:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    return "/".join(parts)


def checksum(rng: random.Random) -> str:
    text = "".join(rng.choices("0123456789abcdef", k=rng.choice((32, 40, 56, 64, 128))))
    return text.upper() if rng.random() < 0.3 else text


def uuid(rng: random.Random) -> str:
    text = "".join(rng.choices("0123456789abcdef", k=32))
    return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))


def number(rng: random.Random) -> str:
    kind = rng.randrange(4)
    if kind == 3:  # a filled field or a ruler
        return rng.choice((rng.choice(LETTERS), "ab", "0A")) * rng.randint(20, 40) + str(rng.randint(0, 99))
    if kind == 0:
        return "".join(rng.choices(string.digits, k=rng.randint(20, 40)))
    if kind == 1:
        return f"ORD-{rng.randint(2000, 2030)}-{rng.randint(0, 999999):06d}-{rng.randint(0, 9999):04d}-{rng.choice(WORDS).upper()}"
    return "-".join(f"{rng.randint(0, 9999):04d}" for _ in range(rng.randint(5, 8)))


def card_digits(rng: random.Random) -> str:
    digits = [rng.randrange(10) for _ in range(15)]
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def examples(n: int = 800, seed: int = 9) -> list[tuple[str, list[tuple[str, str]]]]:
    """(text, the (kind, span text) of its personal data) in ``n`` texts."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        before, after = rng.sample(WORDS, 2)
        found: list[tuple[str, str]] = []
        kind = k % 10
        if kind in (0, 1, 2):
            value = random_key(rng)
            if rng.random() < 0.3:
                value = value[:20] + rng.choice("-_+/") + value[20:]
            middle, found = f"{rng.choice(SECRET_WORDS)} {value}", [("secret", value)]
        elif kind == 3:
            value = rng.choice((random_key(rng, 12, 40), checksum(rng), random_key(rng, 16, 30, string.ascii_lowercase + "0123456789")))
            name = rng.choice(("token", "password", "api_key", "secret", "access_key", "DB_PASSWORD"))
            middle = name + rng.choice((' = "', "=", ": ")) + value
            found = [("secret", value)]
        elif kind == 4:
            value = rng.choice(("AKIA", "ASIA")) + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
            middle, found = value, [("secret", value)]
        elif kind == 5:
            middle = f"{rng.choice(HASH_WORDS)} {rng.choice((checksum, uuid))(rng)}"
        elif kind in (6, 7):
            middle = rng.choice((identifier, identifier, number, checksum, uuid))(rng)
        elif kind == 8:
            email, card = f"{rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.org", card_digits(rng)
            phone, ip = f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100000, 999999)}", "10.0.%d.7" % rng.randint(0, 255)
            found = rng.sample([("email", email), ("card", card), ("phone", phone), ("ip", ip)], 2)
            middle = f" {rng.choice(WORDS)} ".join(v for _, v in found)
        else:
            middle = rng.choice((f"{rng.randint(256, 999)}.1.{rng.randint(0, 255)}.9", f"+{rng.randint(1, 99)} 23",
                                 str((int(card := card_digits(rng)) // 10) * 10 + (int(card) + rng.randint(1, 9)) % 10)))
            found = []
        out.append((f"{before} {middle} {after} {rng.choice(WORDS)}", found))
    return out
