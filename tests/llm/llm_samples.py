"""Texts that operators have to stand."""

import random

WORDS = "the of and to in is was for that with report window signal garden engine copper distant yellow ridge harbor paper forest".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


#: Null, empty, blank, short, long, tied and repeated texts; ids null and repeated.
TEXTS = [
    (1, prose(1, 120)), (2, prose(2, 60)), (3, prose(1, 120)), (4, None), (5, ""), (6, " \t\n "), (7, "One"), (8, "two Words"), (9, "Naïve café – 東京 🎉\u0085x \x1f y\n\n z  "), (10, prose(3, 9000)),
    (11, "<|endoftext|> a <|endoftext|>"), (12, "don't we'll I'm 123 4567 !!! ---"), (13, prose(2, 60) + " more"), (13, prose(2, 60) + " more"), (None, prose(5, 40)), (None, None), (-7, prose(1, 119)), (2**40, "𝔘nicodé ​ zero"),
]
