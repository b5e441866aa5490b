"""Made-up prose."""

from __future__ import annotations

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(n: int, seed: int = 0) -> str:
    """n words in sentences of about seven, never the same for two seeds."""
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(LOREM) + str(r.randrange(50))
        out.append(w.capitalize() + ("." if i % 7 == 6 else "") if i % 7 == 0 else w + ("." if i % 7 == 6 else ""))
    return " ".join(out)
