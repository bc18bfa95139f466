import random

import pyarrow as pa

from tamarack.llm import truncation


def test_bands_meet_near_copies_at_the_threshold():
    """Recall of the bands against brute force: pairs whose exact similarity is at the threshold."""
    rng = random.Random(3)
    pairs = []
    while len(pairs) < 3000:
        b = [f"w{rng.randrange(10**9):x}x" for _ in range(rng.randrange(44, 90))]
        a = b[: round((len(b) - 4) * 0.8) + 4 + rng.randrange(2)]
        sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        if 0.795 <= len(sa & sb) / len(sa | sb) <= 0.81:
            pairs.append((" ".join(a), " ".join(b)))
    keys, who = truncation.Banded(pa.array([t for p in pairs for t in p])).bands()
    assert len(who) == 2 * len(pairs)
    met = (keys[:, ::2] == keys[:, 1::2]).any(0).mean()
    print("recall", met)
    assert met >= 0.98
