"""Small texts with every hard case: nulls, empties, ties, copies, near copies, long texts, odd bytes."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 7, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["the", "of", "and", "The"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows: list[str | None] = []
    for _ in range(n):
        rows.append("\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 9))))
    base = sentence(300)
    rows += [base, base, base.replace(" ", "  "), base.upper()]
    for k in range(8):  # near copies
        words = base.split()
        for i in rng.sample(range(len(words)), 1 + k):
            words[i] = "x" + words[i]
        rows.append(" ".join(words))
    passage = sentence(120)
    rows += [sentence(30) + "\n" + passage + "\n" + sentence(30) for _ in range(5)]
    rows += [None, "", " \t\n", "one", "two words", "a b c d", "a b c d", "a b c d e", "\n\n\n", "\x00 \x00", "aaaa " * 900, "ab" * 700]
    rows += [sentence(6000)]
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(rows)] + [(None, "no id here", None, None, None), (3, rows[3], "en", "src1", 1)]
