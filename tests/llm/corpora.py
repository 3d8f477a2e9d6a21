"""Small random corpora for the tests of the ten operators."""

import random

WORDS = ["the", "of", "and", "to", "été", "für", "x", "licence", "Straße", "a,b", "niño", "日本", "end."]


def corpus(seed: int, n: int, longest: int = 60) -> list[tuple[int, str | None]]:
    """Texts over few words, with copies, near copies, shared passages, runs, null and empty ones."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(25)]
    texts: list[str | None] = [None, "", " \n\t ", "x " * 40, "y " + "x " * 20 + "z"]
    for _ in range(n):
        words = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(longest))]
        kind = rng.random()
        if kind < 0.2 and texts[-1]:
            texts.append(texts[-1])
            continue
        if kind < 0.4 and texts[-1]:
            words = texts[-1].split()
            if words:
                words[rng.randrange(len(words))] = "changed"
        elif kind < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randrange(5) : 25 - rng.randrange(5)]
        elif kind < 0.7:
            words += ["run"] * rng.randrange(30)
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return list(enumerate(texts))
