"""Random texts for the tests of this folder."""


def prose(rng, n, words=400):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.2
                    else f"w{rng.randrange(words)}q" for _ in range(n))
