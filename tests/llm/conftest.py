import random

import pytest

#: Texts that strain every operator.
ODD = [None, "", " ", "\n\n", "a", "word", "A b\tC", "x" * 5000, "\x00\x1c\x85 é中 👍 é", "one two three four five", "ONE two  three four FIVE", "same line\nother\nsame line", "  spaced   out  "]


@pytest.fixture(scope="session")
def prose():
    """Documents with copies, near copies, shared passages and odd texts: (doc_id, text)."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 90, 200]))] for _ in range(40)]
    texts = list(ODD)
    for words in base:
        texts.append(" ".join(words))
        if rng.random() < 0.5:
            texts.append(" ".join(words))  # a copy
        for _ in range(rng.randint(0, 3)):
            near = list(words)
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
        if rng.random() < 0.3:
            texts.append(" ".join(words[:5]) + "\n" + passage + " " + " ".join(words[5:]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs(spark, prose):
    """The same as a table, with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, "w") for i, t in prose], "doc_id long, text string, key string, cls int, words string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
