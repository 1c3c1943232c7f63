import random

import pytest

WORDS = "the of and to in alpha beta gamma delta river stone cloud paper green seven quick brown élan über niño light".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randrange(99)) if rnd.random() < 0.5 else "") for _ in range(n))


def make_rows():
    rnd = random.Random(7)
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(sentence(rnd, rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 6))), f"s{rnd.randrange(4)}"))
    base = sentence(rnd, 120)
    for i in range(60, 75):  # near copies
        words = base.split()
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(999)}"
        rows.append((i, " ".join(words), "s0"))
    rows += [(75, rows[0][1], "s1"), (76, "  " + rows[0][1].replace(" ", "\t"), "s2"), (77, None, None), (78, "", "s0"), (79, " \n\t ", "s3"), (80, "one", "s0"), (81, "ONE", None)]
    rows += [(82, " ".join(sentence(rnd, 30) for _ in range(600)), "s1"), (83, "x" * 70_000, "s2"), (84, "<s> </s> <|endoftext|> \x00 😀 İ ΣΑΣ", "s3")]
    passage = sentence(rnd, 60)
    rows += [(85 + k, sentence(rnd, 20) + "\n" + passage + "\n" + sentence(rnd, 12), "s0") for k in range(5)]
    rows += [rows[3], rows[3], (None, rows[5][1], "s1"), (None, None, None)]
    return rows


#: Names that operators use themselves.
CLASHES = "kept digest token node place places size key bucket score text_sha256 n_tokens group_size n_lines n_dropped line shard component_id row leaf form query_id features label".split()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' as lang", "length(text) as n_chars", *[f"'clash' as {c}" for c in CLASHES])


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
