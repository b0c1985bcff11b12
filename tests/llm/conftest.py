import random

import pytest


@pytest.fixture(scope="session")
def odd_documents():
    """Nulls, empty and long texts, repeated rows and ids, capitals beyond ASCII, hot copies."""
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "GAMMA", "\u00c9t\u00e9", "stra\u00dfe", "x1", "\u212aelvin", "omega.", "one", "two"]
    base = [" ".join(rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    rows: list[tuple] = []
    for i in range(60):
        words = base[i % 6].split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", f"s{i % 3}" if i % 7 else None, 5))
    rows += [(100 + i, base[0], "en", "s0", 5) for i in range(25)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n ", "en", "s1", 4), (203, "\n\n", None, "s2", 2)]
    rows += [(204, "lone", "en", "s1", 4), (205, "LONE", "en", "s1", 4), (206, "a b c d e", "en", "s1", 9), (207, "A  B\tc d\ne", "en", "s9", 9)]
    rows += [(208, "\n".join(f"line number {i % 50} of a long text" for i in range(3000)), "en", "s0", 1)]
    rows += [(209, "line number 7 of a long text\nown words stay here", "en", "s0", 1), (210, "  LINE number 7 OF a long text \nmore", "en", "s0", 1)]
    rows += [(5, "a second text of the same id", "en", "s1", 1), (300, "repeated row here", "en", "s1", 1), (300, "repeated row here", "en", "s1", 1)]
    rows += [(None, "no id at all in this text", "en", "s2", 1), (None, base[1], "en", "s2", 1)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark, odd_documents, tmp_path_factory):
    """The rows as a written table, with columns whose names the operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(odd_documents, SCHEMA).selectExpr("*", "1 as pos", "'x' as line", "2 as size", "3 as part", "4 as hash", "5 as node")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
