import random

import pytest

CLASH = ("score", "fingerprint", "component_id", "fp", "th", "size", "shard", "slot", "n_lines", "ids", "key", "pos", "host", "line", "i", "n", "at",
         "_drop", "_i", "_th", "_h", "_key", "_tie", "_size", "_run", "_off", "_at", "_part", "row", "part", "run", "off", "_keep_id", "_keep_th", "_toxicity",
         "_n_lines", "_n_dropped", "_id", "tie", "weight", "rank", "node", "n_words", "n_features", "before", "gone", "_hash")


@pytest.fixture(scope="session")
def messy(spark):
    """NULLs in any column, empty, blank and long texts, ties, repeated rows, and columns with the operators' own names."""
    rnd = random.Random(5)
    words = ["The", "the", "cat", "Dog", "été", "naïve", "x1", "42", "don't", "<|endoftext|>", "ß", "日本", "a-b", "…"]

    def prose(n):
        return " ".join(rnd.choice(words) + (rnd.choice([",", ".", ""])) + rnd.choice(["", "", "\n", "\t", " "]) for _ in range(n))

    passage = prose(40)
    texts = [None, "", " \n\t ", "one", "one two", "One  two", prose(6), prose(30), prose(30_000), passage, passage + " tail", "head " + passage]
    texts += [prose(rnd.randint(3, 80)) for _ in range(40)] + [prose(10) + "\n" + passage + "\n" + prose(10) for _ in range(6)]
    texts += ["menu\n" + prose(15) + "\nfooter\n\nmenu" for _ in range(12)] + ["twice " * 60]
    rows = [(i * 3 % 101, t, ["en", None][i % 2], [None, "a", "b"][i % 3], len(t or "") if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[0], (None, passage, "en", "a", 1), (None, None, None, None, None), (rows[20][0], prose(25), "en", "b", 3), (700, passage, "en", "b", 1)]
    rows = [r + tuple(f"{c}{k}" for c in CLASH) for k, r in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, kinds).repartition(3).cache()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
