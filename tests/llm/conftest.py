import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = "n_words long, kept boolean, _row string, fp long, uid long, size long, spans string, ids string, block long, times long, m string, part int, rule string"

VOCABULARY = "the of and tion er on in at Haus été niño GPL α 数 x7 3.1 a-b ## end.".split()


def words(rng, n):
    return " ".join(rng.choices(VOCABULARY, k=n))


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts, copies, near copies, nulls, blanks, long and odd ones."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        text = "\n".join(words(rng, rng.randint(1, 30)) + "." for _ in range(rng.randint(1, 6)))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None])))
    same = words(rng, 300)
    out += [(100 + i, same, "en", "a") for i in range(8)]
    out += [(110 + i, same + f" tail{i}", "en", "a") for i in range(4)]
    out += [(120, words(rng, 30_000), "en", "b"), (121, "one " * 3000, "en", "b")]
    out += [(130, None, "en", "a"), (131, "", None, None), (132, " \t\n ", "fr", "é")]
    out += [(133, "\x00\x01 \x7f é😀", "fr", ""), (134, "no", "", "b")]
    out += [out[0], out[0], (None, "without an id " * 10, "en", "a")]
    return [(*r, None if r[1] is None else len(r[1])) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def crowded(spark, rows):
    """The same rows with further columns, named like those of the operators."""
    extra = [None] * len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *extra) for r in rows], f"{COLUMNS}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def as_table(tmp_path_factory):
    """Write a DataFrame as one table of a folder that a query can read."""

    def write(df, name="documents"):
        folder = str(tmp_path_factory.mktemp("tables"))
        df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write
