import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as further columns of the input.
CLASHES = "size bigint, tx string, fp string, h int, n int, words string, target int, copies int, part int, lines string, p int, key int, root int, held boolean, score int, quality int, tokens int"


@pytest.fixture()
def make_docs(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table with clashing extra columns."""

    def make(rows, parts=3):
        full = []
        for r in rows:
            doc, text, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((doc, text, lang, source, len(text) if text is not None else None, *(None,) * len(CLASHES.split(", "))))
        df = spark.createDataFrame(full, f"{COLUMNS}, {CLASHES}")
        return df.repartition(parts) if len(rows) > parts else df

    return make


@pytest.fixture()
def odd(make_docs):
    """Nulls everywhere, empty and long texts, ties, repeated rows."""
    import random

    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "das", "ist", "nicht", "le", "chat", "Tür", "İx", "ſ", "x" * 300]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", ".", ","]) for _ in range(n))
    rows = [(i, text(r.randrange(1, 120)).replace(" ", r.choice([" ", "\n", "  ", "\t"])), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "de", "b"), (None, "no id here at all", "en", None), (None, None, None, None), (103, "123 456 !!", "en", "a")]
    rows += [(104, text(30_000), "en", "c"), (105, "y" * 200_000, "de", "c"), (106, "same line of text\n" * 3000, "en", "c")]
    rows += [rows[3], rows[3], (200, rows[4][1], "en", "b"), (201, rows[4][1], "de", "a"), (7, "another text under an id that is taken", "en", "b")]
    return make_docs(rows), rows
