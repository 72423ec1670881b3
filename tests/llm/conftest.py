import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"en": "the of and ing tion er st nd th is", "de": "der und ung ein sch keit die ich ver zu", "fr": "le la eau eux ment que re ou des en"}


def words(rng, lang, n):
    parts = LANGS[lang].split()
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def make_docs(n=120, seed=1):
    """Rows with copies, near copies, shared passages, nulls, empty, long and repeated texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, "en", 60))
    rows, texts = [], []
    for k in range(n):
        lang = rng.choice(list(LANGS))
        own = words(rng, lang, rng.randrange(5, 200))
        if k % 9 == 4:
            at = rng.randrange(len(own))
            own[at:at] = passage.split()
        text = " ".join(own)
        if k % 11 == 7 and texts:
            text = rng.choice(texts)
        elif k % 13 == 8 and texts:
            edited = rng.choice(texts).split(" ")
            edited[rng.randrange(len(edited))] = "changed"
            text = " ".join(edited)
        texts.append(text)
        rows.append((k, text, lang, f"src{k % 5}", len(text)))
    rows += [
        (n, None, None, None, None), (n + 1, "", "en", None, 0), (n + 2, " \n\t ", None, "s", 4), (n + 3, "Zusammen?!", "de", "s", 10), (n + 4, "12345 ... 67", None, "s", 12),
        (n + 5, "very long " * 4000 + "end", "en", "s", 40003), (None, "no id here", "en", "s", 10), (None, None, None, None, None),
        (n + 6, "漢字 и кириллица 😀 é", None, "s", 10), (n + 7, "one two three four\x1cfive  six\r\nseven", "en", "s", 40), rows[3], rows[3], (n + 8, "x" * 5000, "en", "s", 5000),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


#: Columns of other tables and of the operators' own work, under which a table may have columns of its own.
CLASHING = ("key", "check", "fp", "component_id", "spans", "runs", "at", "row", "length", "score", "lang_pred", "sequence_id", "offset", "id", "toxic", "__key", "__check", "__spans", "finds", "c0", "c1", "a.b", "cut", "packed", "query_id", "v", "frame", "node", "partition")


@pytest.fixture(scope="session")
def clashing(spark, rows):
    schema = DOCS + "".join(f", `{c}` string" for c in CLASHING) + ", `odd name` int"
    return spark.createDataFrame([(*r, *(f"{c}!" for c in CLASHING), 7) for r in rows], schema)
