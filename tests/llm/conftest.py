import random
import re

import pytest

#: Columns that operators use inside, and that a table may have already.
CLASH = "hub bigint, member bigint, set_id bigint, part int, tokens bigint, span int, kept bigint, accepted boolean"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"


def words(text):
    return [w.lower() for w in re.findall(r"(?:[^\x00-\x7f]|[0-9a-zA-Z])+", text)]


def prose(n, seed, vocabulary=400):
    """n words of an invented vocabulary."""
    r = random.Random(seed)
    return " ".join(f"w{'abcdefghij'[v % 10]}{'klmnopqrst'[v // 10 % 10]}{'uvwxyz'[v % 6]}{v % 7}" for v in (r.randrange(vocabulary) for _ in range(n)))


@pytest.fixture
def docs(spark):
    def make(rows):
        """rows of (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), 1, 2, 3, 4, 5, 6, 7, True) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
