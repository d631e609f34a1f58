import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = "key part tokens n sig copy word text_ id doc at label _text _lines lines x y rep comp tree prob score kept".split()
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def corpus(seed=0, n=60):
    """Rows (doc_id, text): plain ones, copies, near copies, shared lines, and odd cases."""
    rng = random.Random(seed)
    texts = ["\n".join(words(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))) for _ in range(n)]
    for i in range(5):
        texts.append(texts[i])
        edited = texts[i + 10].split(" ")
        edited[len(edited) // 2] = "changed"
        texts.append(" ".join(edited))
        texts.append(texts[i + 20].split("\n")[0] + "\n" + words(rng, 40))
    texts += ["", None, "  \n\t ", "one", "two words", "ünïcödé wörds äre hére", "x" * 50_000, words(rng, 9_000), "<|endoftext|> spelled out", " lead  and   gaps "]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) rows, with further columns of clashing names."""

    def make(rows, extra=True):
        full = [(d, t, "en" if (d or 0) % 2 else None, "src0" if (d or 0) % 3 else "src1", len(t or "")) for d, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.select("*", *(F.lit("?").alias(c) for c in CLASHING)) if extra else df

    return make
