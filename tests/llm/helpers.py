"""Small tables with the awkward cases: nulls, blanks, long texts, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ing", ",", "."]) for _ in range(n))


def odd_texts():
    return [
        None, "", " ", "\n", "\n\n", "a", "A b", "é\n É ", "word " * 30, prose(1, 60), prose(1, 60), prose(2, 200), prose(3, 3000),
        "x" * 5000, "\t\x0b\x0c\r tabs\t\tand\r\nreturns ", "𝒳𝓎 🎉 emoji ​ zero", "<|endoftext|> inside <|startoftext|>x",
        "password = 'hunter2hunter2' token:abc secret=\"ABCDEFG\"", "Ünïcödé ÀÉÎ " * 5, "a  b   c    d e f \x1c g", "|a|b| c | d",
        prose(2, 199) + " changed", "don't we'll I'm  they've", "ﬁ ligature İstanbul ΑΣ ſ K", "12345 67890 3.14 ½ ²",
    ]


def documents(spark, texts=None, extra=True):
    texts = odd_texts() if texts is None else texts
    rows = [(i * 3 + 1, t, ["en", "de", None, "xx"][i % 4], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that operators use themselves
        for name in ("n_words", "shard", "slot", "kept", "secrets", "_key", "_h1", "_n_docs", "node", "length", "ids", "sequence_id", "n_lines", "_drop"):
            df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
