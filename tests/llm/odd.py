"""Small tables of odd rows that every operator is tested on."""

TEXTS = [
    None, "", " ", "\n", "one", "a b c d e f g", "Ünïcode – “quotes” 日本語 ﬁ ́x", "same text here, twice over and over", "same text here, twice over and over",
    "tab\tand\r\nline ends\x0b\x0c \xa0 wide", "word " * 5000, "x" * 20000, "<|endoftext|> <|startoftext|>", "it's 'S what's\n's",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS, extra=True):
    """Rows with repeated, null and extreme ids and, with ``extra``, columns whose names operators use inside."""
    rows = [(i if t is not None else None, t, None, None, None) for i, t in enumerate(texts)]
    rows += [(3, "\n", "en", "src", 1), (3, "another text of id three", "en", "src", 24)]
    rows += [(i, f"{k // 2} ends of ids", "en", None, None) for k, i in enumerate([2**63 - 1, -(2**63), None, None, 9007199254740993, 2**63 - 1])]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("length", "part", "start", "words", "bucket", "hash", "band", "pos", "group", "kind", "range", "spans"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def long_text(n=200_000):
    """A text of some MB in many lines, with repeats, that no operator may cut short."""
    return " ".join(f"w{i % 50_021}{' of the' if i % 7 == 0 else ''}{chr(10) if i % 31 == 0 else ''}" for i in range(n)) + " token=abcdefgh end"
