import pytest

SF = "/root/testdata/sf0.001"
LONG = "word " * 300 + "x" * 250_000 + " " + "tail of text. " * 2_000

#: doc_id, text, lang, source, n_chars: nulls in any column, empty and very long texts, repeated rows.
ODD = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, " \n\t\x0b ", None, "s", 5),
    (None, "one text of a row without an id " * 12, "en", None, 3),
    (5, LONG, "en", "s", len(LONG)),
    (5, LONG, "en", "s", len(LONG)),
    (7, "naïve 😀 text\r\nwith 漢字 and a mail a@b.c_d@e.fr plus +1 (234) 555-0000 x", "fr", "t", 1),
    (8, "naïve 😀 text\r\nwith 漢字 and a mail a@b.c_d@e.fr plus +1 (234) 555-0000 x", "fr", "t", 1),
    (9, "line\nline\nline\n\n\nother\nline", "en", None, 1),
    (10, "Just one clean document of more than ten words, which all rules should leave alone entirely.", "en", "t", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = ["id", "n", "fp", "spans", "host", "lines", "length", "start", "end", "key", "shard", "batch", "component_id", "failed_bits", "n_words", "row", "body", "text_hash", "kept"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
