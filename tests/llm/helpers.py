"""Small tables with the cases that every operator has to define."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, pos int, h string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
SENTENCE = "the quick brown fox jumps over the lazy dog while nobody looks at it today"


def rows(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in zip(ids, texts, strict=True)]


def table(spark, texts, ids=None):
    """documents with extra columns whose names operators might use themselves."""
    return spark.createDataFrame(rows(texts, ids), SCHEMA)


def edge(spark):
    """Null, empty, blank and very long texts, a repeated row and a null id."""
    return table(spark, [None, "", "  \n\t ", LONG, SENTENCE, SENTENCE, "ok", "a null id"], [0, 1, 2, 3, 4, 4, 5, None])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, path, documents, labels=None, benchmark=None, conversations=None):
    """A folder of tables that a query can read."""
    documents.write.parquet(f"{path}/documents.parquet")
    for name, df in (("labels", labels), ("benchmark", benchmark), ("conversations", conversations)):
        if df is not None:
            df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
