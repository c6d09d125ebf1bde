"""Tables for the tests of the text operators."""

DATA = "/root/testdata"
#: Null, empty, blank, short, repeated and non-ASCII texts.
ODD = [None, "", " \n\t ", "one", "one two", "one two three", "One  TWO three", "é ß 漢字 🙂", "a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o p", "x " * 30_000]


def table(spark, texts, first_id=0, **more):
    """documents with clashing extra columns; ids count up from first_id, the last row is repeated with a null id."""
    rows = [(first_id + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, *rows[-1][1:])] if rows else []
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS id", "2 AS fp", "'q' AS s", "3 AS t", "4 AS shard", "5 AS label", "6 AS features", "7 AS raw", "8 AS _score", "9 AS _match", "10 AS _quality")


def real(spark, name="documents", sf="sf0.001"):
    return spark.read.parquet(f"{DATA}/{sf}/{name}.parquet")


def plain(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def by_id(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select("doc_id", *columns).collect()}
