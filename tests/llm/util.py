"""Small fixtures that every operator has to bear."""

LONG = "word thing " * 20_000
EDGE_TEXTS = [
    (1, "The and of with. the AND"), (2, "The and of with. the AND"), (2, "The and of with. the AND"), (3, None), (4, ""), (5, " \t\n\x0b "),
    (6, LONG), (None, "a row without an id"), (7, "x" * 5000 + " " + "9" * 3000), (8, "Ünïcode 漢字 😀 e\u0301 \x00 end"), (9, "one"),
]


def edge_docs(spark, extra=False):
    """doc_id, text, lang, source, n_chars; with extra also columns named like operators' own."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in EDGE_TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "fp", "key", "node", "length", "start", "ids", "media", "lang_pred", "pii_spans", "component_id", "__id", "n", "class"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def union_find(n, pairs):
    par = list(range(n))

    def find(a):
        while par[a] != a:
            par[a] = par[par[a]]
            a = par[a]
        return a

    for a, b in pairs:
        par[find(a)] = find(b)
    return [find(i) for i in range(n)]
