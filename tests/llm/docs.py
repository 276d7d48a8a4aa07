"""Small document tables for the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def labelled(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    return d.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id")


class Union:
    """Union-find over any values; the least value names a class."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
