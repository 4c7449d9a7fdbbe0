"""Ranked full-text search: OR of quoted phrases over id, name, qualified_name and docstring, scored by BM25 from an inverted index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import FOLD_FROM, FOLD_TO, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("id", "name", "qualified_name", "docstring")


def phrases(query: str) -> list[list[str]]:
    """Each term between white space is a phrase of its tokens; terms without a token find nothing."""
    import regex

    fold = str.maketrans(FOLD_FROM, FOLD_TO)
    return [found for term in query.split() if (found := regex.findall(r"[\p{L}\p{N}\p{Co}]+", term.translate(fold).lower()))]


def fts_query(query: str) -> str:
    """The query text: each term quoted, with OR between them; empty for blank queries."""
    return " OR ".join('"' + term.replace('"', '""') + '"' for term in query.split())


def postings(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "id") -> DataFrame:
    """term, id, places: where each token stands in a document. Places of one column follow each other; columns are far apart."""
    placed = lambda column, first: F.transform(tokens(F.col(column)), lambda t, i: F.struct(t.alias("term"), (F.lit(first).cast("long") + i).alias("place")))
    every = F.flatten(F.array(*[placed(c, at << 32) for at, c in enumerate(columns)]))
    rows = docs.select(F.col(key).alias("id"), F.explode(every).alias("x")).select("x.term", "id", "x.place")
    return rows.groupBy("term", "id").agg(F.sort_array(F.collect_list("place")).alias("places"))  # of one document


def lengths(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "id") -> DataFrame:
    """id, n_terms of every document, also those without a token."""
    return docs.select(F.col(key).alias("id"), reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in columns]).cast("long").alias("n_terms"))


def phrase_counts(found: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """id and f0, f1, ...: how often each phrase stands in a document, from the postings of the phrases' terms alone."""
    terms = sorted({t for p in wanted for t in p})
    by_term = found.filter(F.col("term").isin(terms)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))  # as many as terms

    def count(phrase: list[str]) -> F.Column:
        places = [F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<long>")) for t in phrase]
        if len(phrase) == 1:
            return F.size(places[0])
        shifted = lambda later, by: F.transform(later, lambda x: x - by)
        return F.size(reduce(F.array_intersect, [shifted(x, by) for by, x in enumerate(places)]))

    return by_term.select("id", *[count(p).cast("long").alias(f"f{i}") for i, p in enumerate(wanted)])


def _ranked(counts: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """counts (f0 ..., n_terms) with score. The one row of how many documents hold each phrase is broadcast."""
    counts = counts.filter(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(k)]))
    stats = counts.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(k)])
    both = counts.crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(k):
        idf = F.log((F.lit(n) - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        parts.append(idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("n_terms") / F.lit(mean))))
    return both.withColumn("score", reduce(lambda a, b: a + b, parts))


class Index:
    """Documents with their postings and lengths. Where these are stored tables, a query reads the postings of its own terms only."""

    def __init__(self, docs: DataFrame, found: DataFrame, sizes: DataFrame, totals: tuple[int, float] | None = None, key: str = "id"):
        self.docs, self.postings, self.lengths, self.key, self._totals = docs, found, sizes, key, totals

    @classmethod
    def of(cls, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "id") -> Index:
        """An index that is computed as part of each query."""
        return cls(docs, postings(docs, columns, key), lengths(docs, columns, key), None, key)

    def totals(self) -> tuple[int, float]:
        """The number of documents and their mean length."""
        if self._totals is None:
            row = self.lengths.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
            self._totals = (row["n"], row["mean"] or 0.0)
        return self._totals

    def scored(self, query: str) -> DataFrame:
        """The documents that hold any phrase, with score. Only those are joined with their lengths and other columns."""
        wanted = phrases(query)
        n, mean = self.totals() if wanted else (0, 0.0)
        if not n or not mean:
            return self.docs.withColumn("score", F.lit(0.0)).filter("false")
        counts = phrase_counts(self.postings, wanted).join(self.lengths, "id")
        found = _ranked(counts, n, mean, len(wanted)).select(F.col("id").alias(self.key), "score")
        return self.docs.join(found, self.key).select(*self.docs.columns, "score")

    def search(self, query: str, kind: str | None = None, limit: int = 10, name: str = "name") -> DataFrame:
        """The best documents by score, then by shorter name, then by id. kind filters results, not the corpus that is counted."""
        found = self.scored(query)
        if kind:
            found = found.filter(F.col("kind") == kind)
        return found.orderBy(F.desc("score"), F.length(name), self.key).limit(limit)

    def search_in_file(self, query: str, file: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        """Five times the limit is fetched, then filtered by file and cut: it may return fewer than there are."""
        best = self.search(query, kind, limit * 5)
        return best.filter(F.col("file_path") == file).orderBy(F.desc("score"), F.length("name"), self.key).limit(limit)


def scored(docs: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return Index.of(docs, columns).scored(query)


def search(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 10, columns: tuple[str, ...] = COLUMNS, name: str = "name") -> DataFrame:
    return Index.of(nodes, columns).search(query, kind, limit, name)


def search_in_file(nodes: DataFrame, query: str, file: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    return Index.of(nodes).search_in_file(query, file, kind, limit)
