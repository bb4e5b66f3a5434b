"""Search with every word of a query document."""

from pyspark.sql import functions as F

from tunelake.llm import search
from tunelake.llm.queries import QUERIES


def test_rare_words_and_long_queries(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "only these rare words"), (2, "only these scarce words"), (3, long),
            (4, " ".join(f"w{i}" for i in range(20, 40))), (5, " ".join(f"w{i}" for i in range(16)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in search.top_k(docs, F.lit(True), max_terms=None, min_docs=1).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["doc_id"])
    assert found == {1: [1, 2], 2: [2, 1], 3: [3, 4, 5], 4: [4, 3], 5: [5, 3]}


def test_whole_text_sql_has_no_cut():
    sql = QUERIES["op7_whole_text"].sql
    assert "df >=" not in sql and "place <=" not in sql
