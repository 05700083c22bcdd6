"""A benchmark of several blocks against one automaton."""

from pyspark.sql import functions as F

from genoframe.llm import decontaminate


def test_repeated_rows_in_several_blocks(spark):
    """A benchmark of several blocks gives each row what one automaton gives it, equal rows and ids included."""
    words = [f"w{i}" for i in range(200)]
    items = spark.createDataFrame([(f"i{k}", " ".join(words[40 * k : 40 * k + 40])) for k in range(5)], "item_id string, text string")
    leak, clean = " ".join(words[30:75]), " ".join(f"c{i}" for i in range(45))
    rows = [(1, leak), (1, leak), (1, clean), (2, clean), (2, " ".join(words[80:125])), (None, leak), (None, clean), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.struct("doc_id", "text").alias("doc"), "doc_id", "text")
    for keep in (("doc_id",), ("doc",)):
        one, many = ([(*r[:-1], sorted(r.items)) for r in decontaminate.hits(df, items, max_bytes=size, keep=keep).collect()] for size in (decontaminate.MAX_BYTES, 2000))
        assert len(many) == len(rows) and sorted(map(str, many)) == sorted(map(str, one))
