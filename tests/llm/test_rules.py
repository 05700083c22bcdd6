"""The line rules and the mix against their SQL, on texts made at random."""

import random

import duckdb

from genoframe.llm import mixing, quality_rules

PARTS = [
    "A sentence that ends well.", "one | two | three", "one • two • three.", "Home > About > Contact", "Terms of use apply here.", "Read more about it.", "cut off here...", "no mark at the end",
    "Stop!! Now!! Go!!", "# $ % &", "two words.", "Quoted “so”", "Is it so?", "he said it was all right (yes)", "trailing blanks.  \t", "subscribe to us now!", "été à la mer。", "x", "", "   ", "a long line " * 9 + "read more.", "… … …",
    "ends with  ",
]


def texts(n: int, seed: int) -> list:
    rng = random.Random(seed)
    body = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 5, 60]))) + rng.choice([".", "", "!"])
    return [None, "", " \n\t"] + ["\n".join([*(rng.choice(PARTS) for _ in range(rng.randint(0, 6))), body(), rng.choice(PARTS)]) for _ in range(n)]


def compared(spark, rows, kind, made, sql):
    df = spark.createDataFrame(rows, kind)
    got = made(df).toArrow().to_pylist()
    documents = df.toArrow()  # noqa: F841
    want = duckdb.sql(sql).to_arrow_table().to_pylist()
    key = lambda t: sorted(str(sorted(r.items())) for r in t)
    assert key(got) == key(want)
    return got


def test_line_rules(spark):
    rows = list(enumerate(texts(400, 1)))
    got = compared(spark, rows, "doc_id long, text string", lambda df: quality_rules.measured(df).drop("clean_text"), quality_rules.OP1_SQL)
    assert 0 < sum(r["kept"] for r in got) < len(got) and sum(r["n_clean_words"] < r["n_words"] for r in got) > 100


def test_precheck_changes_nothing(spark):
    """suspect() holds wherever some line is marked."""
    df = spark.createDataFrame([(x,) for x in texts(400, 2) if x], "text string")
    from pyspark.sql import functions as F

    lines = df.select("text", F.explode(F.split("text", "\n")).alias("line"))
    symbols = F.regexp_count("text", F.lit(f"[{quality_rules.SYMBOLS}]"))
    marked = lines.where(quality_rules.line_marked(F.col("line")))
    assert marked.count() > 100 and marked.where(~quality_rules.suspect(F.col("text"), symbols)).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, i, i * 1021]), rng.choice(["w " * 5, "w " * 40, None, ""]), rng.choice(["a", "b", "c", None])) for i in range(3000)]
    compared(spark, rows, "doc_id long, text string, source string", mixing.taken, mixing.OP2_SQL)
