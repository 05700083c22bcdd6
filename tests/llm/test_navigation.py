"""Lines that the check of the whole text must not pass over."""

from genoframe.llm import quality_rules


def test_navigation_line_of_two_symbols(spark):
    """Two separators are the text's only symbols: the line goes all the same."""
    body = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, f"Home | About | Contact.\n{body}"), (2, f"a | b c.\n{body}"), (3, f"one # two #.\n{body}")]
    got = {r.doc_id: r for r in quality_rules.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_symbols, got[1].n_clean_words, got[1].clean_text, got[1].kept) == (2, 60, body, True)
    assert (got[2].n_clean_words, got[3].n_clean_words) == (64, 64)
