"""Stock phrases of op8 count as whole words, and do not fail long prose."""

from adloom.llm.quality import Rules, line_fails, measure


def fails(line: str) -> bool:
    return line_fails(line.encode(), line.encode().split(), Rules())


def test_stock_phrases():
    assert not fails("She put the old catalog in the second drawer.") and not fails("They met for a dialog in the blog in June.")
    assert not fails("The élog in question was rocookie, not anything else.")
    assert fails("Please log in to read this page.") and fails("We use cookies on this site.") and fails("Enable JavaScript, then go on.")
    assert fails("log in " * 15)  # 30 words, all of them in phrases


def test_long_prose_on_one_line_is_kept():
    before, after = (" ".join(f"{w}{i}" for i in range(200)) for w in ("one", "two"))
    kept = [measure([f"{before} {p} {after}.".encode()], Rules(), True)[6][0] for p in ("a cookie with javascript", "click here to log in", "the catalog in the hall")]
    assert kept == [True] * 3
