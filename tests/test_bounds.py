"""What tasks hold at once."""

import pyarrow as pa

from contentwatch.functions import html, text


def test_large_pages_are_parsed_in_small_parts():
    pages = ["x" * 300_000] * 7 + ["y" * 3_000_000] + [None, "z"] * 150
    parts = list(html._parts(pa.array(pages, pa.string())))
    assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(pages)
    for start, n in parts:
        assert n == 1 or n <= html.PARSED_PAGES and sum(len(p or "") for p in pages[start : start + n]) <= html.PARSED_CHARS
    assert list(html._parts(pa.array([], pa.string()))) == []


def test_summary_of_a_long_text_takes_linear_time():
    import time

    long = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} is one of many words here." for i in range(15_000))
    began = time.time()
    assert len(text.best_sentences(long, 5, 2)) > 50 and time.time() - began < 5
    assert text.best_sentences(None, 5, 2) == "" and text.best_sentences("One only.", 5, 2) == "One only."
