import random

import numpy as np
import pytest

from contentwatch.llm import substrings as su

VALUES = [int(v) for v in su.gear_values()]
SPACE = set(b" \t\n\x0b\x0c\r")


def slow_cuts(text: bytes):
    """Cuts by rolling the hash byte by byte."""
    out, since, past = [0], 0, [0] * su.WINDOW
    for i, b in enumerate(text):
        past, since = [*past[1:], b], 0 if b in SPACE or b == 0 else since + 1
        h = 0
        for x in past:
            h = ((h << 1) + VALUES[x]) & 0xFFFFFFFF
        after = text[i + 1] if i + 1 < len(text) else 32
        word = (b in SPACE or b == 0) and h >> (32 - su.BITS) == 0
        run = since >= su.RUN and after & 0xC0 != 0x80 and h >> (32 - su.RUN_BITS) == 0
        if (word or run) and after not in SPACE and after != 0:
            out.append(i + 1)
    return [*out, len(text)]


def slow_chunks(text: bytes):
    """(start, stop) in bytes of every chunk."""
    cuts = slow_cuts(text)
    found = [(c, next(d for d in cuts if d >= c + su.LEAST)) for c in cuts if c + su.LEAST <= len(text)]
    return found + ([(0, len(text))] if len(text.decode()) >= su.LEAST_CHARS else [])


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéñ", k=rng.randrange(1, 9))) for _ in range(n))


def test_chunks_equal_the_slow_form():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(200)).encode() for _ in range(30)] + [b"", b"x", "é".encode() * 2000, b" " * 3000, b"\0\0 a", "".join(rng.choices("漢字仮名交文", k=900)).encode(), b"".join(rng.choices([b"A", b"C", b"G", b"T"], k=900))]
    for text, (starts, stops, first, last, digests) in zip(texts, su.Chunks()(texts)):
        assert list(zip(starts.tolist(), stops.tolist())) == slow_chunks(text)
        assert first.tolist() == [len(text[:s].decode()) for s in starts.tolist()] and last.tolist() == [len(text[:s].decode()) for s in stops.tolist()]
        assert len(digests) == len(starts)


def test_insertions_move_few_chunks():
    rng = random.Random(4)
    for text in (prose(rng, 2000), "".join(rng.choices("漢字仮名交文", k=4000))):
        other = text[:3000] + "inserted words " + text[3000:]
        a, b = (set(map(tuple, d.tolist())) for *_, d in su.Chunks()([text.encode(), other.encode()]))
        assert len(a & b) >= len(a) - 12


def brute(docs):
    """Spans from the definition, with chunks as strings."""
    held, out = {}, []
    for d, t in docs:
        raw = (t or "").encode()
        for a, b in slow_chunks(raw):
            held.setdefault(raw[a:b], []).append((d, t, len(raw[:a].decode()), len(raw[:b].decode())))
    spans = {}
    order = lambda d: (d is not None, d or 0)
    for places in held.values():
        first = min((p[0] for p in places), key=order)
        for d, t, a, b in places:
            if order(d) > order(first):
                spans.setdefault((d, t), set()).add((a, b, first))
    for (d, _), found in spans.items():
        merged = []
        for a, b, f in sorted(found, key=lambda x: (x[0], x[1], order(x[2]))):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]), min(f, merged[-1][2], key=order))
            else:
                merged.append((a, b, f))
        out += [(d, a, b, f) for a, b, f in merged if b - a >= su.LEAST_CHARS]
    return sorted(out, key=lambda x: (*x[:3], order(x[3])))


def test_spans_equal_brute_force_and_planted_passages_are_found(spark):
    rng = random.Random(6)
    passages = [prose(rng, 55) for _ in range(8)]
    docs, planted = [], []
    for i in range(80):
        text = prose(rng, rng.randrange(20, 150))
        if i % 2:
            text += " " + passages[i % 8] + ". " + prose(rng, 10)
            planted.append(i)
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, docs[0][1]), (92, docs[0][1]), (93, "same " * 400), (94, "same " * 400), (None, docs[4][1]), (95, docs[4][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, span_row int")
    spans = su.repeated_spans(df)
    got = sorted(((r.doc_id, r.span_start, r.span_stop, r.first_doc_id) for r in spans.collect()), key=lambda x: (*x[:3], x[3] is not None, x[3] or 0))
    assert got == brute(docs)
    assert {d for d, *_ in got} >= {d for d in planted if d >= 8}  # all but the first with each passage
    assert not {d for d, *_ in got} & {d for d, _ in docs if d is not None and d < 80 and not d % 2 and d != 4}
    assert (95, 0, len(docs[4][1]), None) in got  # the copy without an id comes first
    cut = {r.doc_id: r for r in su.remove_spans(df, spans).collect()}
    for d, t in docs:
        want, at = "", 0
        for _, a, b, _ in [x for x in got if x[0] == d]:
            want, at = want + t[at:a], b
        assert cut[d].text == (want + t[at:] if t is not None else None)
        assert cut[d].span_row == 1


def test_empty_table(spark):
    assert su.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, small_tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.span_start, r.span_stop, r.first_doc_id) for r in su.query(spark, small_tables).collect()) == brute(docs)


def test_exact_copies_over_the_limit_are_all_found(spark):
    rng = random.Random(11)
    texts = [t for t in (prose(rng, 25) + "." for _ in range(400)) if len(t) >= su.LEAST_CHARS][:300] + [rng.choice("xy") * 130 + str(i) for i in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.span_start, r.span_stop) for r in su.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got >= {(1000 + i, 0, len(t)) for i, t in enumerate(texts)}


def test_stage_with_columns_of_its_own_names(spark):
    rng = random.Random(12)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 60) + " " + passage, 1, 2, 3, 4) for i in range(3)] + [(None, None, 1, 2, 3, 4), (9, "", 1, 2, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, span_doc_id int, removed_chars int, span_list int, n_chars int")
    got = su.stage(spark, df, "")
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[0].text == docs[0][1] and rows[0].n_chars == 4 and all(tuple(r)[2:5] == (1, 2, 3) for r in rows.values())
    assert len(rows[2].text) < len(docs[2][1]) - 200 and rows[2].n_chars == len(rows[2].text) and rows[None].text is None
