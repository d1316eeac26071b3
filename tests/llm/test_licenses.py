import random
import re
from pathlib import Path

from contentwatch.llm import licenses as li


def brute(docs, threshold=li.THRESHOLD):
    out = []
    for d, text in docs:
        text = text or ""
        units = [("text", 0, text)]
        for name, parts in (("paragraph", re.split(r"\n\n+", text)), ("line", text.split("\n"))):
            units += [(name, i, p) for i, p in enumerate(parts)] if len(parts) > 1 else []
        for unit, place, body in units:
            own = set(li.bigrams_of(body))
            scores = []
            for name, t in li.TEMPLATES.items():
                b = set(li.bigrams_of(t))
                if own:
                    dice = round(2 * len(own & b) / (len(own) + len(b)), 9)
                    scores += [(-dice, name)] if dice >= threshold else []
            if scores:
                out.append((d, unit, place, min(scores)[1], -min(scores)[0]))
    return sorted(out)


def test_equals_brute_force(spark):
    mit, gpl = li.TEMPLATES["MIT"], li.TEMPLATES["GPL-3.0 header"]
    docs = [
        (1, None), (2, ""), (3, "one"), (4, mit), (4, mit), (5, f"Copyright (c) 2020 A. Person\n\n{mit.upper()}\n\nmore words here"),
        (6, "\n".join(re.findall(r".{1,60}(?: |$)", gpl))), (7, f"prose before\n{gpl}\nprose after " + "word " * 5000), (8, "released UNDER the MIT license!\nx"),
        (9, "Licensed under CC BY 4.0\nLicensed under CC BY-SA 4.0"), (10, mit.replace("copy", "clone").replace("Software", "Program")), (11, "all rights reserved all rights reserved " * 50),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, unit string")
    got = sorted(tuple(r) for r in li.scan(df).collect())
    assert got == brute(docs)
    assert {(4, "text", 0, "MIT", 1.0), (8, "line", 0, "MIT notice", 1.0)} <= set(got)
    assert li.scan(df.limit(0)).count() == 0 and li.scan(df, templates={}).count() == 0


def test_query(spark, small_tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in li.query(spark, small_tables).collect())
    assert got == brute(docs) and got


def test_complete_texts_and_notices_inside_sentences(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    full = [p.stem for p in (Path(li.__file__).parent / "license_texts").glob("*.txt")]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0"} <= set(full)
    docs, want = [], {}
    for name in full:
        whole, block = li.TEMPLATES[name], " ".join(li.TEMPLATES[name].split())
        for kind, text in (("text", whole), (None, f"{prose(300)}\n\n{whole}\n\n{prose(300)}"), (None, f"{prose(50)}. {block} {prose(50)}\n{prose(9)}")):
            want[len(docs)] = (kind, name)
            docs.append((len(docs), text))
    notice = "was released under the MIT License"
    docs += [(900, f"{prose(30)} This file {notice} by its authors, {prose(9)}; the other one {notice} too."), (901, prose(400)), (902, None), (903, "")]
    got = {}
    for r in li.scan_with_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.unit, r.license, r.dice, r.place))
    for d, (kind, name) in want.items():
        assert any(kind in (None, u) and x == name and dice >= li.THRESHOLD for u, x, dice, _ in got[d]), (d, kind, name, got.get(d))
    text = docs[-4][1]
    assert sorted(got[900]) == [("run", "MIT notice", 1.0, i) for i in (33, 54)] and [w for i in (33, 54) for w in text.split()[i : i + 1]] == ["released"] * 2
    assert not {901, 902, 903} & set(got)


def test_runs_repeat_no_unit(spark, small_tables):
    df = spark.read.parquet(f"{small_tables}/documents.parquet")
    assert sorted(map(tuple, li.scan_with_runs(df).collect())) == sorted(map(tuple, li.scan(df).collect()))
