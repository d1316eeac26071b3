"""Greedy deduplication of ordered records, exactly and in parallel, and the near relations that it uses."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.functions.text import hamming, let
from contentwatch.operators.tables import scratch, written


def near_simhashes(values: DataFrame, radius: int = 3) -> DataFrame:
    """(value, other): both ways, the distinct non-zero simhashes (column value) within ``radius`` bits.

    Of six blocks at most three differ, so three are equal: twenty tables, keyed by three blocks each.  The sizes that Spark
    estimates of exploded rows are too small by the number of tables, so the join is told not to send them through the driver.
    """
    edges = [64 * i // 6 for i in range(7)]
    block = lambda i: F.shiftrightunsigned("value", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keys = [F.xxhash64(F.lit(t), *[block(i) for i in c]) for t, c in enumerate(combinations(range(6), 6 - radius))]
    some = values.where("value != 0").select("value").distinct().select("value", F.explode(F.array(*keys)).alias("key"))
    pairs = some.hint("merge").join(some.withColumnRenamed("value", "other").hint("merge"), "key").where("value < other")
    near = pairs.where(hamming(F.col("value"), F.col("other")) <= radius).select("value", "other").distinct()
    return near.unionByName(near.select(F.col("other").alias("value"), F.col("value").alias("other")))


#: From this length on, difflib leaves out characters that are frequent in the second text.
JUNK_FROM = 200


def _points(texts: list[str], fill: int):
    """Code points, a text a column; ``fill`` after a text's end."""
    import numpy as np

    most = max(map(len, texts))
    points = np.array(texts, dtype=f"U{most}").view(np.uint32).reshape(-1, most).T.copy()
    points[np.arange(most)[:, None] >= np.array([len(x) for x in texts])] = fill
    return points


def _longest_blocks(a, b):
    """Size and first places of each pair's longest common block, of equals the first in ``a``, then in ``b``."""
    import numpy as np

    width, rows = len(a), len(b)
    run, best = np.zeros((rows + 1, a.shape[1]), np.uint32), np.zeros(b.shape, np.uint32)
    for i in range(width):
        run[1:] = (run[:-1] + 1) * (a[i] == b)
        np.maximum(best, (run[1:] << 16) + ((255 - i) << 8), out=best)
    best = (best + (255 - np.arange(rows, dtype=np.uint32))[:, None]).max(axis=0)
    size = (best >> 16).astype(np.int64)
    return size, 256 - (best >> 8 & 255).astype(np.int64) - size, 256 - (best & 255).astype(np.int64) - size


def matched_characters(a: list[str], b: list[str]):
    """Characters that Ratcliff-Obershelp matches, for many pairs of non-empty texts at once: the longest common block, then the same left and right of it."""
    import numpy as np
    from difflib import SequenceMatcher

    found = np.zeros(len(a), np.int64)
    widths = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    for at in np.flatnonzero(widths >= JUNK_FROM):
        found[at] = sum(m.size for m in SequenceMatcher(None, a[at], b[at]).get_matching_blocks())
    order = np.flatnonzero(widths < JUNK_FROM)
    order = order[np.argsort(widths[order], kind="stable")]
    for start in range(0, len(order), 4096):
        rows = order[start : start + 4096]
        left, right = [a[r] for r in rows], [b[r] for r in rows]
        x, y, sums = _points(left, 0xFFFFFFFF), _points(right, 0xFFFFFFFE), np.zeros(len(rows), np.int64)
        part = (np.arange(len(rows)), np.zeros(len(rows), np.int64), np.array([len(t) for t in left]), np.zeros(len(rows), np.int64), np.array([len(t) for t in right]))
        while len(part[0]):
            at, alo, ahi, blo, bhi = part
            cut = lambda points, lo, hi, fill: np.where((k := np.arange((hi - lo).max())[:, None]) < hi - lo, points[np.minimum(lo + k, len(points) - 1), at], np.uint32(fill))  # noqa: E731, B023
            size, i, j = _longest_blocks(cut(x, alo, ahi, 0xFFFFFFFF), cut(y, blo, bhi, 0xFFFFFFFE))
            sums += np.bincount(at, size, len(rows)).astype(np.int64)
            i, j = alo + i, blo + j
            sides = [np.concatenate(c) for c in ((at, at), (alo, i + size), (i, ahi), (blo, j + size), (j, bhi))]
            open_ = (np.concatenate((size, size)) > 0) & (sides[1] < sides[2]) & (sides[3] < sides[4])
            part = tuple(c[open_] for c in sides)
        found[rows] = sums
    return found


def _ratios(a: list[str], b: list[str]):
    """Ratcliff-Obershelp similarity of non-empty texts: twice the matched characters by the characters of both."""
    import numpy as np

    return 2.0 * matched_characters(a, b) / np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of the two matters."""
    out, held = pd.Series(0.0, index=a.index), a.fillna("").ne("") & b.fillna("").ne("")
    if held.any():
        out[held] = _ratios(a[held].tolist(), b[held].tolist())
    return out


def _met_before(a: list[str], b: list[str], keys: list[str | None]):
    """Whether a pair of texts that miss a character each also meets in a key other than the one given, and that other one counts.

    The texts differ from place p to place q.  What is left of both is one text without its character p and the other without q, or the
    other way round; both hold where the stretch alternates.  Then the key without p of the first text counts.
    """
    import numpy as np

    out = np.zeros(len(a), bool)
    asked = [k for k, key in enumerate(keys) if key is not None and len(a[k]) == len(b[k])]
    if not asked:
        return out
    x, y = _points([a[k] for k in asked], 0), _points([b[k] for k in asked], 0)
    width = max(len(x), len(y))
    apart = x != y
    p, q = apart.argmax(axis=0), width - 1 - apart[::-1].argmax(axis=0)
    place = np.arange(width - 1)[:, None]
    other = ((x[1:] != y[:-1]) | (x[:-1] != y[1:])) & (place >= p) & (place < q)
    for k in np.flatnonzero((q > p) & ~other.any(axis=0)):
        out[asked[k]] = keys[asked[k]][p[k]] == a[asked[k]][p[k]]
    return out


def similar_of(pairs: DataFrame, least: float) -> DataFrame:
    """(value, other), in both orders, where the ratio of that order is ``least`` or more, of candidates (value, other, key); the key is null for pairs that come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            once = ~_met_before(a, b, batch.column(2).to_pylist())
            there, back = pa.array(once & (_ratios(a, b) >= least)), pa.array(once & (_ratios(b, a) >= least))
            for first, second, held in ((0, 1, there), (1, 0, back)):
                yield pa.RecordBatch.from_arrays([batch.column(first).filter(held), batch.column(second).filter(held)], ["value", "other"])

    return pairs.select("value", "other", "key").mapInArrow(run, "value string, other string")


#: Characters that titles of up to DELETED_FROM characters may miss for candidates to meet in what is left of both.
DELETED, DELETED_FROM = 2, 29
#: Longer titles of up to so many characters meet in segments, those beyond in bigrams.
SEGMENTED = 100


def segments(n: int, m: int, matched: int) -> tuple[list[tuple], list[tuple]]:
    """Keys (segment, start, length, place left out or -1) by which a text of ``n`` characters meets one of ``m`` that has ``matched`` of them in the same order: those of the first, of the second.

    One text becomes the other by n - matched deletions and m - matched insertions.  The first is cut in so many segments that not all have
    two of these.  Going from the left there is a first segment i by which fewer than two a segment have occurred: it has
    c + own <= 1 where 2 * i + c occurred before it, so it stands in the other text at few places, whole, with a character less or with one more.
    """
    gone, come = n - matched, m - matched
    count = (gone + come) // 2 + 1
    first, second = set(), set()
    for i in range(count):
        lo, hi = n * i // count, n * (i + 1) // count
        size = hi - lo
        first |= {(i, lo, size, j) for j in range(-1, size)}
        for c in (0, 1) if i else (0,):
            for deleted in range(max(0, 2 * i + c - come), min(2 * i + c, gone) + 1):
                inserted = 2 * i + c - deleted
                at = lo + inserted - deleted
                second.add((i, at, size, -1))
                if c == 0 and inserted < come:
                    second |= {(i, at, size + 1, j) for j in range(size)}
                if c == 0 and deleted < gone:
                    second.add((i, at, size - 1, -1))
    return sorted(first), sorted(k for k in second if k[1] >= 0 and k[1] + k[2] <= m)


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segment_keys(points, keys: list[tuple], salt: int):
    """The hash of each key's characters, of texts of one length whose code points are columns: a row a text."""
    import numpy as np

    step, own = np.uint64(0x9E3779B97F4A7C15), points.astype(np.uint64)
    out = np.empty((points.shape[1], len(keys)), np.uint64)
    for k, (i, at, size, left_out) in enumerate(keys):
        found = np.full(points.shape[1], salt * 1024 + i, np.uint64)
        for place in range(size):
            if place != left_out:
                found = _mixed(found * step + own[at + place])
        out[:, k] = found
    return out.view(np.int64)


def by_segments(titles: DataFrame, least: float) -> DataFrame:
    """(value, other), once a pair, of titles (value, n, id) of up to SEGMENTED characters that meet in a segment.

    Of two lengths the one whose keys are fewer in all is cut.  The id may be shared by several titles.
    """
    import numpy as np

    counts = {r["n"]: r["titles"] for r in titles.groupBy("n").agg(F.count("*").alias("titles")).collect()}  # SEGMENTED rows at most
    sides: tuple[dict, dict] = ({}, {})
    for n in counts:
        for m in counts:
            matched = int(np.ceil(least / 2 * (n + m) - 1e-9))
            if m < n or matched > n or (m - matched <= DELETED and m <= DELETED_FROM):
                continue
            ways = [(a, b, *segments(a, b, matched)) for a, b in {(n, m), (m, n)}]
            a, b, first, second = min(ways, key=lambda w: (counts[w[0]] * len(w[2]) + counts[w[1]] * len(w[3]), w[0]))
            sides[0].setdefault(a, []).append((n * (SEGMENTED + 1) + m, first))
            sides[1].setdefault(b, []).append((n * (SEGMENTED + 1) + m, second))

    def keyed(side: dict, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, lengths = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for n, plans in side.items():
                    for rows in np.split(at := np.flatnonzero(lengths == n), range(1024, len(at), 1024)):
                        if not len(rows):
                            continue
                        points = _points(batch.column(0).take(pa.array(rows)).to_pylist(), 0)
                        for salt, keys in plans:
                            found = np.sort(segment_keys(points, keys, salt), axis=1)
                            once = np.ones(found.shape, bool)
                            once[:, 1:] = found[:, 1:] != found[:, :-1]
                            yield pa.RecordBatch.from_arrays([pa.array(found[once]), pa.array(np.repeat(ids[rows], once.sum(axis=1)))], ["key", name])

        return titles.select("value", "id", "n").mapInArrow(run, f"key long, {name} long")

    met = keyed(sides[0], "x").hint("merge").join(keyed(sides[1], "y").hint("merge"), "key").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    named = lambda c, v: titles.select(F.col("id").alias(c), F.col("value").alias(v))
    return met.join(named("x", "value"), "x").join(named("y", "other"), "y").where("x != y OR value < other").select("value", "other")


def title_bounds(least: float, a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """For lengths a and b: matched characters that the ratio needs; those that either title may have besides; shared bigrams and edits that follow.

    The matched characters stand in the same order in both, so deleting the others makes both the same.  They fall into blocks that are parted
    by a deleted character of either title, so of their bigrams all but one a gap are shared.
    """
    matched = F.ceil(F.lit(least / 2) * (a + b) - 1e-9).cast("int")
    return matched, F.greatest(a, b) - matched, 3 * matched - a - b - 1, a + b - 2 * matched


def similar_titles(values: DataFrame, least: float = 0.9) -> DataFrame:
    """(value, other): distinct lower-case titles of which ``value``, as the later one, is similar to ``other``.

    Candidates meet by the lengths of both.  Where either may miss at most DELETED characters, both are keyed by what stays without them
    (one title of a pair must give the string that the other gives).  Longer ones of up to SEGMENTED characters meet in ``segments``; those beyond are
    keyed by their rarest bigrams, as many as a pair that shares enough of them can't all miss.  Edits are counted in the JVM up to the bound.  The ratio is taken once a pair, both ways, of
    thousands of pairs at once.  Pairs that meet in several strings are made distinct; those that miss a character each meet in two at most, of which one counts.
    """
    titles = values.where(F.length("value") > 1).select("value", F.length("value").alias("n")).distinct()
    lengths = titles.select(F.col("n").alias("m")).distinct()  # as many as the longest title has characters
    low, high = F.least("n", "m"), F.greatest("n", "m")
    matched, most, shared, _ = title_bounds(least, F.col("n"), F.col("m"))
    own = titles.join(F.broadcast(lengths), F.greatest("n", "m") * least <= F.least("n", "m") * (2 - least) + 1e-9)
    own = own.withColumns({"low": low, "high": high, "gone": F.col("n") - matched, "by_deletion": (most <= DELETED) & (high <= DELETED_FROM), "shared": shared}).where("gone >= 0")

    cut = lambda c, i: F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.lit(DELETED_FROM)))
    once = lambda a: F.transform(F.sequence(F.lit(0), F.length(a) - 1), lambda i: cut(a, i))
    left = F.when(F.col("gone") == 0, F.array("value")).when(F.col("gone") == 1, once(F.col("value"))).otherwise(F.flatten(F.transform(once(F.col("value")), lambda x: once(x))))
    by_deletion = own.where("by_deletion").select("value", "n", "low", "high", F.explode(F.array_distinct(left)).alias("key"))

    some = own.where(~F.col("by_deletion") & (high > SEGMENTED))
    grams = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring(F.col("value"), i, F.lit(2)))
    # equal bigrams are neighbours once sorted, so each gets its number within its run
    runs = lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(g, x) + 1).cast("string")))
    rows = some.select("value").distinct().select("value", F.explode(let(F.array_sort(grams), runs)).alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = rows.join(counts, "gram").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("gs"))
    prefix = F.slice("gs", F.lit(1), F.greatest(F.lit(1), F.size("gs") - F.greatest(F.lit(1), F.col("shared")) + 1).cast("int"))
    by_grams = some.join(ordered, "value").select("value", "n", "low", "high", F.explode(prefix).alias("p")).select("value", "n", "low", "high", F.col("p.gram").alias("key"))

    def met(keyed: DataFrame) -> DataFrame:
        other = keyed.select(F.col("value").alias("other"), F.col("n").alias("m"), "low", "high", "key")
        apart = (F.col("n") != F.col("m")) | (F.col("low") == F.col("high"))  # a title keyed for a length other than its own meets titles of that length
        return keyed.hint("merge").join(other.hint("merge"), ["low", "high", "key"]).where((F.col("value") < F.col("other")) & apart)

    by_key, unkeyed = met(by_deletion), F.lit(None).cast("string").alias("key")
    single = by_key.where(most <= 1).select("value", "other", "key")
    several = by_key.where(most > 1).select("value", "other").distinct()
    _, _, _, edits = title_bounds(least, F.length("value"), F.length("other"))
    # the threshold of the function is a constant; a greater one for longer titles
    near = F.when(edits <= 2 * DELETED, F.levenshtein("value", "other", 2 * DELETED)).otherwise(F.levenshtein("value", "other"))
    cut_up = by_segments(titles.where(F.col("n") <= SEGMENTED).select("value", "n", F.xxhash64("value").alias("id")), least)
    close = met(by_grams).select("value", "other").distinct().unionByName(cut_up).where(near.between(F.lit(0), edits))
    return similar_of(single.unionByName(several.unionByName(close).select("value", "other", unkeyed)), least)


def deduplicate(records: DataFrame) -> DataFrame:
    """The records (pos, canonical_url, content_hash, simhash, title) that a pass in the order of ``pos`` would keep.

    A record goes if one kept before it has its url, its content hash, a simhash within 3 bits or a similar title.  In each
    round, whoever has no undecided earlier neighbour is kept and its later neighbours go; rounds are as many as the
    longest chain of such dependencies; each round decides at least the first open record.  Equal values are keys, never pairs.
    """
    with scratch(records.sparkSession, "deduplicate") as folder:
        records = written(records, "records", folder)
        key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value"))
        title = F.lower(F.coalesce("title", F.lit("")))
        keys = F.array(key("url", F.col("canonical_url")), key("hash", F.nullif("content_hash", F.lit(""))), key("simhash", F.nullif("simhash", F.lit(0))), key("title", F.nullif(title, F.lit(""))))
        rows = written(records.select("pos", F.explode(F.filter(keys, lambda k: k["value"].isNotNull())).alias("k")).select("pos", "k.kind", "k.value"), "keys", folder)
        some = lambda kind: rows.where(F.col("kind") == kind).select("value")
        near = near_simhashes(some("simhash").select(F.col("value").cast("long").alias("value"))).select(F.lit("simhash").alias("kind"), F.col("value").cast("string").alias("value"), F.col("other").cast("string").alias("other"))
        edges = written(near.unionByName(similar_titles(some("title")).select(F.lit("title").alias("kind"), "value", "other")), "edges", folder)

        def earliest(rows: DataFrame) -> DataFrame:
            """Per value the least position of its rows and of its neighbours' rows."""
            own = rows.groupBy("kind", "value").agg(F.min("pos").alias("least"))
            beside = edges.join(own.withColumnRenamed("value", "other"), ["kind", "other"]).select("kind", "value", "least")
            return own.unionByName(beside).groupBy("kind", "value").agg(F.min("least").alias("least"))

        kept, open_ = None, rows
        while True:
            judged = open_.join(earliest(open_), ["kind", "value"]).groupBy("pos").agg(F.min(F.col("least") >= F.col("pos")).alias("first"))
            now = written(judged.where("first").select("pos"), "kept", folder)
            kept = now if kept is None else kept.unionByName(now)
            gone = open_.join(earliest(open_.join(now, "pos", "left_semi")), ["kind", "value"]).where("least <= pos").select("pos").distinct()
            open_ = written(open_.join(gone, "pos", "left_anti"), "open", folder)
            if open_.isEmpty():
                # records without any key have nothing to share
                return written(records.join(kept, "pos", "left_semi").unionByName(records.join(rows.select("pos").distinct(), "pos", "left_anti")), "deduplicated")
