"""Operator 12: personal data, found through disguises and reported in the source's own characters.

Plain e-mail and IP addresses, card and phone numbers are found as they stand (the base).  Then transducers rewrite the text: look-alike
characters to ASCII, written-out ``at`` and ``dot`` of addresses, spelled digits and letters within numbers.
Each is a list of edits (start, end, output); beside the text goes, for every character of it, the range of source
characters that it came from, and edits carry that along.  The same detectors read the rewritten text, and their spans are mapped
back.  What lies within a base span of its kind is that span; the others are added.

A written-out address needs more than a lone ``at``: a bracketed or real @, or a written dot before a known ending ("us at example.com" is
none).  Spelled digits count in runs of four words or more, alone or among digits.

Cases: a null or empty text has no spans; a very long text is read whole, by expressions that stay linear in it; repeated rows, null ids and empty
tables come back as they are; offsets are code points, ends exclusive; further columns are kept, and a new one whose name is taken gets a bar at its end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import free_name, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- plain detectors ----

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A run of digits that fails at its start fails everywhere in it, so it is passed over whole.
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each @ outwards: linear in the text."""
    found, past, at = [], 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        if host:
            start = at
            while start > past and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, host.end()))
                past = host.end()
        at = text.find("@", max(at + 1, past))
    return found


def ips(text: str) -> list[Span]:
    small = lambda x: len(x := x.lstrip("0")) <= 3 and int(x or 0) <= 255
    return [m.span() for m in IP.finditer(text) if m[1] and all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    own = [int(d) for d in digits[::-1]]
    return (sum(own[0::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# ---- transducers: text to edits (start, end, output), ascending and apart ----

Edit = tuple[int, int, str]

# Cyrillic and Greek letters that look like Latin ones, dashes and dots that compatibility forms leave.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw")) | dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι", "ABEZHIKMNOPTYXovi")) | dict(zip("‐‑‒–—―−。｡٫", "-------..."))
INVISIBLE = "".join(map(chr, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]))


def _folds() -> dict[int, str]:
    """Characters whose compatibility form is one ASCII character or that are digits of any script, and the look-alikes."""
    found = {}
    for x in [*range(0x80, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)]:
        c = chr(x)
        form, digit = unicodedata.normalize("NFKC", c), unicodedata.digit(c, None)
        if len(form) == 1 and " " <= form <= "~":
            found[x] = form
        elif digit is not None:
            found[x] = str(digit)
    return found | {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(a): "" for a in INVISIBLE}


FOLDS = _folds()
#: Those of the first plane, and any character beyond it.
FOLDED = re.compile("[" + "".join(chr(x) for x in FOLDS if x < 0x10000) + "]"), re.compile("[\U00010000-\U0010ffff]")

# How an at sign, a dot, a plus sign and digits are written out.
AT, DOT, PLUS = "at|arroba", "dot|point|punkt|punto", "plus|más"
DIGITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES = {"double": 2, "triple": 3}
DOT_WORDS = frozenset(DOT.split("|"))
ENDINGS = "com|org|net|edu|gov|mil|info|biz|io|co|uk|de|fr|es|eu|ca|au|ch|nl|dev|app|ai|example|test|invalid|local"

OPEN, SHUT, LABEL = r"[\[({<]{1,2}\x20{0,3}", r"\x20{0,3}[\])}>]{1,2}", "[A-Za-z0-9-]++"
SURE_DOT = rf"(?:\x20{{0,3}}{OPEN}(?:\.|{DOT}){SHUT}\x20{{0,3}})"
WRITTEN_DOT = rf"(?:\x20{{1,3}}(?:{DOT})\x20{{1,3}}|_(?:{DOT})_)"
ANY_DOT = re.compile(rf"{SURE_DOT}|{WRITTEN_DOT}", re.I)
SURE_AT = re.compile(rf"{OPEN}(?:@|{AT}){SHUT}|@", re.I)
WRITTEN_AT = re.compile(rf"\x20{{1,3}}(?:{AT})\x20{{1,3}}|_(?:{AT})_", re.I)
HOST_WRITTEN = re.compile(rf"{LABEL}(?:(?:\.|{SURE_DOT}|{WRITTEN_DOT}){LABEL})+", re.I)
HOST_DOT = re.compile(rf"\.|(?P<sure>{SURE_DOT})|(?P<written>{WRITTEN_DOT})", re.I)
LOCAL_WRITTEN = re.compile(rf"[A-Za-z0-9._%+-]+(?:(?:{SURE_DOT}|{WRITTEN_DOT})[A-Za-z0-9._%+-]+)*\Z", re.I)
KNOWN_END = re.compile(ENDINGS, re.I)
#: What a text with written dots has, lower-cased: cheaper to look for than the expressions.
DOT_SIGNS = (*DOT.split("|"), *(a + b + "." for a in "[({<" for b in ("", " ")))
#: "at the dot com office" names no host.
ARTICLE = re.compile(r"(?:the|an?|this|that|my|our|your|his|her|its|their)\b", re.I)
#: Characters before an at sign that are searched for written dots of the name.
NAME = 128

_NUMBER = "|".join(sorted(DIGITS, key=len, reverse=True))
_WORD = rf"(?:(?:{'|'.join(TIMES)})[\x20-])?(?:{_NUMBER})"
RUN = re.compile(rf"\b(?:(?:{PLUS})[\x20,-]{{1,3}})?{_WORD}(?:[\x20,-]{{1,3}}(?:{_WORD}|{DOT}|[0-9]{{1,4}})(?!\w))+", re.I)
TOKEN = re.compile(rf"(?P<times>{'|'.join(TIMES)})|(?P<number>{_NUMBER})|(?P<dot>{DOT})|(?P<plus>{PLUS})|(?P<digits>[0-9]+)|(?P<gap>[\x20,-]+)", re.I)
DOT_OF_NUMBERS = re.compile(rf"(?<=[0-9])(?:{SURE_DOT}|\x20{{1,3}}(?:{DOT})\x20{{1,3}})(?=[0-9])", re.I)
PLUS_OF_NUMBERS = re.compile(rf"(?<!\w)(?:(?:{PLUS})\x20{{1,2}}|[\[(]\x20?(?:\+|{PLUS})\x20?[\])]\x20?)(?=\(?[0-9])", re.I)
NEAR_LETTERS = re.compile("[0-9][OoIl|]|[OoIl|][0-9]")
LETTERS = re.compile(r"(?<![0-9A-Za-z|])(?=[0-9OoIl|]*[0-9])[0-9OoIl|]{2,}(?![0-9A-Za-z|])")
AS_DIGITS = str.maketrans("OoIl|", "00111")


def fold_characters(text: str) -> list[Edit]:
    """Look-alikes to ASCII; invisible characters to nothing."""
    if text.isascii():
        return []
    return sorted((m.start(), m.end(), FOLDS[ord(m.group())]) for some in FOLDED for m in some.finditer(text) if ord(m.group()) in FOLDS)


def _host(text: str, start: int) -> tuple[list[Edit], str] | None:
    """The edits of the written dots of a host name that begins at ``start``, and the separators' kinds; None where there is no name with a dot.

    A name goes on over a written dot only to a known ending or to a further dot.
    """
    found = HOST_WRITTEN.match(text, start)
    if not found:
        return None
    dots = [(m.lastgroup or "plain", *m.span()) for m in HOST_DOT.finditer(text, start, found.end())]
    end = found.end()
    while dots and dots[-1][0] == "written" and not KNOWN_END.fullmatch(text, dots[-1][2], end):
        end = dots.pop()[1]
    return ([(a, b, ".") for kind, a, b in dots if kind != "plain"], text[dots[-1][2] : end]) if dots else None


def undo_at_and_dot(text: str) -> list[Edit]:
    """Written-out at signs and dots of addresses; the marks in number groups and before phone numbers."""
    low = text.lower()
    dotted = any(x in low for x in DOT_SIGNS) and ANY_DOT.search(text) is not None
    edits = [(*m.span(), ".") for m in DOT_OF_NUMBERS.finditer(text)] if dotted else []
    if any(x in low for x in ("plus", "más", "(+", "[+", "( +", "[ +")):
        edits += [(*m.span(), "+") for m in PLUS_OF_NUMBERS.finditer(text)]
    marks = [(*m.span(), True) for m in SURE_AT.finditer(text)] + ([(*m.span(), False) for m in WRITTEN_AT.finditer(text)] if dotted else [])
    for start, end, sure in marks:
        plain = text[start:end] == "@"
        while sure and start and text[start - 1] == " ":
            start -= 1
        while sure and text[end : end + 1] == " ":
            end += 1
        host = _host(text, end)
        if not host or not sure and not (host[0] and KNOWN_END.fullmatch(host[1]) and not ARTICLE.match(text, end)):
            continue
        low_end = max(0, start - NAME)
        name = LOCAL_WRITTEN.search(text[low_end:start])
        if not name:
            continue
        own = [(low_end + name.start() + d.start(), low_end + name.start() + d.end(), ".") for d in ANY_DOT.finditer(name.group())] if dotted else []
        if own or host[0] or not plain or end - start > 1:
            edits += [*own, (start, end, "@"), *host[0]]
    return apart(edits)


def _spelled(text: str) -> bool:
    """Whether two words of a run of spelled digits stand beside each other."""
    words = text.lower().replace("-", " ").replace(",", " ").split()
    beside = lambda w: w in DIGITS or w in TIMES or w.isdigit() or w in DOT_WORDS
    return any(w in DIGITS and (beside(words[i - 1]) or i + 1 < len(words) and beside(words[i + 1])) for i, w in enumerate(words))


def undo_spelled_digits(text: str) -> list[Edit]:
    """Digits in words, in runs of four or more, and letters among digits."""
    edits = []
    for run in RUN.finditer(text) if _spelled(text) else ():
        tokens = [(m.lastgroup, m.group().lower(), run.start() + m.start(), run.start() + m.end()) for m in TOKEN.finditer(run.group())]
        if sum(kind == "number" for kind, *_ in tokens) < 3 or sum(kind in ("number", "digits") for kind, *_ in tokens) < 4:
            continue
        times, begun = 1, None
        for kind, word, start, end in tokens:
            if kind == "times":
                times, begun = TIMES[word], start
            elif kind == "number":
                edits.append((start if begun is None else begun, end, str(DIGITS[word]) * times))
                times, begun = 1, None
            elif kind != "digits" and begun is None:
                edits.append((start, end, {"dot": ".", "plus": "+"}.get(kind, "")))
    if NEAR_LETTERS.search(text):
        edits += [(*m.span(), m.group().translate(AS_DIGITS)) for m in LETTERS.finditer(text) if not m.group().isdigit()]
    return apart(edits)


TRANSDUCERS = (fold_characters, undo_at_and_dot, undo_spelled_digits)


def apart(edits: list[Edit]) -> list[Edit]:
    """The edits in order, each beginning where the one before has ended or later; of overlapping ones the first stays."""
    kept, past = [], 0
    for edit in sorted(edits):
        if edit[0] >= past:
            kept.append(edit)
            past = edit[1]
    return kept


class Rewritten:
    """A text and, for every character, the range of source characters that it came from."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def apply(self, edits: list[Edit]) -> None:
        if not edits:
            return
        if self.starts is None:
            self.starts = np.arange(len(self.text))
            self.ends = self.starts + 1
        texts, starts, ends, past = [], [], [], 0
        for start, end, out in edits:
            texts += (self.text[past:start], out)
            starts.append(self.starts[past:start])
            ends.append(self.ends[past:start])
            if len(out) == end - start:  # character by character
                starts.append(self.starts[start:end])
                ends.append(self.ends[start:end])
            else:
                starts.append(np.full(len(out), self.starts[start]))
                ends.append(np.full(len(out), self.ends[end - 1]))
            past = end
        self.text = "".join([*texts, self.text[past:]])
        self.starts, self.ends = np.concatenate([*starts, self.starts[past:]]), np.concatenate([*ends, self.ends[past:]])

    def source(self, span: Span) -> Span:
        return (int(self.starts[span[0]]), int(self.ends[span[1] - 1]))


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, plain, what it says) of a text, by kind, start and end."""
    found, own = [], Rewritten(text)
    for transducer in TRANSDUCERS:
        own.apply(transducer(own.text))
    for kind in KINDS:
        plain = DETECTORS[kind](text)
        spans = {s: (True, text[s[0] : s[1]]) for s in plain}
        if own.starts is not None:
            firsts = [s[0] for s in plain]
            for s in DETECTORS[kind](own.text):
                start, end = own.source(s)
                i = np.searchsorted(firsts, start, side="right") - 1
                if i < 0 or plain[i][1] < end:
                    spans.setdefault((start, end), (False, own.text[s[0] : s[1]]))
        found += [(kind, *s, *spans[s]) for s in sorted(spans)]
    return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("plain", T.BooleanType()), T.StructField("value", T.StringType())]))
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("plain", pa.bool_()), ("value", pa.string())]))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pii array<struct<kind, start, stop, plain, value>>: spans of the text's code points, whether they need no rewriting, and the data itself."""
    out = free_name(docs, "pii")
    names = ("kind", "start", "stop", "plain", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            spans = [[dict(zip(names, s)) for s in find(t)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, SPAN_TYPE)], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SPANS)]))


def masked(found: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """``found`` (from ``find_pii``) with each span of the text replaced by its kind in angle brackets; overlapping ones by that of the first."""
    # spans by start; of each, what it adds beyond those before
    order = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("past"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(F.col(text), a + 1, b - a)
    step = lambda s, x: F.when(x["start"] < s["past"], F.struct(F.greatest(s["past"], x["stop"]).alias("past"), s["out"].alias("out"))).otherwise(F.struct(x["stop"].alias("past"), F.concat(s["out"], piece(s["past"], x["start"]), F.lit("<"), x["kind"], F.lit(">")).alias("out")))
    done = F.aggregate(order, state, step, lambda s: F.concat(s["out"], piece(s["past"], F.length(text))))
    return found.withColumn(text, F.when(F.size(pii) > 0, done).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: personal data of every document; n_* count the plain spans, whose list is hashed, ``spans`` lists these and those found by rewriting, and n_added counts the latter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_pii(docs).select("doc_id", "pii", F.filter("pii", lambda s: s["plain"]).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), (F.size("pii") - F.size("base")).cast("long").alias("n_added"))
