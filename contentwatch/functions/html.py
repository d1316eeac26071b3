"""HTML pages: one parse per page into a struct of facts, and columns over it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.functions import dates, urls

# Fixed values.
NOISE = "header footer nav navbar menu cookie consent banner sidebar advert ads ad- promo subscribe share social comment related breadcrumb".split()
DROPPED = {"header", "footer", "nav", "aside", "script", "style", "noscript", "form"}
UNWANTED = {"script", "style", "iframe", "nav", "footer", "header", "noscript", "aside", "form"}
UNWANTED_WORDS = "cookie gdpr subscribe newsletter promo banner advertisement copyright related recommend popular trending author bio about- contact- widget popup modal overlay notification".split()
UNWANTED_NAMES = set("comment comments sidebar nav menu ads ad footer header share social breadcrumb breadcrumbs".split())
CONTAINERS = "post-content entry-content article-content story-content body-content content-body article-body".split()
LABELS = ["published", "published on", "publish date", "published date", "publication date", "date published", "posted", "posted on", "release date", "released", "created", "created on", "first published", "originally published", "updated", "updated:", "last updated", "modified", "modified on", "revised", "edited", "updated at"]
CLASS_HINTS = "header-publish-date publish-date published-date post-date postdate entry-date article-date date-published pubdate date-display byline-date meta-date content-date".split()
META_PROPERTIES = ["article:published_time", "article:modified_time", "og:updated_time"]
META_NAMES = ["publish-date", "publish_date", "publishdate", "pubdate", "date", "dc.date", "dc.date.created", "dc.date.modified", "dc.Date", "sailthru.date", "parsely-pub-date", "datePublished", "dateModified"]
JSONLD_DATES = ["datePublished", "dateCreated", "uploadDate", "dateModified"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCK = {"p", "div", "ul", "ol", "table", "section", "article", "header", "footer", "nav", "aside", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"}

FACTS = (
    "struct<title: string, h1: array<string>, subheadings: int, has_article: boolean, meta: array<struct<kind: string, name: string, content: string>>, lang: string, canonical: string, jsonld: array<string>,"
    " times: array<struct<datetime: string, text: string>>, paragraphs: array<string>, links: array<struct<url: string, text: string>>, feeds: array<string>, images: array<struct<src: string, width: int, height: int>>,"
    " labels: array<string>, hints: array<string>, clean_paragraphs: array<string>, blocks: array<string>, text: string, visible: string, text_chars: int, link_chars: int>"
)


def _tree(html: str):
    """A light element tree: [tag, attributes, children], children being elements or strings."""
    from html.parser import HTMLParser

    root = ["#root", {}, []]
    stack = [root]

    class Builder(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in BLOCK and stack[-1][0] == "p":
                stack.pop()
            elif tag in CLOSES and stack[-1][0] in CLOSES[tag]:
                stack.pop()
            node = [tag, {k: v or "" for k, v in attrs}, []]
            stack[-1][2].append(node)
            if tag not in VOID:
                stack.append(node)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    return

        def handle_data(self, data):
            stack[-1][2].append(data)

    builder = Builder(convert_charrefs=True)
    builder.feed(html)
    builder.close()
    return root


def _walk(node, skip=lambda n: False):
    """Elements in document order, without those that ``skip`` names and what is in them; no recursion."""
    todo = [node]
    while todo:
        n = todo.pop()
        if not isinstance(n, str) and not skip(n):
            yield n
            todo += reversed(n[2])


def _strings(node, skip=lambda n: False):
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            yield n
        elif not skip(n):
            todo += reversed(n[2])


def _text(node, gap: str = " ", skip=lambda n: False) -> str:
    return gap.join(x for s in _strings(node, skip) if (x := s.strip()))


def _named(node) -> str:
    return f"{node[1].get('class', '')} {node[1].get('id', '')}".lower()


def _noise(node) -> bool:
    return node[0] in DROPPED or any(w in _named(node) for w in NOISE)


def _unwanted(node) -> bool:
    own = _named(node)
    return node[0] in UNWANTED or bool(UNWANTED_NAMES & set(own.split())) or any(w in own for w in UNWANTED_WORDS)


def facts(html: str, url: str) -> dict:
    """What the columns of this module need of one page."""
    import json
    import re
    from urllib.parse import urldefrag, urljoin

    root = _tree(html or "")
    out = {k: [] for k in ("h1", "meta", "jsonld", "times", "paragraphs", "links", "feeds", "images", "labels", "hints")}
    out |= {"title": None, "subheadings": 0, "has_article": False, "lang": None, "canonical": None}
    seen_labels, hints = 0, {}
    for n in _walk(root):
        tag, attrs = n[0], n[1]
        if tag == "title" and out["title"] is None:
            out["title"] = _text(n)
        elif tag == "h1":
            out["h1"].append(_text(n, ""))
        elif tag in ("h2", "h3"):
            out["subheadings"] += 1
        elif tag == "meta":
            out["meta"] += [{"kind": k, "name": attrs[k], "content": attrs.get("content", "")} for k in ("property", "name", "http-equiv") if k in attrs]
        elif tag == "html" and out["lang"] is None:
            out["lang"] = attrs.get("lang")
        elif tag == "link":
            rel = attrs.get("rel", "").lower().split()
            if "canonical" in rel and out["canonical"] is None and attrs.get("href"):
                out["canonical"] = attrs["href"]
            if "alternate" in rel and attrs.get("type", "").lower() in ("application/rss+xml", "application/atom+xml", "application/xml", "text/xml") and attrs.get("href"):
                out["feeds"].append(urljoin(url or "", attrs["href"]))
        elif tag == "script" and attrs.get("type", "").lower() == "application/ld+json":
            try:
                data = json.loads("".join(_strings(n)))
            except ValueError:
                continue
            graph = data.get("@graph") if isinstance(data, dict) else None
            blocks = data if isinstance(data, list) else graph if isinstance(graph, list) else [data]
            out["jsonld"] += [json.dumps(b) for b in blocks if isinstance(b, dict)]
        elif tag == "p":
            out["paragraphs"].append(_text(n))
        elif tag == "a" and attrs.get("href"):
            try:
                link = urldefrag(urljoin(url or "", attrs["href"].strip()))[0]
            except ValueError:
                continue
            if link.startswith("http"):
                out["links"].append({"url": link, "text": "".join(_strings(n)).strip() or attrs.get("title", "").strip()})
        elif tag == "img" and attrs.get("src"):
            size = [int(m[0]) if (m := re.match(r"\s*\d{1,9}", attrs.get(k, ""))) else None for k in ("width", "height")]
            out["images"].append({"src": attrs["src"], "width": size[0], "height": size[1]})
        if tag == "time":
            out["times"].append({"datetime": attrs.get("datetime"), "text": _text(n)})
        if tag == "article":
            out["has_article"] = True
        if tag in ("time", "span", "div", "p", "strong", "small", "header", "article", "section") and seen_labels < 300:
            seen_labels += 1
            own = _text(n)
            if own and len(own) <= 120 and any(x in own.lower() for x in LABELS):
                out["labels"].append(own)
        if "class" in attrs or "id" in attrs:
            for hint in CLASS_HINTS:
                if hint in _named(n) and hint not in hints and (own := _text(n)):
                    hints[hint] = own
    out["hints"] = [hints[h] for h in CLASS_HINTS if h in hints]
    out["clean_paragraphs"] = [x for n in _walk(root, _noise) if n[0] == "p" and (x := _text(n, " ", _noise))]
    bare = lambda n: n[0] in ("script", "style", "noscript", "svg", "img", "head")
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    out["text"] = squeeze(_text(root, " ", bare))
    out["visible"] = _text(root, " ", lambda n: n[0] in ("script", "style"))
    kept = list(_walk(root, _unwanted))
    inner = lambda n: "".join(_strings(n, _unwanted)).strip()
    box = next((n for n in kept if n[0] == "article"), None) or next((n for n in kept if n[0] == "main"), None) or next((n for n in kept if n[1].get("itemprop") == "articleBody"), None)
    for name in [] if box else CONTAINERS:
        box = next((n for n in kept if name in _named(n).split()), None)
        if box:
            break
    blocks = [x for n in _walk(box, _unwanted) if n[0] in ("p", "li", "h2", "h3", "h4", "h5", "h6") and len(x := inner(n)) > 10] if box else []
    if len("\n\n".join(blocks)) < 150:
        blocks = [x for n in kept if n[0] == "p" and len(x := inner(n)) > 15]
    if len("\n\n".join(blocks)) < 80:
        blocks = [squeeze("".join(_strings(root, _unwanted)))]
    out["blocks"] = blocks
    plain = lambda n: n[0] in UNWANTED
    count = lambda n: sum(len(re.sub(r"\s+", "", s)) for s in _strings(n, plain))
    body = next((n for n in _walk(root, plain) if n[0] == "body"), root)
    out["text_chars"], out["link_chars"] = count(body), sum(count(n) for n in _walk(body, plain) if n[0] == "a")
    return out


#: Characters of markup, and pages, that a task holds parsed at once; the facts of a page are several times its markup.
PARSED_CHARS, PARSED_PAGES = 1 << 20, 200


def _parts(markup: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches within both bounds, or of one page."""
    import pyarrow.compute as pc

    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(markup), 0).to_pylist()):
        if i > start and (held + n > PARSED_CHARS or i - start == PARSED_PAGES):
            yield start, i - start
            start, held = i, 0
        held += n
    if len(markup):
        yield start, len(markup) - start


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", out: str = "page") -> DataFrame:
    """``pages`` with the struct ``out`` in place of the markup.  Null markup gives an empty page."""
    from pyspark.sql.pandas.types import to_arrow_type

    kept = [f for f in pages.schema.fields if f.name != html]
    facts_type = pages.sparkSession.range(0).select(F.lit(None).cast(FACTS)).schema[0].dataType
    kind = to_arrow_type(facts_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for start, rows in _parts(batch.column(names.index(html))):
                part = batch.slice(start, rows)
                found = [facts(h, u) for h, u in zip(part.column(names.index(html)).to_pylist(), part.column(names.index(url)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(names.index(f.name)) for f in kept], pa.array(found, kind)], [*[f.name for f in kept], out])

    return pages.mapInArrow(run, T.StructType([*kept, T.StructField(out, facts_type)]))


def filled(c: Column) -> Column:
    """Null where only white space."""
    return F.nullif(F.trim(c), F.lit(""))


def meta(page: Column, kind: str, name: str) -> Column:
    """The content of the first meta tag with that name; null for none."""
    return F.try_element_at(F.filter(page["meta"], lambda m: (m["kind"] == kind) & (m["name"] == name)), F.lit(1))["content"]


def first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def page_title(page: Column, order: str = "h1") -> Column:
    """The title, by one of three orders: "h1" (h1, og, title), "og" (og, JSON-LD, h1, title) or "social" (og, twitter, h1, title without the site)."""
    h1, og, title = filled(first(page["h1"])), filled(meta(page, "property", "og:title")), filled(page["title"])
    if order == "h1":
        return F.coalesce(h1, og, title, F.lit("Untitled"))
    if order == "og":
        headline = filled(first(F.filter(F.transform(page["jsonld"], lambda b: F.get_json_object(b, "$.headline")), lambda x: x.isNotNull())))
        return F.coalesce(og, headline, h1, title, F.lit(""))
    return F.coalesce(og, filled(meta(page, "name", "twitter:title")), h1, filled(F.regexp_replace(title, r"\s+[-|]\s+.*$", "")), F.lit("Untitled Article"))


def page_text(page: Column) -> Column:
    return F.array_join(page["clean_paragraphs"], "\n")


def page_text_blocks(page: Column) -> Column:
    return F.array_join(page["blocks"], "\n\n")


def page_metadata(page: Column) -> Column:
    """struct(author, language, description, modified)."""
    author = F.coalesce(filled(meta(page, "name", "author")), filled(meta(page, "property", "article:author")), F.lit(""))
    language = F.coalesce(filled(page["lang"]), filled(meta(page, "http-equiv", "content-language")), filled(meta(page, "name", "language")), F.lit(""))
    description = F.coalesce(filled(meta(page, "name", "description")), filled(meta(page, "property", "og:description")), F.lit(""))
    return F.struct(author.alias("author"), language.alias("language"), description.alias("description"), F.substring(F.coalesce(meta(page, "property", "article:modified_time"), F.lit("")), 1, 10).alias("modified"))


def lead_image(page: Column) -> Column:
    big = F.filter(page["images"], lambda i: i["src"].startswith("http") & (F.coalesce(i["width"], F.lit(150)) >= 150) & (F.coalesce(i["height"], F.lit(150)) >= 150))
    return F.coalesce(filled(meta(page, "property", "og:image")), filled(meta(page, "name", "twitter:image")), first(big)["src"], F.lit(""))


def extract_links(pages: DataFrame, page: str = "page", url: str = "url") -> DataFrame:
    """links(src, dst, anchor, pos): every anchor of every page."""
    return pages.select(F.col(url).alias("src"), F.posexplode(F.col(page)["links"]).alias("pos", "l")).select("src", F.col("l.url").alias("dst"), F.col("l.text").alias("anchor"), "pos")


def _types(block: Column) -> Column:
    one = F.lower(F.get_json_object(block, "$['@type']"))
    return F.coalesce(F.from_json(one, "array<string>"), F.array(one))


def article_signals(page: Column, url: Column) -> Column:
    """struct of the ten signals with word_count, paragraph_count and signal_count."""
    has_type = lambda *names: F.exists(page["jsonld"], lambda b: F.coalesce(F.arrays_overlap(_types(b), F.array(*map(F.lit, names))), F.lit(False)))
    held = lambda kind, name: F.exists(page["meta"], lambda m: (m["kind"] == kind) & (m["name"] == name))
    og = F.coalesce(F.lower(F.trim(meta(page, "property", "og:type"))) == "article", F.lit(False)) | (filled(meta(page, "property", "og:title")).isNotNull() & filled(meta(page, "property", "og:description")).isNotNull())
    dated = held("property", "article:published_time") | held("property", "article:modified_time") | held("name", "datePublished") | F.exists(page["jsonld"], lambda b: F.coalesce(filled(F.get_json_object(b, "$.datePublished")), filled(F.get_json_object(b, "$.dateModified"))).isNotNull())
    body = F.array_join(page["paragraphs"], " ")
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    parts = F.greatest(F.lit(1), F.size(F.split(body, r"[.!?]+")))
    n = F.size(page["paragraphs"])
    signals = {
        "jsonld_article": has_type("article"),
        "jsonld_news": has_type("newsarticle", "blogposting", "reportagenewsarticle", "report"),
        "article_tag": page["has_article"],
        "open_graph": og,
        "date_metadata": dated,
        "time_tag": F.exists(page["times"], lambda t: t["datetime"].isNotNull()),
        "heading_structure": (F.size(page["h1"]) == 1) & (page["subheadings"] >= 1),
        "url_structure": urls.url_looks_like_article(url),
        "title_tag": filled(page["title"]).isNotNull(),
        "content_density": (words >= 120) & (n >= 2) & (words / parts).between(8, 40),
    }
    total = sum((F.coalesce(c, F.lit(False)).cast("int") for c in signals.values()), F.lit(0))
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(k) for k, c in signals.items()], words.alias("word_count"), n.alias("paragraph_count"), total.alias("signal_count"))


def classify_article(signals: Column) -> Column:
    """struct(is_article, decision_path): a declared article with a title and 60 words, or at least five signals."""
    strong = (signals["jsonld_article"] | signals["jsonld_news"] | signals["open_graph"]) & signals["title_tag"] & (signals["word_count"] >= 60) & (signals["paragraph_count"] >= 1)
    return F.struct((strong | (signals["signal_count"] >= 5)).alias("is_article"), F.when(strong, "strong_declaration").otherwise("majority_vote").alias("decision_path"))


def date_candidates(page: Column, url: Column, last_modified: Column | None = None, variant: str = "p2") -> Column:
    """The strings that may state a page's date, the most trusted first."""
    stated = lambda k: F.transform(page["jsonld"], lambda b: F.get_json_object(b, f"$.{k}"))
    block_dates = [stated(k) for k in JSONLD_DATES]
    jsonld = F.concat(*block_dates) if variant == "p2" else F.flatten(F.transform(page["jsonld"], lambda b: F.array(*[F.get_json_object(b, f"$.{k}") for k in JSONLD_DATES])))
    metas = F.array(*[meta(page, "property", p) for p in META_PROPERTIES], *[meta(page, "name", n) for n in META_NAMES])
    regex = lambda c: F.coalesce(dates.find_date_text(c), c)
    labelled = F.transform(page["labels"], regex)
    url_text = F.nullif(F.regexp_extract(url, r"(20\d{2}[/_-]\d{1,2}[/_-]\d{1,2})", 1), F.lit(""))
    url_text = F.array(F.regexp_replace(url_text, "[/_]", "-"))
    if variant == "p2":
        time = F.array(first(F.filter(page["times"], lambda t: t["datetime"].isNotNull()))["datetime"])
        head = F.array(dates.find_date_text(F.substring(page["visible"], 1, 3000)))
        return F.concat(jsonld, metas, time, labelled, head, url_text, F.array(last_modified if last_modified is not None else F.lit(None).cast("string")))
    t = first(page["times"])
    time = F.array(F.coalesce(F.nullif(t["datetime"], F.lit("")), t["text"]))
    head = F.array(dates.find_date_text(F.substring(page["visible"], 1, 5000)))
    return F.concat(jsonld, metas, time, F.transform(page["hints"], regex), labelled, head, url_text)


def extract_date(pages: DataFrame, now, page: str = "page", url: str = "url", last_modified: str | None = None, variant: str = "p2", out: str = "published") -> DataFrame:
    """``pages`` with the first candidate that is a date.  Distinct strings of a batch are read once."""
    listed = date_candidates(F.col(page), F.col(url), F.col(last_modified) if last_modified else None, variant)
    clean = F.filter(listed, lambda c: filled(c).isNotNull())
    made = pages.withColumns({"_candidates": clean})
    return made.withColumn(out, dates.first_date(F.col("_candidates"), now)).drop("_candidates")
