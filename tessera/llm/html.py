"""Operator 5: main text of web pages, with a suffix array over each host's other text.

A page is cut into blocks. Those inside its article (or main) element are its text; those inside
menus, headers, footers, sidebars, notices, adverts, forms and comments aren't. On a page without such
an element the rest is undecided: there the host decides. The undecided and unwanted blocks' token
streams of all pages of a host are concatenated, a suffix array finds long substrings that distinct
pages repeat, and of the undecided blocks only the unique runs are kept.

Windows of a stream meet by content-defined anchors and their host, as in ``dedup``, so a host with any
number of pages is spread over tasks.

Defined cases: a null page is empty; a page without text has an empty text; rows with equal pages are
rows of their own and count as one page; unclosed elements end with their parent; an empty table gives
no rows.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import contexts, mix
from tessera.llm.common import checkpointed, table, text_of
from tessera.llm.suffix import SEVERAL, repeated_windows

#: Bytes of token stream that distinct pages must share.
WINDOW = 48
LARGEST_GROUP, PART = 20_000, 1 << 18
#: Comments; the elements whose content is raw text to every browser, up to their end tag or the page's end; declarations; tags.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea|title|noembed|noframes|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
UNWANTED = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "button", "select", "svg", "noscript", "template", "object"}
#: Elements of running text: a class alone doesn't make one inside an article a notice or a list of links.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "span", "em", "strong", "b", "i", "a", "code", "q"}
#: An open element that the start of one of these ends.
ENDED_BY = {"head": BLOCKS, "button": BLOCKS, "select": BLOCKS, "option": BLOCKS, "svg": BLOCKS, "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|nav\w*|menu|breadcrumbs?|sidebar|footer|comments?|disqus|respond|share|social|related|widget|toolbar|search|skip)(?:$|[\s_-])",
    re.I,
)
MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)


#: What an open paragraph or head doesn't reach beyond.
BOUNDARY = {"table", "td", "th", "div", "section", "article", "main", "aside", "blockquote", "body", "form", "li", "ul", "ol"}


def ends_one(name: str, stack: list[tuple[str, bool, bool]]) -> bool:
    """Whether the start of an element ends the innermost open one, itself or as part of one that it ends."""
    for i in range(len(stack) - 1, -1, -1):
        open_ = stack[i][0]
        if name in ENDED_BY.get(open_, ()):
            return True
        if open_ in BOUNDARY:
            return False
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, unwanted) of each block, in page order."""
    found: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, main, unwanted

    def flush() -> None:
        if text:
            joined = "".join(text)
            text.clear()
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                found.append((joined, bool(stack) and stack[-1][1], bool(stack) and stack[-1][2]))

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if any(x[0] == name for x in stack):
                if name in BLOCKS:
                    flush()
                while stack.pop()[0] != name:
                    pass
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            while ends_one(name, stack):
                stack.pop()
        if name in VOID or m[4].endswith("/"):
            continue
        main, unwanted = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        attributes = m[4]
        named = any(NAMES.search(a or b or c or "") for a, b, c in NAMED.findall(attributes)) if attributes else False
        is_main = name in ("article", "main") or bool(attributes and MAIN_ROLE.search(attributes))
        unwanted = unwanted or name in UNWANTED or (name == "header" and not main) or (named and name not in ("body", "html") and not (main and name in PROSE))
        stack.append((name, main or (is_main and not unwanted), unwanted))
    if at < len(page):
        rest = page[at:]
        cut = rest.find("<")  # a tag that the end of the page cuts off
        text.append(rest if cut < 0 else rest[:cut])
    flush()
    return found


def parsed(page: str) -> tuple[list[str], list[bool], str]:
    """The blocks that stay or may stay, which of them are undecided, and the token stream for the host."""
    all_ = blocks(page)
    if any(main and not unwanted for _, main, unwanted in all_):
        kept = [(t, False) for t, main, unwanted in all_ if main and not unwanted]
    else:
        kept = [(t, True) for t, _, unwanted in all_ if not unwanted]
    stream = "\n".join(t for t, undecided in kept if undecided)
    others = "\n".join(t for t, main, unwanted in all_ if unwanted or (not main and not any(u for _, u in kept)))
    return [t for t, _ in kept], [u for _, u in kept], stream + "\n\n" + others if stream or others else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def unique_runs(texts: list[str], undecided: list[bool], spans: list[tuple[int, int]]) -> list[str]:
    """The blocks without what the spans (of bytes of the stream) cover of the undecided ones."""
    if not spans:
        return texts
    out, at = [], 0
    for t, u in zip(texts, undecided, strict=True):
        if not u:
            out.append(t)
            continue
        raw = t.encode()
        keep = np.ones(len(raw), bool)
        for a, b in spans:
            keep[max(0, a - at) : max(0, b - at)] = False
        at += len(raw) + 1
        if keep.all():
            out.append(t)
            continue
        words, place, run = t.split(" "), 0, []
        for w in words:  # a token goes if it is covered whole
            size = len(w.encode())
            if keep[place : place + size].any():
                run.append(w)
            place += size + 1
        if run:
            out.append(" ".join(run))
    return out


def counted_windows(parts: DataFrame, window: int) -> DataFrame:
    """The covered interval of contexts in groups too large for a task: each window's digest, with the pages that have it."""
    at = parts.select("_hash", "_context", "_part", "_page", F.explode(F.sequence(F.lit(0), F.length("_part") - window)).alias("_at"))
    digest = at.select("_hash", "_context", "_page", "_at", F.md5(F.substring("_part", F.col("_at") + 1, F.lit(window))).alias("_digest"))
    shared = digest.groupBy("_hash", "_digest").agg(F.min("_page").alias("_one"), F.max("_page").alias("_other"), F.max(F.col("_page") == SEVERAL).alias("_several"))
    shared = shared.where("_several or _one <> _other").select("_hash", "_digest")
    return digest.join(shared, ["_hash", "_digest"]).groupBy("_context").agg(F.min("_at").cast("int").alias("_from"), (F.max("_at") + window).cast("int").alias("_to"))


def repeated_in_hosts(streams: DataFrame, window: int) -> DataFrame:
    """Of _key, _host, _stream: for each _key the spans of bytes that another page of the host repeats."""

    def found(frames):
        for frame in frames:
            keys, hosts = frame["_key"].to_numpy(), frame["_host"].to_numpy()
            raw = [s.encode() for s in frame["_stream"]]
            for which, begin, length, key, context in contexts(raw, window):
                here = mix(hosts[which].view(np.uint64))
                yield pd.DataFrame({
                    "_key": keys[which], "_hash": (key.view(np.uint64) ^ here).view(np.int64), "_context": (context.view(np.uint64) ^ here).view(np.int64), "_begin": begin,
                    "_part": [raw[w][b : b + n] for w, b, n in zip(which, begin, length, strict=True)],
                })

    every = streams.mapInPandas(found, "_key long, _hash long, _context long, _begin int, _part binary")
    # equal contexts are one row: which page has them, or that several have, is all that counts
    page = F.when(F.min("_key") == F.max("_key"), F.min("_key")).otherwise(SEVERAL)
    each = checkpointed(every.groupBy("_hash", "_context").agg(page.alias("_page"), F.first("_part").alias("_part")))
    groups = each.groupBy("_hash").agg(F.count(F.lit(1)).alias("_different")).where("_different > 1")

    def compared(frames):
        block: list[tuple] = []
        group: list[tuple] = []
        held = 0

        def flush():
            first, last = repeated_windows([x[2] for x in block], window, [x[0] for x in block], [x[3] for x in block])
            return pd.DataFrame({"_context": [x[1] for x in block], "_from": first, "_to": last + window})[lambda x: x["_from"] >= 0]

        for frame in frames:
            for row in zip(frame["_hash"], frame["_context"], frame["_part"], frame["_page"], strict=True):
                if group and row[0] != group[-1][0]:
                    block += group
                    held += sum(len(x[2]) for x in group)
                    group = []
                    if held >= PART:
                        yield flush()
                        block, held = [], 0
                group.append(row)
        block += group
        if block:
            yield flush()

    parts = each.join(groups, "_hash").select("_hash", "_context", "_part", "_page", "_different")
    small = parts.where(F.col("_different") <= LARGEST_GROUP).drop("_different")
    hits = small.repartition("_hash").sortWithinPartitions("_hash").mapInPandas(compared, "_context long, _from int, _to int")
    if groups.where(F.col("_different") > LARGEST_GROUP).limit(1).count():
        hits = hits.unionByName(counted_windows(parts.where(F.col("_different") > LARGEST_GROUP), window))
    whole = each.where(F.col("_page") == SEVERAL).select("_context", F.lit(0).alias("_from"), F.length("_part").alias("_to"))
    hits = hits.unionByName(whole).groupBy("_context").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    spans = every.select("_key", "_context", "_begin").join(hits, "_context").select("_key", F.struct((F.col("_begin") + F.col("_from")).alias("start"), (F.col("_begin") + F.col("_to")).alias("end")).alias("span"))
    return spans.groupBy("_key").agg(F.collect_set("span").alias("spans"))


def extract(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """The columns keep with text, the page's main text."""
    kept = keep or ["page_id", url]
    read = df.select(*(F.col(c) for c in kept), F.xxhash64(host_of(F.col(url))).alias("_host"), text_of(html).alias("_html")).withColumn("_key", F.xxhash64("_host", "_html"))
    columns = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def parse(frames):
        for frame in frames:
            for at in range(0, len(frame), 256):
                x = frame.iloc[at : at + 256]
                got = [parsed(p) for p in x["_html"]]
                yield x[[*kept, "_host", "_key"]].assign(_blocks=[g[0] for g in got], _undecided=[g[1] for g in got], _stream=[g[2] for g in got])

    pages = checkpointed(read.mapInPandas(parse, f"{columns}, _host long, _key long, _blocks array<string>, _undecided array<boolean>, _stream string"))
    spans = repeated_in_hosts(pages.where("_stream <> ''").select("_key", "_host", "_stream"), window)
    # only pages with undecided blocks need the host's verdict
    open_ = F.exists("_undecided", lambda x: x)
    sure = pages.where(~open_).select(*kept, F.array_join("_blocks", "\n").alias("text"))
    asked = pages.where(open_).select(*kept, "_key", "_blocks", "_undecided").join(spans, "_key", "left").select(*kept, "_blocks", "_undecided", F.col("spans.start").alias("_starts"), F.col("spans.end").alias("_ends"))

    def decide(frames):
        for frame in frames:
            texts = []
            for b, u, s, e in zip(frame["_blocks"], frame["_undecided"], frame["_starts"], frame["_ends"], strict=True):
                texts.append("\n".join(unique_runs(list(b), list(u), [] if s is None else list(zip(s, e, strict=True)))))
            yield frame[kept].assign(text=texts)

    return sure.unionByName(asked.mapInPandas(decide, f"{columns}, text string"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
