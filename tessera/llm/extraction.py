"""Main text of web pages: nearest-URL page differencing, confirmed by the page's own structure."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import take

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes svg math object select button canvas audio video".split())
#: Those that run to the end of the page if they are not closed.
TO_THE_END = frozenset("script style textarea title xmp noscript".split())
CHROME = frozenset("nav header footer aside form menu dialog search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments respond disqus newsletter subscribe signup login share sharing social related recommended widget toolbar".split())
#: Start tags that close an open element of the same family.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table menu nav article main section div body".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Za-z]+")


def _chrome(tag: str, attributes: str) -> bool:
    if tag in CHROME:
        return True
    if not attributes.strip():
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in CHROME_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html") and not CHROME_WORDS.isdisjoint(WORD.findall(value)):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool, bool, bool]]:
    """The page's text blocks in order: ``(text, in page chrome, in an article, in main)``.

    Unclosed elements, stray end tags and a page that breaks off inside a tag are read as browsers read them.
    """
    out: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, bool]] = []
    text: list[str] = []
    at, size = 0, len(html)

    def flush() -> None:
        joined = " ".join(unescape("".join(text)).split())
        text.clear()
        if joined:
            chrome = any(c for _, c in stack)
            names = {n for n, _ in stack}
            out.append((joined, chrome, "article" in names, "main" in names))

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        text.append(html[at:lt])
        follow = html[lt + 1 : lt + 2]
        if follow == "!" or follow == "?":
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            at = size if end < 0 else end + (3 if html.startswith("<!--", lt) else 1)
            continue
        if not (follow.isascii() and follow.isalpha()) and not (follow == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha()):
            if follow == "/" and lt + 2 < size:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text.append("<")
                at = lt + 1
            continue
        found = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not found:
            break  # the page ends inside this tag
        at = found.end()
        closing, tag, attributes = bool(found[1]), found[2].lower(), found[3]
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else size if tag in TO_THE_END else at
            continue
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID or tag == "p":
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            if tag in SIBLINGS:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in SIBLINGS[tag]:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES:
                        break
            stack.append((tag, _chrome(tag, attributes)))
    flush()
    return out


def shared(own: list[str], other: list[str]) -> set[int]:
    """Positions of ``own`` in a longest common subsequence with ``other`` (bit-parallel; lines of one page only are set aside)."""
    common = set(own) & set(other)
    places = [i for i, line in enumerate(own) if line in common]
    lines = [line for line in other if line in common]
    mask: dict[str, int] = {}
    for bit, i in enumerate(places):
        mask[own[i]] = mask.get(own[i], 0) | 1 << bit
    full = (1 << len(places)) - 1
    row, rows = full, []
    for line in lines:
        hit = row & mask[line]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = set(), len(places) - 1, len(lines) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1
        elif j and not rows[j - 1] >> i & 1:
            j -= 1
        else:
            out.add(places[i])
            i, j = i - 1, j - 1
    return out


def main_text(page: list[tuple[str, bool, bool, bool]], mate: list[tuple[str, bool, bool, bool]] | None) -> tuple[str, int]:
    """The text that stays, and how many lines the page shares with its mate.

    Differencing deletes the shared lines. Structure then has the last word: lines of the page's article (or, without
    one, of its main element) come back, as two articles may share a line, and menus, adverts and the like go even where
    each page has its own. Without either element, what neither way deletes stays.
    """
    same = shared([b[0] for b in page], [b[0] for b in mate]) if mate else set()
    at = 2 if any(b[2] and not b[1] for b in page) else 3 if any(b[3] and not b[1] for b in page) else None
    keep = [b[0] for i, b in enumerate(page) if not b[1] and (b[at] if at else i not in same)]
    return "\n\n".join(keep), len(same)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, n_shared)`` for each row of ``pages``.

    Within each host pages are sorted by URL path (then URL, id, html); a page is compared with the neighbour whose path
    has the longer common prefix with its own, the one before at ties. Rows are dealt out by ranges of that order, so a
    host of any size spreads over many tasks; the first and last page of a range also go to the neighbouring ranges, as
    context, so the ranges do not show in the result. A null html counts as empty and gives an empty text; a null URL
    belongs to the host of no name. Repeated rows give repeated results. No rows give no rows.
    """
    url = F.coalesce("url", F.lit(""))
    rows = take(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    order = ("host", "path", "url", "page_id")
    key = F.struct("host", "path", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = rows.select(key.alias("k")).repartitionByRange(parts, F.col("k"))
    ends = light.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("first"), F.max("k").alias("last")).collect()  # a row for each range
    ends = sorted((tuple(r["first"]), tuple(r["last"])) for r in ends)
    firsts, n = [a for a, _ in ends], max(1, len(ends))

    @F.pandas_udf("array<int>")
    def ranges(host: pd.Series, path: pd.Series, url: pd.Series, page: pd.Series) -> pd.Series:
        out = []
        for k in zip(host, path, url, page, strict=True):
            p = max(0, bisect_right(firsts, k) - 1)
            out.append([p] + [p + 1] * (k == ends[p][1] and p + 1 < n) + [p - 1] * (k == ends[p][0] and p > 0))
        return pd.Series(out)

    dealt = rows.withColumn("ps", ranges("host", "path", key["url"], key["page_id"]))
    dealt = dealt.select(F.posexplode("ps").alias("copy", "range"), *("page_id", "url", "html", "host", "path"))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", *order, "html")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64())])

    def run(batches):
        def read():
            for batch in batches:
                for r in batch.to_pylist():
                    yield r, blocks(r["html"])

        def near(a, b):
            return len(commonprefix((a["path"], b["path"])))

        before, current, out = None, None, []
        for after in _chain(read()):
            if current is not None and current[0]["copy"] == 0:
                here = current[0]
                beside = [x for x in (before, after) if x and (x[0]["range"], x[0]["host"]) == (here["range"], here["host"])]
                mate = max(beside, key=lambda x: near(x[0], here), default=None)
                text, n_shared = main_text(current[1], mate and mate[1])
                out.append((here["page_id"], here["url"], text, len(text), n_shared))
            before, current = current, after
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")


def _chain(items):
    """The items, and None after the last."""
    yield from items
    yield None
