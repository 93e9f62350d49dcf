"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a row of words and tags.  Words of content score positive,
words of boilerplate containers and all tags negative, and one linear scan
finds the contiguous region of the highest score.  Boxes of boilerplate within an
open ``article`` or ``main`` count nothing.  The weights come from
labelled pages: those with one ``article`` or ``main`` element, whose words are
labelled inside or outside of it.  Blocks of boilerplate within the region
(asides, adverts, forms, comments) are left out of the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELLED = 2000        # about so many labelled pages, drawn by a hash of the html, give the weights

RAW = set("script style noscript template textarea svg iframe title".split())      # skipped with all they hold
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"[^\s=>\"']*[^\s=>]?(?:\s*=\s*)?")       # a name, with the sign before its value
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

CONTAINERS = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form "
                 "head header html li main menu nav ol section select button summary table tbody td tfoot th thead tr ul "
                 "center".split())
BLOCKS = (CONTAINERS - {"td", "th"}) | set("h1 h2 h3 h4 h5 h6 hgroup hr legend p pre caption option".split())
SPACES = {"br", "td", "th", "wbr"}
OUTSIDE = set("nav footer aside form head button select menu dialog".split())
MARKED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
             "consent notice notices alert popup modal overlay sidebar sidenav rail menu nav navbar navigation breadcrumb "
             "breadcrumbs pagination pager footer masthead topbar header comment comments respond disqus share sharing social "
             "related recommended recommendations newsletter subscribe subscription signup login search widget toolbar "
             "complementary contentinfo".split())
# parts of names that tell about a frame's state, as in "has-sidebar"; headers of these parts are content
FRAME = set("has with without no open layout".split())
HEADED = set("article post entry story content".split())
DEFAULT_WORD = {"content": 1.0, "outside": -1.0, "link": 0.2}
DEFAULT_TAG = -0.3


def markup(page: str):
    """(start, end, name, closes, attributes) of comments (name empty), tags and raw elements (name empty), in order.

    One pass: every character is looked at a bounded number of times, whatever is left open.  Quotes
    count only as a value's; a quote that never closes is an ordinary character.  An unfinished
    tag or comment takes the rest of the page.
    """
    size, at = len(page), 0
    last = {q: page.rfind(q) for q in "\"'"}
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        tag = TAG.match(page, start)
        if not tag:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                end = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                end = size if end < 0 else end + 1
            else:
                at = start + 1                   # a mere character
                continue
            yield start, end, "", False, ""
            at = end
            continue
        at = inner = tag.end()
        while at < size and page[at] != ">":
            if page[at].isspace() or page[at] == "/":
                at += 1
                continue
            m = ATTRIBUTE.match(page, at)
            has_value = m.group().rstrip().endswith("=")
            at = max(m.end(), at + 1)
            if has_value and at < size and page[at] in last and last[page[at]] > at:
                at = page.find(page[at], at + 1) + 1
            elif has_value:
                while at < size and page[at] != ">" and not page[at].isspace():
                    at += 1
        attributes, end = page[inner:at], min(size, at + 1)
        name, closes = tag.group(1).lower(), page[start + 1] == "/"
        if name in RAW and not closes:
            close = RAW_END[name].search(page, end)
            end = close.end() if close else size
            name = ""
        yield start, end, name, closes, attributes
        at = end


def boilerplate(name: str, attributes: str, within_article: bool) -> bool:
    if name in OUTSIDE:
        return True
    if name in ("article", "main", "body", "html"):
        return False
    if name == "header":
        return not within_article
    for groups in NAMES.findall(attributes) if attributes.strip() else ():
        for token in "".join(groups).lower().split():
            parts = set(PART.findall(token))
            marked = parts & MARKED
            if "header" in marked and (within_article or parts & HEADED):
                marked -= {"header"}
            if marked and not parts & FRAME:
                return True
    return False


def events(page: str):
    """Words and tags of a page in order: (is_text, name or text, context, inside_article).

    The context is ``outside`` in a boilerplate container, ``link`` for the words
    of a link, else ``content``.
    """
    stack: list[tuple[str, bool]] = []          # open containers and whether words in them are boilerplate
    opened: Counter = Counter()                 # how many of each name are open
    links = articles = 0
    at = 0
    for start, end, name, closes, attributes in markup(page):
        if start > at:
            flagged = bool(stack) and stack[-1][1]
            kind = "outside" if flagged else "link" if links else "content"
            yield True, page[at:start], kind, articles
        at = end
        if not name:
            continue
        if name == "a":
            links = 0 if closes else 1
        if name in CONTAINERS:
            links = 0
            if not closes:
                opens = name in ("article", "main")
                above = bool(stack) and stack[-1][1] and not opens
                stack.append((name, above or boilerplate(name, attributes, bool(articles))))
                opened[name] += 1
                articles += opens
            elif opened[name]:
                while stack:
                    closed = stack.pop()[0]
                    opened[closed] -= 1
                    articles -= closed in ("article", "main")
                    if closed == name:
                        break
        yield False, name, "outside" if stack and stack[-1][1] else "content", articles
    if at < len(page):
        flagged = bool(stack) and stack[-1][1]
        yield True, page[at:], "outside" if flagged else "content", articles


def counts(page: str | None) -> dict[tuple[str, str], list[int]]:
    """(kind, feature) -> words or tags [outside, inside] the article of a labelled page; none otherwise.

    Tags in boilerplate containers do not count: the words there tell enough, and a
    list in a menu should not speak against lists in articles.
    """
    out: dict = {}
    if not page or len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
        return out
    for is_text, value, context, inside in events(page):
        if not is_text and context == "outside":
            continue
        key = ("word", context) if is_text else ("tag", value)
        out.setdefault(key, [0, 0])[bool(inside)] += len(value.split()) if is_text else 1
    return out


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[tuple[str, str], float]:
    """Weights from a sample of about ``labelled`` pages, all counts being aggregated by Spark.

    Tag names are kept up to 20 characters of the known form, those seen in fewer
    than 20 places are left to the default.
    """
    total = pages.count()
    if not total:
        return {}
    share = min(1.0, labelled / total)
    sample = pages.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def run(batches):
        for batch in batches:
            rows = [(k, f, o, i) for page in batch["html"] for (k, f), (o, i) in counts(page).items()]
            yield pd.DataFrame(rows, columns=["kind", "feature", "outside", "inside"])

    found = (sample.select("html").mapInPandas(run, "kind string, feature string, outside long, inside long")
             .groupBy("kind", "feature").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i"))
            .filter("o + i >= 20 and length(feature) <= 20").orderBy(F.desc(F.col("o") + F.col("i"))).limit(500).collect())
    weights = {}
    for r in found:
        odds = math.log((r.i + 1) / (r.o + 1))
        if r.kind == "word":                     # words of content are positive, of other containers not
            sure = max(-1.0, min(1.0, odds))
            weights["word", r.feature] = min(-0.05, sure) if r.feature == "outside" else max(0.1, sure)
        else:                                    # tags are negative, the more the rarer in articles
            weights["tag", r.feature] = -max(0.1, min(2.0, 1 - odds))
    return weights


def extract(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """Text of the best region: blocks joined by one line feed; null or no positive word: empty."""
    if not page:
        return ""
    row = list(events(page))
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, (is_text, value, context, inside) in enumerate(row):
        if inside and context == "outside":
            continue                             # a box in an article is left out below and ends no region
        if is_text:
            total += len(value.split()) * weights.get(("word", context), DEFAULT_WORD[context])
        else:
            total += weights.get(("tag", value), DEFAULT_TAG)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    blocks, parts = [], []
    for is_text, value, context, _ in row[span[0]:span[1]]:
        if is_text:
            if context != "outside":
                parts.append(entities.unescape(value))
        elif value in BLOCKS:
            blocks.append("".join(parts))
            parts = []
        elif value in SPACES:
            parts.append(" ")
    blocks.append("".join(parts))
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with a column text beside all others but html.

    Null and empty html give an empty text; repeated pages are extracted each;
    an empty table gives an empty result.  An input column named text is replaced.
    """
    weights = learn(pages)

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return pd.Series([extract(page, weights) for page in html], dtype=object)

    return pages.withColumn("text", run("html")).drop("html")
