"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words. Words score positive, words of links and elements' tags negative, with
weights from labelled pages (those that mark their content with <article> or <main>); words of elements that are
boilerplate by their tag or name score negative, too. An element is charged once, where it opens; elements inside a line
(links, bold, code) cost nothing, so links weigh by their words alone. No tag costs more than MOST_COST words: that a
sample never shows a tag inside content doesn't prove that content has none. One linear scan finds the contiguous region
with the highest sum.

The region then chooses the element. An <article> or <main> that holds the region (at least AGREEMENT of its words; else
the one that holds most of them) is taken whole if its words mostly score positive, whatever short lists or tables the
scan has cut off. Elsewhere the element that agrees with the region to at least AGREEMENT (F-measure of their words)
takes its place; where none does, the region itself is the content, out to the ends of its blocks.
Boilerplate elements inside are left out. A class, id or role names boilerplate only as far as what the element holds
agrees (see ``settle``): wrappers often carry such words to say how the page is laid out, and parts of an article to say
what they are about.

Defined cases: a null or empty page, and one without any word of content, give an empty text. Markup that is never closed
ends with the element around it; a tag that the page's end cuts off is no text. White space, also from character references,
becomes one space inside a block; blocks are joined by an empty line. Equal regions: the first counts. Pages of any length
are read whole, in time that grows with their length. Rows are neither dropped nor merged; extra columns of any name are
ignored. Weights are learned from about ``rows`` pages and kept for the MOST_TAGS commonest tags of at most LONGEST_TAG
letters; any other tag costs ``other``.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import python_batches

#: A tag without attributes, the name of any tag, and one attribute or the tag's end.
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)\s*>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?)""")
RAW = frozenset("script style textarea title noscript template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never content.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas object button select option textarea dialog menu title head".split())
#: Words in class, id or role that mark boilerplate; those of FOREIGN name what readers, advertisers and other pages say.
FOREIGN = "ads? adverts? advertisement promo promoted sponsor(?:ed)? breadcrumbs? comments? reply replies disqus respond cookies? consent gdpr newsletter subscribe signup login share sharing social related recommended".split()
LISTED = [*FOREIGN, *"banner sidebar side menu nav navbar navigation header masthead footer notice alert popup modal overlay widget toolbar pagination pager skip complementary contentinfo search".split()]
#: These name an element only alone: parts of content are called by them beside other words.
ALONE = ("side", "search", "notice", "alert", "banner", "skip")
#: Words that say what kind of part an element is, or where it stands, and nothing of what it is about.
PARTS = "area bar block body box buttons? column container count floating footer form group head heading icons? inner items? left links? list main message outer page panel posts? primary right row secondary section sticky strip tag text thread title top bottom widgets? wrap wrapper".split()
MARKED = re.compile(rf"(?:^|[_-])(?:{'|'.join(w for w in LISTED if w not in ALONE)})(?:$|[_-])", re.I)
#: Heads of articles are not heads of pages.
HEAD = re.compile(r"(?:^|.*[_-])header", re.I)
#: A value of which every part is listed names the element; foreign words also do so beside words for parts.
NAMED = re.compile(rf"(?:{'|'.join(LISTED)})(?:[_-]+(?:{'|'.join(LISTED)}))*", re.I)
BESIDE = re.compile(rf"(?:{'|'.join(LISTED + PARTS)})(?:[_-]+(?:{'|'.join(LISTED + PARTS)}))*", re.I)
ALIEN = re.compile(rf"(?:^|[_-])(?:{'|'.join(FOREIGN)})(?:$|[_-])", re.I)
#: Values that say how a wrapper is laid out or what stands in or beside it.
STATE = re.compile(r"(?:has|no|not|with|without|is)[_-].*|.*[_-](?:open|closed|enabled|disabled)", re.I)
NO, HINT, WEAK, STRONG, OTHERS = range(5)
FIELDS = frozenset("form input select textarea button".split())
CONTENT = ("article", "main")
#: Elements that the region may grow to.
HOLDERS = frozenset(["article", "main", "section", "div", "td", "body"])
#: Least F-measure of the words of an element and of the region that it may stand for.
AGREEMENT = 0.9
CLOSES_P = frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 blockquote pre section article aside header footer nav form hr main figure dl".split())


class Weights:
    """Score of a word, of a word in a link, of a word in a boilerplate element, and of each tag. Without a negative score for them, boilerplate elements are content like others."""

    def __init__(self, word: float = 1.0, tags: dict[str, float] | None = None, other: float = -3.0, boilerplate: float = -0.3, link: float | None = None):
        self.word, self.tags, self.other, self.boilerplate = word, tags or {}, other, boilerplate
        self.link = link if link is not None else -word if other < 0 else word

    def tag(self, name: str) -> float:
        return 0.0 if name in INLINE else self.tags.get(name, self.other)


class Node:
    __slots__ = ("attrs", "begin", "content", "drop", "end", "link", "mark", "name", "parent")

    def __init__(self, name: str, parent: Node | None, begin: int, drop: bool, mark: int = NO, link: bool = False):
        self.name, self.parent, self.begin, self.end, self.drop, self.mark, self.link = name, parent, begin, -1, drop, mark, link


def marked(values: list[str], in_article: bool = False) -> int:
    """How surely the class, id and role of an element mark it as boilerplate."""
    found = NO
    for text in values:
        for value in text.split():
            named = NAMED.fullmatch(value)
            if (named or MARKED.search(value)) and not STATE.fullmatch(value) and not (in_article and HEAD.fullmatch(value)):
                kind = OTHERS if ALIEN.search(value) else STRONG if named else WEAK
                found = max(found, kind if named or BESIDE.fullmatch(value) else HINT)
    return found


def settle(items: list[tuple], nodes: list[Node]) -> None:
    """Drops marked elements with all they hold, unless they hold the page's content.

    A name of listed words and words for parts is a sign. An element whose name only contains a listed word stays if it
    holds an article or main, or most of the page's words. One that is named by listed words needs a main, an article with
    most of the words, or nine tenths of the words; with foreign words the last does not count, as comments may be longer
    than the page. Words of links do not count, as menus are long, too. A name that has words of another kind is only a hint
    (a section on share prices): such an element goes only if half of its words are links, or it holds form fields, and it
    would go by what it holds.
    """
    soft = [x for x in nodes if x.mark and not x.drop]
    if not soft:
        return
    upto, links, fields = [0], [0], [0]
    for (kind, value, drop), linked in zip(items, in_links(items, nodes), strict=True):
        n = 0 if kind != "text" else len(value.split())
        upto.append(upto[-1] + (0 if drop or linked else n))
        links.append(links[-1] + (n if linked else 0))
        fields.append(fields[-1] + (kind == "tag" and value in FIELDS))
    total, gone = upto[-1], 0
    content = [(x.begin, x.name, n) for x in nodes if x.name in CONTENT and not x.drop and (n := upto[x.end] - upto[x.begin])]
    held = [x[0] for x in content]
    large = [x[0] for x in content if x[1] == "main" or 2 * x[2] > total]

    def within(begins: list[int], s: Node) -> bool:
        return bisect_left(begins, s.begin) < bisect_left(begins, s.end)

    for s in soft:
        if s.begin < gone:
            continue
        words, linked = upto[s.end] - upto[s.begin], links[s.end] - links[s.begin]
        if s.mark <= WEAK:
            keep = within(held, s) or 2 * words > total or s.mark == HINT and linked <= words and fields[s.end] == fields[s.begin]
        else:
            keep = within(large, s) or s.mark == STRONG and 10 * words >= 9 * total > 0
        if not keep:
            gone = s.end
            for i in range(s.begin, s.end):
                items[i] = (*items[i][:2], True)
    for x in nodes[1:]:
        x.drop = x.drop or items[x.begin][2]


def in_links(items: list[tuple], nodes: list[Node]) -> list[bool]:
    """Whether each item stands in a link."""
    out = [False] * len(items)
    done = 0
    for x in nodes:
        if x.link and x.end > done:
            start = max(done, x.begin)
            out[start : x.end] = [True] * (x.end - start)
            done = x.end
    return out


def tag_at(page: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """Name, attributes, whether it closes itself, and end of the tag at a place; the end is -1 where the page ends first."""
    m = NAME.match(page, at)
    name, at, found = m.group(1).lower(), m.end(), {}
    while at < len(page):
        m = ATTRIBUTE.match(page, at)
        if m.group(1):
            return name, found, page[m.end() - 2] == "/", m.end()
        key = m.group(2).lower()
        if key and key not in found:
            found[key] = m.group(3) or m.group(4) or m.group(5) or ""
        at = m.end() if m.end() > at else at + 1
    return name, found, False, -1


def sequence(page: str) -> tuple[list[tuple], list[Node]]:
    """Items in page order: ("tag", name, dropped) where an element opens, ("end", name, dropped), ("text", words as text, dropped); and the elements with their item spans."""
    items: list[tuple] = []
    root = Node("", None, 0, False)
    nodes, here, at, n = [root], root, 0, len(page)
    opened: Counter = Counter()  # names of the elements that are open
    low = None

    def close(node: Node) -> None:
        nonlocal here
        while here is not node.parent:
            here.end = len(items)
            opened[here.name] -= 1
            here = here.parent

    while at < n:
        lt = page.find("<", at)
        if lt != at:
            items.append(("text", page[at : lt if lt >= 0 else n], here.drop))
            if lt < 0:
                break
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?") and c:
            end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        if not NAME.match(page, lt):
            items.append(("text", "<", here.drop))
            at = lt + 1
            continue
        m = BARE.match(page, lt)
        name, attrs, alone, at = (m.group(2).lower(), {}, False, m.end()) if m else tag_at(page, lt)
        if at < 0:  # the page ends inside the tag
            break
        if c == "/":
            if opened[name] > 0:
                node = here
                while node.name != name:
                    node = node.parent
                close(node)
            items.append(("end", name, here.drop))
            continue
        if name in CLOSES_P or name in ("li", "tr", "td", "th", "dt", "dd", "option"):  # an open one of these ends here
            ends = {"p"} if name in CLOSES_P and name != "li" else {name, "p"} | ({"td", "th"} if name in ("tr", "td", "th") else set()) | ({"dt", "dd"} if name in ("dt", "dd") else set())
            node = here
            while any(opened[x] > 0 for x in ends) and (node.name in INLINE or node.name in ends):
                if node.name in ends:
                    close(node)
                    node = here
                else:
                    node = node.parent
        in_article = opened["article"] > 0 or opened["main"] > 0
        drop, mark = here.drop or name in DROPPED and not (name == "header" and in_article), NO
        values = [attrs[k] for k in ("class", "id", "role") if attrs.get(k)] if attrs else []
        if not drop and values and name not in ("html", "body", "article", "main"):
            mark = marked(values, in_article)
        elif not drop and values and name == "article":
            drop = marked(values) == OTHERS
        items.append(("tag", name, drop or mark > HINT and name in VOID))
        if name in VOID or alone and name not in HOLDERS:
            continue
        if name in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at) if len(low) == n else page.find(f"</{name}", at)
            at = n if end < 0 else end
            if end >= 0:
                shut = page.find(">", at)
                at = n if shut < 0 else shut + 1
            continue
        here = Node(name, here, len(items) - 1, drop, mark, name == "a" and "href" in attrs)
        opened[name] += 1
        nodes.append(here)
    while here is not None:
        here.end = len(items)
        here = here.parent
    settle(items, nodes)
    return items, nodes


def scores(items: list[tuple], weights: Weights, linked: list[bool] | None = None) -> list[float]:
    """The score of each item."""
    drop, out = weights.boilerplate < 0, []
    for i, (kind, value, d) in enumerate(items):
        if kind == "text":
            out.append((weights.boilerplate if d and drop else weights.link if linked and linked[i] else weights.word) * len(value.split()))
        else:
            out.append(weights.tag(value) if kind == "tag" else 0.0)
    return out


def best_region(items: list[tuple], weights: Weights, linked: list[bool] | None = None) -> tuple[int, int]:
    """Span of items with the highest sum, by one linear scan; (0, 0) if nothing scores above zero."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, w in enumerate(scores(items, weights, linked)):
        if total <= 0:
            total, start = 0.0, i
        total += w
        if total > best:
            best, span = total, (start, i + 1)
    return span


def grown(items: list[tuple], nodes: list[Node], span: tuple[int, int], weights: Weights, linked: list[bool]) -> tuple[int, int]:
    """The span of the element that the region chooses, else the region out to the ends of its blocks."""
    a, b = span
    drops = weights.boilerplate < 0
    plain, links = [0], [0]  # words that score as content, and words of links
    for (kind, value, drop), link in zip(items, linked, strict=True):
        n = len(value.split()) if kind == "text" and not (drop and drops) else 0
        plain.append(plain[-1] + (0 if link else n))
        links.append(links[-1] + (n if link else 0))
    own = plain[b] - plain[a]
    best, found, most, marks = 0.0, None, 0, None
    for x in nodes:
        if x.name in HOLDERS and x.begin < b and x.end > a and not (x.drop and drops):
            lo, hi = max(a, x.begin), min(b, x.end)
            shared = plain[hi] - plain[lo] + links[hi] - links[lo]
            f = 2 * shared / (plain[b] - plain[a] + links[b] - links[a] + plain[x.end] - plain[x.begin] + links[x.end] - links[x.begin]) if shared > 0 else 0.0
            both, words = plain[hi] - plain[lo], plain[x.end] - plain[x.begin]
            if f > best or f == best and found and x.end - x.begin < found[1] - found[0]:
                best, found = f, (x.begin, x.end)
            # the innermost that holds the region, else the one that holds most of it
            if x.name in CONTENT and drops and weights.word * words + weights.link * (links[x.end] - links[x.begin]) > 0:
                holds = own if both >= AGREEMENT * own else both
                if holds >= most and 2 * holds > own:
                    most, marks = holds, (x.begin, x.end)
    if marks:
        return marks
    if found and best >= AGREEMENT:
        return found
    while a > 0 and (items[a - 1][0] == "text" or items[a - 1][1] in INLINE):
        a -= 1
    while b < len(items) and (items[b][0] == "text" or items[b][1] in INLINE):
        b += 1
    return a, b


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    items, nodes = sequence(page)
    linked = in_links(items, nodes)
    a, b = best_region(items, weights, linked)
    if a == b:
        return ""
    a, b = grown(items, nodes, (a, b), weights, linked)
    blocks, run, keep_all = [], [], weights.boilerplate >= 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for kind, value, drop in items[a:b]:
        if kind != "text":
            if value == "br":
                run.append(" ")
            elif value not in INLINE:
                flush()
        elif not drop or keep_all:
            run.append(value)
    flush()
    return "\n\n".join(blocks)


#: What a tag costs at least and at most, in words: blocks of one word inside the content still count for it, and a list or
#: table inside the content does not cut it. A tag that the sample lacks costs UNSEEN.
LEAST_COST, MOST_COST, UNSEEN = 0.2, 1.5, 0.5
#: Tags that get a weight of their own at most, the commonest of the sample, and letters of their names; all others cost ``other``.
MOST_TAGS, LONGEST_TAG = 300, 40
#: Rows of the counts that are no tags.
WORD_COUNT, LINK_COUNT = " words", " links"


def fit(pages: DataFrame, rows: int = 2000) -> Weights:
    """Weights from about ``rows`` pages, chosen by a hash, that mark their content: how often tags and links stand outside it."""
    good = pages.where(F.col("html").isNotNull() & F.lower("html").rlike("<(article|main)[\\s>]")).select("html", F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_003)).alias("_h"))
    n = good.count()
    if not n:
        return Weights()
    python_batches(pages.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                items, nodes = sequence(page)
                mark = next((x for x in nodes if x.name in CONTENT), None)
                tags: tuple[set, set] = set(), set()
                for i, ((kind, value, drop), link) in enumerate(zip(items, in_links(items, nodes), strict=True)):
                    out = not (mark and mark.begin <= i < mark.end and not drop)
                    if kind == "tag" and value and len(value) <= LONGEST_TAG and not (mark and i == mark.begin):
                        tags[out].add(value)
                    elif kind == "text":
                        c, words = outside if out else inside, len(value.split())
                        c[WORD_COUNT] += words
                        c[LINK_COUNT] += words if link else 0
                inside.update(tags[0])
                outside.update(tags[1])
        names = sorted({*inside, *outside})
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([inside[k] for k in names], pa.int64()), pa.array([outside[k] for k in names], pa.int64())], names=["name", "i", "o"])

    sample = good.where(F.col("_h") < min(1.0, rows / n) * 1_000_003).select("html")
    found = sample.mapInArrow(count, "name string, i long, o long").groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).orderBy(F.desc(F.expr("i + o")), "name").limit(MOST_TAGS).collect()
    return learned({r["name"]: (r["i"], r["o"]) for r in found})


def learned(counts: dict[str, tuple[int, int]]) -> Weights:
    """Weights from counts inside and outside the content: of pages that have a tag there, of words and of words in links.

    A tag costs a word more for each factor of e squared by which more pages have it outside than inside; one page is added
    to either side, so few pages say little. A word of a link scores from minus one to one by the share of links in the
    words outside against that inside.
    """
    (words_i, words_o), (links_i, links_o) = counts.get(WORD_COUNT, (0, 0)), counts.get(LINK_COUNT, (0, 0))
    link = math.log((links_i + 1) / (words_i + 2)) - math.log((links_o + 1) / (words_o + 2))
    costs = {k: 1 + math.log((o + 1) / (i + 1)) / 2 for k, (i, o) in counts.items() if k not in (WORD_COUNT, LINK_COUNT)}
    return Weights(1.0, {k: -min(MOST_COST, max(LEAST_COST, c)) for k, c in costs.items()}, -UNSEEN, link=max(-1.0, min(1.0, link)))


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    python_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py(), weights) for h in b.column("html")]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
