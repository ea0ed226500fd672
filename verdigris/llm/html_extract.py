"""Main-text extraction from web pages by tag-path ratios.

A page is read into blocks of text (block-level tags bound them; line breaks inside count as white space), each with
the root-to-leaf path of block-level tags that leads to it. Then

1. per path, the length of text outside links and the punctuation are aggregated and divided by the path's blocks, and
   both ratios are brought between 0 and 1 (x / (x + half));
2. both are smoothed with a Gaussian kernel over the blocks in page order, and averaged again per path;
3. they are fused: the geometric means of own and smoothed ratios are multiplied, and multiplied by a prior for what the
   path leads through (PRIORS: elements for menus, forms, ... count for nothing, class words for the like for little);
4. paths whose fused ratio reaches LEVEL standard deviations of the page's blocks are content.

A heading counts as what it heads: it takes the fused ratio of the best of the next blocks. Nothing but boilerplate is
to be dropped, so short blocks (list items, captions, one-word paragraphs on other paths) are recovered where they lie
under the smallest element that holds all content, or, where only the page's root does, between content blocks of the
same parent. Groups of links alone and blocks with a prior below the page's highest are not recovered. So the ratios choose, and an article
or main element has no say; without any prior they still find the article (figures in the README).

The scanner is linear: quoted attribute values follow HTML's rules; a quote that is never closed ends quoting for the
rest of the page (tags then end at the first >), and a < without any > after it is text. Elements nested deeper than
DEEPEST count as part of the one at that depth; their text stays.

Cases: null html counts as empty and gives an empty text, as does a page of boilerplate alone; unclosed and stray
tags follow HTML's rules for implied ends as far as blocks need them; repeated rows are extracted each; an empty
table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import map_batches

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Standard deviations of the blocks' fused ratios that a path of content reaches.
LEVEL = 1.3
#: Characters and punctuation marks a block at which a ratio is half of its most: a block of ten times as many is no
#: more of an article.
HALF_TEXT, HALF_SIGNS = 150, 1
#: Marks that a path counts as having at least, so text without any is not nothing.
LEAST_SIGNS = 0.1
#: The kernel's spread in blocks, and how far it reaches.
SPREAD, REACH = 0.7, 2
#: Blocks after a heading that may be what it heads.
AHEAD = 3
DEEPEST = 400

# HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul head noscript template iframe button caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
UNSEEN = frozenset("script style noscript template iframe svg math canvas object embed video audio map textarea select option button input head title noembed noframes".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article by their meaning.
ASIDE = frozenset("nav footer aside menu dialog form fieldset legend label".split())
#: Words in class, id or role that say the same; those of HEADS do not where the name also has one of OWN.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer masthead topbar toolbar related recommended recommendations share sharing social newsletter subscribe subscription signup login comment comments disqus respond reply replies toc skip copyright contentinfo complementary search".split())
HEADS = frozenset("header banner masthead".split())
OWN = frozenset("post entry article story content news blog section title chapter".split())
#: Words that say where or how a part is laid out, not what it is about: a name of these and of MARKS alone is a mark, but
#: one with any other word (social-history, share-price) is a topic.
LAYOUT = frozenset("site page main top bottom left right center box bar container wrapper wrap block blocks list lists link links button buttons icon icons item items area zone region col column row grid inner outer panel group set global primary secondary fixed sticky slot unit module component text body form info bg full small large mobile desktop wp js is the author posts articles stories entries chapters sections".split())
#: What an article element may be named to be no article: a reader's comment.
REPLIES = frozenset("comment comments disqus respond reply replies".split())
#: Factors of the fusion: text never shown has none, elements beside the article neither; a class word is but a hint
#: (it may stand on what wraps the whole page).
PRIORS = {"unseen": 0.0, "aside": 0.0, "marked": 0.02}

OPEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a tag: names, and values in quotes only after an equals sign.
REST = re.compile(r"""((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+|=)*+)>""")
PLAIN_REST = re.compile(r"([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
NAMED = frozenset("class id role hidden style aria-hidden".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Element:
    __slots__ = ("tag", "parent", "prior", "path", "depth")

    def __init__(self, tag: str, parent: Element | None, prior: float, path: int):
        self.tag, self.parent, self.prior, self.path = tag, parent, prior, path
        self.depth = parent.depth + 1 if parent else 0


class Block:
    """A run of text without a block-level tag inside; `element` is the block-level element around it."""

    __slots__ = ("parts", "element", "linked", "text")

    def __init__(self, element: Element):
        self.parts, self.element, self.linked, self.text = [], element, 0, ""


def marked(tag: str, value: str) -> bool:
    """Whether a class, id or role names what is no part of an article: by all of its words, not by one of them."""
    if tag in ("body", "html", "main"):
        return False
    for name in value.split():
        words = {w.lower() for w in WORDS.findall(name)}
        if words - MARKS - HEADS - OWN - LAYOUT or (tag == "article" and not words & REPLIES):
            continue
        if words & MARKS - HEADS or (words & HEADS and not words & OWN):
            return True
    return False


def prior_of(tag: str, attributes: str) -> tuple[float, str]:
    """An element's own factor in the fusion, and its name in paths."""
    prior, name = (PRIORS["unseen"] if tag in UNSEEN else PRIORS["aside"] if tag in ASIDE else 1.0), tag
    for found in ATTRIBUTE.findall(attributes) if attributes else ():
        key = found[0].lower()
        if key in NAMED:
            value = found[1] or found[2] or found[3]
            if key in ("class", "id", "role"):
                if prior == 1.0 and marked(tag, value):
                    prior = PRIORS["marked"]
                if key == "class" and value.strip():
                    name = f"{tag}.{value.split()[0]}"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and NOT_SHOWN.search(value)):
                prior = PRIORS["unseen"]
    return prior, name


def tags_of(page: str):
    """(start, end, closing, name, attributes) of each tag; name is None for what is no tag (CDATA's text in attributes)."""
    at, rest = 0, REST
    while (m := OPEN.search(page, at)) is not None:
        start, at = m.span()
        if m[2] is None:
            yield start, at, False, None, m[0][9:].removesuffix("]]>") if m[0].startswith("<![CDATA[") else ""
            continue
        end = rest.match(page, at)
        if end is None and rest is REST:
            rest = PLAIN_REST
            end = rest.match(page, at)
        if end is None:  # no > is left
            return
        at = end.end()
        name = m[2].lower()
        yield start, at, bool(m[1]), name, end[1]
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)


class Reader:
    """Turns the tags and texts of a page into blocks."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.root = self.at = Element("", None, 1.0, 0)
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.links = self.beyond = 0
        self.open: dict[str, int] = defaultdict(int)

    def text(self, raw: str) -> None:
        if self.block is None:
            if not raw or raw.isspace():
                return
            around = self.at
            while around.tag not in BLOCKS and around.parent:
                around = around.parent
            self.block = Block(around)
            # what is hidden inline (a hidden span that begins a block) lowers the block, too
            if self.at.prior < around.prior:
                self.block.element = Element(around.tag, around.parent, self.at.prior, around.path)
            self.blocks.append(self.block)
        plain = html.unescape(raw) if "&" in raw else raw
        self.block.parts.append(plain)
        if self.links:
            self.block.linked += len("".join(plain.split()))

    def close_to(self, target: Element) -> None:
        while self.at is not target:
            self.links -= self.at.tag == "a"
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block = None
        if not self.open[tag]:
            return
        found = self.at
        while found.tag != tag:
            if tag not in BLOCKS and found.tag in BLOCKS:
                return  # a stray end tag of an inline element
            found = found.parent
        self.close_to(found.parent)

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.block is not None:
                self.block.parts.append("\n")
            return
        if tag in BLOCKS:
            self.block = None
        if tag in VOID:
            return
        if tag in ENDS_P and self.open["p"]:
            found = self.at
            while found.tag not in ("p", "td", "th", "li", "div", "article", "section", "body", "button", "table", ""):
                found = found.parent
            if found.tag == "p":
                self.close_to(found.parent)
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag]):
            found, last = self.at, None
            while found.parent and found.tag not in BARRIER[tag]:
                last = found if found.tag in CLOSES[tag] else last
                found = found.parent
            if last is not None:
                self.close_to(last.parent)
        if (attributes.endswith("/") and tag in ("svg", "math")) or self.at.depth >= DEEPEST:
            return
        prior, name = prior_of(tag, attributes)
        if tag == "header" and not (self.open["article"] or self.open["main"]):
            prior = min(prior, PRIORS["aside"])
        path = self.paths.setdefault((self.at.path, name), len(self.paths) + 1) if tag in BLOCKS else self.at.path
        self.at = Element(tag, self.at, min(prior, self.at.prior), path)
        self.open[tag] += 1
        self.links += tag == "a"


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text, in order; text that is never shown has none."""
    reader, position = Reader(), 0
    for start, end, closing, name, rest in tags_of(page):
        if start > position and reader.at.prior > 0:
            reader.text(page[position:start])
        position = end
        if name is None:
            if rest and reader.at.prior > 0:
                reader.text(rest)
        elif closing:
            reader.end(name)
        else:
            reader.begin(name, rest)
    if reader.at.prior > 0:
        reader.text(page[position:])
    for b in reader.blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in reader.blocks if b.text]


def smoothed(values: list[float]) -> list[float]:
    kernel = [math.exp(-((d / SPREAD) ** 2) / 2) for d in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for d, w in zip(range(-REACH, REACH + 1), kernel, strict=True) if 0 <= i + d < len(values)]
        out.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    return out


def by_path(paths: list[int], values: list[float]) -> dict[int, float]:
    """Means of the values by path."""
    total, count = defaultdict(float), defaultdict(int)
    for p, x in zip(paths, values, strict=True):
        total[p] += x
        count[p] += 1
    return {p: total[p] / count[p] for p in total}


def ratios(blocks: list[Block]) -> list[float]:
    """The fused tag-path ratio of each block."""
    paths = [b.element.path for b in blocks]
    shown = [len(b.text) for b in blocks]
    # text within links, white space not counted, as a share of the block
    linked = [min(1.0, b.linked / max(1, len(b.text.replace(" ", "")))) for b in blocks]
    free = [n * (1 - share) for n, share in zip(shown, linked, strict=True)]
    signs = [len(PUNCTUATION.findall(b.text)) * (1 - share) for b, share in zip(blocks, linked, strict=True)]
    fused = [b.element.prior for b in blocks]
    for values, half, least in ((free, HALF_TEXT, 0.0), (signs, HALF_SIGNS, LEAST_SIGNS)):
        own = {p: max(x, least) / (max(x, least) + half) for p, x in by_path(paths, values).items()}
        even = by_path(paths, smoothed([own[p] for p in paths]))
        fused = [f * math.sqrt(own[p] * even[p]) for f, p in zip(fused, paths, strict=True)]
    return fused


def headed(blocks: list[Block], scores: list[float]) -> list[float]:
    """scores, where headings have the best of the blocks that they head."""
    out = list(scores)
    for i, b in enumerate(blocks):
        if b.element.tag in HEADINGS:
            after = []
            for j in range(i + 1, len(blocks)):
                if blocks[j].element.tag not in HEADINGS:
                    after.append(scores[j])
                    if len(after) == AHEAD:
                        break
            out[i] = max([scores[i], *(b.element.prior * s for s in after)])
    return out


def holder_of(blocks: list[Block]) -> Element:
    """The smallest element around all of the blocks."""
    holder = blocks[0].element.parent or blocks[0].element
    for b in blocks[1:]:
        e = b.element
        while e.depth > holder.depth:
            e = e.parent
        while holder.depth > e.depth:
            holder = holder.parent
        while holder is not e:
            holder, e = holder.parent, e.parent
    while holder.tag in HEADINGS or holder.tag in ("p", "li", "td", "th", "tr", "tbody", "pre", "blockquote"):
        holder = holder.parent  # one long paragraph is not the article
    return holder


def under(element: Element, holder: Element) -> bool:
    while element.depth > holder.depth:
        element = element.parent
    return element is holder


def content(blocks: list[Block]) -> list[Block]:
    """The article's blocks."""
    plain = ratios(blocks)
    if not any(plain):
        return []
    mean = sum(plain) / len(plain)
    level = LEVEL * math.sqrt(sum((s - mean) ** 2 for s in plain) / len(plain))
    scores = headed(blocks, plain)
    chosen = [i for i, s in enumerate(scores) if s > 0 and s >= level]
    holder = holder_of([blocks[i] for i in chosen])
    whole = holder.tag in ("", "html", "body")
    parents = {id(blocks[i].element.parent) for i in chosen}
    links: dict[int, list[bool]] = defaultdict(list)
    for b in blocks:
        links[id(b.element.parent)].append(b.linked >= len(b.text.replace(" ", "")))
    picked, out, full = set(chosen), [], max(b.element.prior for b in blocks)
    for i, b in enumerate(blocks):
        group = links[id(b.element.parent)]
        if i in picked or (
            b.element.prior == full
            and not (len(group) > 1 and all(group))
            and under(b.element, holder)
            and (not whole or (chosen[0] < i < chosen[-1] and id(b.element.parent) in parents))
        ):
            out.append(b)
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join([b.text for b in content(blocks_of(page))]) if page else ""


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")), run, SCHEMA)
