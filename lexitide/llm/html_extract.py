"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree, with
features of ancestor tags and of the text, trained on labelled pages and decoded by Viterbi."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import Batches, named, prepare, task

#: Elements by how they take part in the tree.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video select option textarea button datalist".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
CLOSES_ITSELF = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
HOLDERS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"])}

#: A comment, a declaration, or the beginning of a tag up to its end or its first quote; what is left open goes to the page's end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)(?:>|([\"'])|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split("|")}
_SPECIAL = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label|data-role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_MARK = re.compile(r"\bdata-main=\"([01])\"")
_SAYS = re.compile(r"cookie|subscribe|newsletter|sign up|log ?in|copyright|©|all rights|advert|sponsor|share|comment|reply|read more|related|privacy|accept|search|menu|posted by|follow us|terms", re.I)

_tokens: dict[tuple[str, str], tuple[str, ...]] = {}


def element_features(tag: str, attrs: str) -> tuple[str, ...]:
    """What an element tells about the blocks inside it: its name and the words of its class, id and role."""
    key = (tag, attrs)
    if (got := _tokens.get(key)) is None:
        words = {"t:" + tag}
        if attrs:
            for m in _NAMED.finditer(attrs):
                words.update("c:" + w.lower().rstrip("s") for w in _PART.findall(m[1] or m[2] or m[3] or ""))
            if "hidden" in attrs or "display:none" in attrs.replace(" ", ""):
                words.add("c:unseen")
        got = tuple(sorted(words))
        if len(_tokens) < 20_000:
            _tokens[key] = got
    return got


@dataclass
class Block:
    """A leaf block: its text, the element around it, characters inside links, the label of a labelled page, and the
    features of its ancestors, or their weight if they were weighed."""

    text: str
    tag: str
    loose: bool
    linked: int
    mark: str
    inside: tuple[str, ...] = ()
    weight: float = 0.0


def tag_end(page: str, at: int, known: dict[int, int]) -> int:
    """The place behind the > that ends a tag, from a place outside of quotes on; -1 if a quote stays open. known keeps
    what was found from each > and quote, so a page is walked through once however many tags it leaves open."""
    seen, end = [], -1
    while m := _SPECIAL.search(page, at):
        k = m.start()
        if k in known:
            end = known[k]
            break
        seen.append(k)
        if page[k] == ">":
            end = k + 1
            break
        if (at := page.find(page[k], k + 1) + 1) == 0:
            break
    known.update(dict.fromkeys(seen, end))
    return end


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of each tag in order, comments and the like being tags without a name;
    elements whose content is no markup are one such tag. Time grows in proportion to the page."""
    at, known = 0, {}
    while m := _TOKEN.search(page, at):
        begin, at = m.span()
        name = (m[2] or "").lower()
        attrs = m[3] or ""
        if m[4]:
            end = tag_end(page, at - 1, known)
            if end < 0:  # an open quote: the next > ends the tag
                end = page.find(">", at) + 1 or len(page)
            attrs, at = page[m.start(3) : end - 1], end
        if name in _RAW_END and not m[1]:
            close = _RAW_END[name].search(page, at)
            name, at = "", close.end() if close else len(page)
        yield begin, at, bool(m[1]), name, attrs


def blocks(page: str, weigh: Callable[[str], float] | None = None, marks: bool = False) -> Iterator[Block]:
    """Leaf blocks in page order: runs of text between two block tags, white space made one space, ends trimmed, empty
    ones left out. Tags left open are closed as browsers do; comments, scripts, styles and the head say nothing. marks:
    read the labels of a labelled page, data-main="0" or "1" of the nearest ancestor that has one."""
    # Open block elements: name, features that it brought, weight of all so far, hidden, mark, open inline elements by name.
    stack: list[tuple[str, tuple[str, ...], float, bool, str, dict[str, int]]] = [("#", (), 0.0, False, "", {})]
    where: dict[str, list[int]] = {}  # places in the stack by name
    open_features: dict[str, None] = {}
    links = linked = 0
    buffer: list[str] = []

    def flush() -> Iterator[Block]:
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            name, _, weight, hidden, mark, _ = stack[-1]
            if text and not hidden:
                loose = "t:article" not in open_features and "t:main" not in open_features
                yield Block(text, name, loose, linked, mark, () if weigh else tuple(open_features), weight)
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links
        while len(stack) > i:
            name, brought, _, _, _, inline = stack.pop()
            where[name].pop()
            for x in brought:
                del open_features[x]
            links -= inline.get("a", 0)

    last = lambda names: max((where[n][-1] for n in names if where.get(n)), default=0)
    at = 0
    for begin, end, closing, tag, attrs in tags(page):
        if begin > at:
            buffer.append(page[at:begin])
            linked += (begin - at) * (links > 0)
        at = end
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in INLINE:
            inline = stack[-1][5]
            step = -1 if closing else 1
            if tag not in VOID and inline.get(tag, 0) + step >= 0:
                inline[tag] = inline.get(tag, 0) + step
                links += step * (tag == "a")
            continue
        yield from flush()
        if closing:
            if i := last((tag,)):
                pop_to(i)
            continue
        if tag == "body" and (i := last(("head",))):
            pop_to(i)
        if tag in HOLDERS:  # a new item or cell ends the one before it, and paragraphs in that, inside its own list or table
            while (i := last(CLOSES_ITSELF[tag])) > last(HOLDERS[tag]):
                name = stack[i][0]
                pop_to(i)
                if name != "p":
                    break
        else:  # all others end paragraphs; a paragraph ends one
            while stack[-1][0] == "p":
                pop_to(len(stack) - 1)
                if tag == "p":
                    break
        if tag in VOID:
            continue
        brought = tuple(x for x in element_features(tag, attrs) if x not in open_features)
        open_features.update(dict.fromkeys(brought))
        _, _, weight, hidden, mark, _ = stack[-1]
        if marks and (m := _MARK.search(attrs)):
            mark = m[1]
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, brought, weight + sum(map(weigh, brought)) if weigh else 0.0, hidden or tag in UNSEEN, mark, {}))
    if at < len(page):
        buffer.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    yield from flush()


def block_features(b: Block) -> list[str]:
    """Features of a block: of its ancestors, if they weren't weighed, and of its text."""
    k = len(b.text)
    out = [*b.inside, "n:" + b.tag, "bias"]
    if b.loose:
        out.append("loose")
    out.append(f"len:{min(6, k.bit_length() // 2)}")
    out.append(f"link:{min(3, 4 * b.linked // max(1, k))}")
    if b.text[-1] in ".!?":
        out.append("ends")
    if m := _SAYS.search(b.text):
        out.append(("says:" if k < 400 else "holds:") + m[0].lower().replace(" ", ""))
    return out


#: Names that pages give to their parts, for the labelled pages.
MAIN_NAMES = ("content", "main-content", "post", "post-body", "entry-content", "article-body", "article__content", "story", "story-body", "text", "articleBody", "page-content", "single-post", "post_content", "blog-post")
SIDE_NAMES = {
    "nav": ("nav", "menu", "navbar", "breadcrumbs", "breadcrumb", "main-menu", "site-nav", "pagination", "tabs", "toc-nav", "toolbar", "navigation", "skip-links"),
    "header": ("header", "site-header", "masthead", "topbar", "banner", "branding", "logo"),
    "footer": ("footer", "site-footer", "copyright", "legal", "colophon", "bottom"),
    "aside": ("sidebar", "widget", "related", "related-posts", "recommended", "trending", "popular", "tags", "tag-list", "author-box", "read-more", "side", "rail", "teaser"),
    "notice": ("cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "message", "announcement", "notification", "disclaimer", "paywall"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "banner-ad", "adsense", "commercial", "outbrain"),
    "form": ("newsletter", "subscribe", "search", "login", "signup", "search-form", "contact-form", "comment-form"),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "discussion", "responses", "disqus", "replies", "feedback", "commentlist"),
    "share": ("share", "social", "share-buttons", "social-links", "sharing"),
}
_SYLLABLES = "an en er on th he in re ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur que ción eau ung sch ö ü é ê ñ á ß zu ge ver lich mente ado tion aux".split()


def _words(r: random.Random, n: int) -> str:
    style = r.random()
    end = r.choice(["***", "&amp;&amp;&amp;", "$$$", "!!", " |"]) if style < 0.15 else ""
    words = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    words = [w.upper() if 0.15 < style < 0.22 else w.title() if r.random() < 0.1 else w for w in words]
    return " ".join(w + (end or ("." if r.random() < 0.1 else "," if r.random() < 0.05 else "")) for w in words) + ("." if r.random() < 0.7 else "")


def labelled_page(r: random.Random) -> str:
    """A page made by chance whose elements tell by data-main whether their text belongs to the article."""
    inline = lambda s: s if r.random() < 0.6 else re.sub(r"(\S+)", lambda m: f"<{(t := r.choice(['b', 'i', 'em', 'span', 'strong', 'a']))}>{m[1]}</{t}>" if r.random() < 0.08 else m[1], s)
    lengths = lambda: int(min(400, 1 + r.expovariate(1 / r.choice([4, 20, 60, 120]))))
    links = lambda n: "".join(f"<li><a href='/{i}'>{_words(r, r.randint(1, 3))}</a></li>" for i in range(n))

    def side(kind: str) -> str:
        name = r.choice(SIDE_NAMES[kind])
        tag = {"nav": ["nav", "div", "ul", "nav"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "aside": ["aside", "div", "section", "aside"], "form": ["form", "div", "form"], "comments": ["section", "div", "ol", "ul"]}.get(kind, ["div", "section", "aside", "p", "div"])
        tag = r.choice(tag)
        attr = f" {r.choice(['class', 'id', 'class'])}=\"{r.choice(['', '', 'x ', 'wrap '])}{name}{r.choice(['', '', ' box', ' col-2'])}\"" if tag in ("div", "section", "ul", "ol", "p") or r.random() < 0.5 else ""
        if kind == "nav" or kind == "share":
            body = f"<ul>{links(r.randint(2, 7))}</ul>" if r.random() < 0.7 else "".join(f"<a href='#'>{_words(r, 1)}</a> " for _ in range(r.randint(2, 6)))
        elif kind == "footer":
            body = r.choice(["&copy; ", "© ", "Copyright ", ""]) + _words(r, r.randint(2, 20)) + (f"<ul>{links(3)}</ul>" if r.random() < 0.3 else "")
        elif kind == "form":
            body = f"<label>{_words(r, 2)}</label><input name='q'><p>{_words(r, r.randint(3, 15))}</p><button>{_words(r, 1)}</button>"
        elif kind == "comments":
            item = r.choice(["div", "li", "article", "p"])
            body = f"<h3>{_words(r, 2)}</h3>" * (r.random() < 0.6) + "".join(f"<{item} class=\"{r.choice(['comment', 'comment-body', 'reply', 'c'])}\">{r.choice(['<b>' + _words(r, 1) + '</b> ', ''])}{r.choice(['<p>', ''])}{_words(r, lengths())}</{item}>" for _ in range(r.randint(1, 5)))
        elif kind == "header":
            body = f"<h{r.choice('123')}>{_words(r, r.randint(1, 4))}</h1>" if r.random() < 0.5 else f"<p>{_words(r, r.randint(1, 10))}</p>"
        else:
            body = r.choice(["", f"<h3>{_words(r, 2)}</h3>"]) + r.choice(["<p>", "", "<span>"]) + _words(r, lengths()) + (f"<ul>{links(r.randint(2, 5))}</ul>" if kind == "aside" and r.random() < 0.5 else "")
        if tag == "p":
            body = re.sub(r"<[^>]*>", " ", body)
        return f'<{tag}{attr} data-main="0">{body}</{tag}>'

    def part() -> str:
        k = r.random()
        if k < 0.62:
            return f"<p>{inline(_words(r, lengths()))}" + "</p>" * (r.random() < 0.85)
        if k < 0.7:
            return f"<h{r.choice('234')}>{_words(r, r.randint(1, 8))}</h2>"
        if k < 0.78:
            return "<ul>" + "".join(f"<li>{inline(_words(r, r.randint(2, 20)))}" + "</li>" * (r.random() < 0.8) for _ in range(r.randint(1, 5))) + "</ul>"
        if k < 0.83:
            return f"<blockquote>{_words(r, lengths())}</blockquote>"
        if k < 0.87:
            return "<table>" + "".join(f"<tr><td>{_words(r, 2)}<td>{_words(r, 3)}" for _ in range(3)) + "</table>"
        if k < 0.9:
            return f"<pre>{_words(r, lengths())}</pre>"
        if k < 0.93:
            return f"<figure><img src=x><figcaption>{_words(r, 6)}</figcaption></figure>"
        return f"<{(t := r.choice(['div', 'section']))}>{inline(_words(r, lengths()))}</{t}>"

    parts = [f"<h1>{_words(r, r.randint(1, 10))}</h1>"] * (r.random() < 0.8) + [part() for _ in range(r.randint(1, 12))]
    if r.random() < 0.3:
        parts.insert(r.randint(0, len(parts)), side(r.choice(["ad", "share", "aside", "notice", "form"])))
    if r.random() < 0.15:
        parts.append(side("comments"))
    if r.random() < 0.1:
        parts.insert(0, side("nav"))
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    attr = f" {r.choice(['class', 'id'])}=\"{r.choice(MAIN_NAMES)}\"" if tag in ("div", "section") or r.random() < 0.3 else ""
    article = f'<{tag}{attr} data-main="1">{"".join(parts)}</{tag}>'
    if r.random() < 0.3:
        article = f"<{r.choice(['main', 'div'])}>{article}</main>"
    before = [side(r.choice(["nav", "header", "nav", "ad", "notice", "form", "share", "aside"])) for _ in range(r.randint(0, 4))]
    after = [side(r.choice(["aside", "comments", "footer", "ad", "notice", "form", "share", "nav"])) for _ in range(r.randint(0, 4))]
    return f"<html><head><title>{_words(r, 4)}</title></head><body data-main=\"0\">{''.join(before)}{article}{''.join(after)}</body></html>"


@dataclass
class Model:
    weights: dict[str, float]  # of main text against the rest
    moves: np.ndarray
    first: np.ndarray
    extra: dict = field(default_factory=dict)


def fit(pages: list[str], steps: int = 60, least: int = 3) -> Model:
    """Learn from labelled pages: data-main="1" on an element marks the text inside as main text, "0" as not; the
    nearest such ancestor counts. Features seen in fewer than `least` blocks are not used."""
    seqs = [s for p in pages if (s := [(block_features(b), int(b.mark or 0)) for b in blocks(p, marks=True)])]
    counts: dict[str, int] = {}
    for s in seqs:
        for f, _ in s:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    ids = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= least))}
    length = 64
    chains, labels, rows = [], [], []
    for s in seqs:
        for a in range(0, len(s), length):
            part = s[a : a + length]
            row, lab = np.full(length, -1), np.zeros(length, dtype=np.int64)
            for j, (f, y) in enumerate(part):
                row[j], lab[j] = len(rows), y
                rows.append([ids[x] for x in f if x in ids] or [0])
            chains.append(row), labels.append(lab)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    chain = crf.train(np.array([x for r in rows for x in r], dtype=np.int64), starts, np.array(chains), np.array(labels), len(ids), 2, steps=steps, rate=0.2, decay=1e-3)
    diff = chain.weights[:, 1] - chain.weights[:, 0]
    return Model({x: float(diff[i]) for x, i in ids.items()}, chain.moves, chain.first)


def main_blocks(model: Model, page: str) -> list[str]:
    """Texts of the blocks that the field labels main, in page order."""
    w = model.weights.get
    weigh = lambda f: w(f, 0.0)
    (a00, a01), (a10, a11) = model.moves.tolist()
    s0, s1, back, texts = 0.0, 0.0, [], []
    for b in blocks(page, weigh):
        e = b.weight + sum(map(weigh, block_features(b)))
        texts.append(b.text)
        if len(texts) == 1:
            s0, s1 = float(model.first[0]), float(model.first[1]) + e
            continue
        b0, b1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
        back.append((b0, b1))
        s0, s1 = (s1 + a10 if b0 else s0 + a00), (s1 + a11 if b1 else s0 + a01) + e
    if not texts:
        return []
    y = s1 > s0
    path = [y]
    for pair in reversed(back):
        y = pair[y]
        path.append(y)
    return [t for t, keep in zip(texts, reversed(path)) if keep]


def default_model(n_pages: int = 1500, seed: int = 4) -> Model:
    """Learned from n_pages labelled pages that are made by chance from common page parts."""
    r = random.Random(seed)
    return fit([labelled_page(r) for _ in range(n_pages)])


def extract(pages: DataFrame, model: Model, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text string (main blocks joined by newlines, empty if none) and n_chars long added,
    in place of columns of these names.

    A null or empty page gives an empty text. Pages are read whole and judged alone, in time in proportion to their
    length; equal pages give equal texts; no shuffle. No rows give no rows.
    """
    prepare(pages.sparkSession)
    pages = named(pages, "text", "n_chars", needs=(html_col,))
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            k = batch.schema.get_field_index(html_col)
            texts = ["\n".join(main_blocks(model, h)) if h else "" for h in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(batch.columns) if j != k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(task("html", run, _tokens.clear), schema)
