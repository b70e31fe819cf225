"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page's tree.

A page becomes its blocks in order: runs of text that no block-level tag interrupts, each with the tags, class and id
words above it. The field has two states, text and other; a block's features are its ancestors' tags, words and word
stems, its own tag and simple text measures, and neighbouring states are tied by transition weights. Weights maximise
the likelihood of labelled pages by forward-backward gradients; decoding is Viterbi. The labelled pages are made from
the layouts in labelled_pages below, written with labels by hand, so that training never reads the corpus; many of their
names are made-up words, so that the measures of the text decide where names say nothing.

Reading a page takes time and memory in proportion to its length, however deep its tags are nested: blocks share the
features of what is above them, and only features that the field knows are kept.

Defined cases: a null html is empty; a page without text blocks has empty text; broken and cut-off markup is read as
far as it goes; very long pages are read whole; scripts, styles and comments never become blocks; of labellings with
equal scores the one with more other blocks at the end stays; repeated rows are extracted one by one; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as html_entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.DOTALL)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
#: Tags whose content is never text; fixed values.
RAW = frozenset("script style noscript template svg iframe object textarea select".split())
#: Tags that do not interrupt a block; fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these closes an open one of the same kind.
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())


#: Parts of class and id words that tell what a part of a page is for; fixed values.
STEMS = (
    "nav menu crumb head mast top bar foot bottom side widget relat recommend share social comment repl respons discuss react "
    "feedback cookie consent gdpr privacy notice banner alert popup modal advert sponsor promo subscri newsletter letter login signup "
    "search form tag meta author byline pager pagin legal copy skip link content article main post entry story body text read"
).split()


class Block:
    __slots__ = ("path", "tag", "text", "linked")

    def __init__(self, path, tag, text, linked):
        self.path, self.tag, self.text, self.linked = path, tag, text, linked


class _Names(dict):
    """Class or id word to its features; remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = (f".{word}", *(f"~{x}" for x in STEMS if x in word))
        if len(self) < 20_000 and len(word) <= 64:
            self[word] = found
        return found


_FEATURES = _Names()


class _Open:
    """The open tags: each with the features above it, and where the last of each kind is."""

    def __init__(self, known):
        self.known = known  # None: all features
        self.tags: list[str] = []
        self.paths: list[frozenset] = [frozenset()]
        self.last: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block-level tags

    def push(self, tag: str, attributes: str) -> None:
        found = [f"<{tag}"]
        if attributes:
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower()
            for word in _WORDS.findall(named):
                found += _FEATURES[word]
        above = self.paths[-1]
        fresh = [f for f in found if f not in above and (self.known is None or f in self.known)]
        self.last.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(above.union(fresh) if fresh else above)

    def cut(self, at: int) -> None:
        """Closes all tags from place at on."""
        for tag in self.tags[at:]:
            self.last[tag].pop()
        del self.tags[at:], self.paths[at + 1 :]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        places = self.last.get(tag)
        # an inline tag does not close what is outside its block
        if places and not (tag in INLINE and self.blocks and places[-1] < self.blocks[-1]):
            self.cut(places[-1])


def blocks_of(page: str | None, known=None) -> list[Block]:
    """Leaf blocks in page order; path: the features above (those known, if given), tag: the nearest block-level tag."""
    out: list[Block] = []
    if not page:
        return out
    tags, held = _Open(known), []
    linked = 0
    at, end = 0, len(page)

    def flush():
        nonlocal linked
        if held:
            text = " ".join(html_entities.unescape("".join(held)).split())
            held.clear()
            if text:
                tag = tags.tags[tags.blocks[-1]] if tags.blocks else ""
                out.append(Block(tags.paths[-1], tag, text, min(1.0, linked / (len(text) - text.count(" ")))))
        linked = 0

    def add(text):
        nonlocal linked
        held.append(text)
        if tags.last.get("a"):
            linked += len("".join(text.split()))

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        closing, tag = m[1], m[2].lower()
        if closing:
            if tag not in INLINE:
                flush()
            tags.close(tag)
            continue
        if tag in RAW and not m[3].endswith("/"):
            if tag not in INLINE:
                flush()
            close = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            if close is None:
                break
            stop = page.find(">", close.start())
            at = end if stop < 0 else stop + 1
            continue
        if tag == "br":
            add(" ")
        if tag not in INLINE:
            flush()
            if tag in CLOSES_ITSELF and tags.blocks and tags.tags[tags.blocks[-1]] == tag:
                tags.cut(tags.blocks[-1])
        if tag not in VOID and not m[3].endswith("/"):
            tags.push(tag, m[3])
    flush()
    return out


def features(blocks: list[Block]) -> list[set[str]]:
    out = []
    for b in blocks:
        n = b.text.count(" ") + 1
        size, links, stop = min(6, n.bit_length()), int(4 * b.linked), b.text[-1] in ".!?…\"”»"
        found = {f"in:{b.tag}", f"words:{size}", f"links:{links}", f"{b.tag}:{size}:{stop}", "bias", *b.path}
        if stop:
            found.add("stop")
        if n >= 6 and stop and links == 0:
            found.add("prose")
        if "©" in b.text or "®" in b.text:
            found.add("rights")
        out.append(found)
    return out


class Field:
    """Weights of a trained field: features x 2 states, and transitions 2 x 2."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.names, self.unary, self.pair = names, unary, pair

    def decode(self, found: list[set[str]]) -> list[int]:
        """Viterbi: the likeliest states (1: text)."""
        if not found:
            return []
        a = [sum(self.unary[self.names[f]] for f in fs if f in self.names) + np.zeros(2) for fs in found]
        (p00, p01), (p10, p11) = self.pair.tolist()
        s0, s1 = a[0].tolist()
        back = []
        for u in a[1:]:
            back.append((s1 + p10 > s0 + p00, s1 + p11 > s0 + p01))
            s0, s1 = max(s0 + p00, s1 + p10) + float(u[0]), max(s0 + p01, s1 + p11) + float(u[1])
        states = [int(s1 > s0)]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def train(pages: list[tuple[list[set[str]], list[int]]], rounds: int = 80, decay: float = 0.02) -> Field:
    """Gradient steps (adaptive, full batch) on the likelihood of labelled pages; forward-backward over all pages at once."""
    pages = [(found, y) for found, y in pages if found]
    names: dict[str, int] = {}
    for found, _ in pages:
        for fs in found:
            for f in sorted(fs):
                names.setdefault(f, len(names))
    n_pages, longest = len(pages), max(len(y) for _, y in pages)
    places = [(k * longest + i, f) for k, (found, _) in enumerate(pages) for i, fs in enumerate(found) for f in sorted(fs)]
    at, col = np.array([x for x, _ in places]), np.array([names[f] for _, f in places])
    there, wanted = np.zeros((n_pages, longest), bool), np.zeros((n_pages, longest, 2))
    for k, (_, y) in enumerate(pages):
        there[k, : len(y)] = True
        wanted[k, np.arange(len(y)), y] = 1.0
    follow = there[:, 1:, None, None]
    seen_pairs = (wanted[:, :-1, :, None] * wanted[:, 1:, None, :] * follow).sum(axis=(0, 1))
    unary, pair = np.zeros((len(names), 2)), np.zeros((2, 2))
    seen_u, seen_p = np.full_like(unary, 1e-6), np.full_like(pair, 1e-6)
    for _ in range(rounds):
        u = np.stack([np.bincount(at, unary[col, k], n_pages * longest) for k in (0, 1)], axis=1).reshape(n_pages, longest, 2)
        u = np.where(there[..., None], np.exp(u - u.max(axis=2, keepdims=True)), 1.0)
        edge = np.exp(pair)
        fwd, bwd = np.ones_like(u), np.ones_like(u)
        fwd[:, 0] = u[:, 0] / u[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, longest):
            now = u[:, k] * (fwd[:, k - 1] @ edge)
            fwd[:, k] = now / now.sum(axis=1, keepdims=True)
        for k in range(longest - 2, -1, -1):
            now = (u[:, k + 1] * bwd[:, k + 1]) @ edge.T
            bwd[:, k] = np.where(there[:, k + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
        marginal = fwd * bwd
        marginal /= marginal.sum(axis=2, keepdims=True)
        gap = ((wanted - marginal) * there[..., None]).reshape(-1, 2)
        gu = np.stack([np.bincount(col, gap[at, k], len(names)) for k in (0, 1)], axis=1) - decay * unary
        joint = fwd[:, :-1, :, None] * edge * (u[:, 1:] * bwd[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        gp = seen_pairs - (joint * follow).sum(axis=(0, 1)) - decay * pair
        seen_u += gu**2
        seen_p += gp**2
        unary += 0.5 * gu / np.sqrt(seen_u)
        pair += 0.5 * gp / np.sqrt(seen_p)
    return Field(names, unary, pair)


#: Class or id words of each part of a page, as layouts use them; fixed values.
NAMES = {
    "menu": "menu|navbar|main-menu|topnav|breadcrumb|nav-links|site-nav|navigation|tabs",
    "header": "header|masthead|site-header|page-head|brand|top",
    "footer": "footer|site-footer|foot|bottom-bar|copyright|legal",
    "side": "sidebar|related|widget|side|right-rail|recommended|more-links|trending",
    "article": "content|main|post|article-body|entry story|article text|post-content|story|entry-content|page-text",
    "comments": "comments|replies|responses|discussion|user-comments|comment-list|reactions|thread",
    "advert": "ad|ads|advert|ad-box|sponsored|promo|banner ad|advertisement",
    "notice": "cookie|cookie-notice|notice|consent|gdpr banner|alert|popup|privacy-banner",
    "form": "newsletter|subscribe|search|login|signup-form|contact-form",
    "meta": "byline|meta|share|social|tags|author-box|post-meta",
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "article": "article", "comments": "section"}
STYLES = ("semantic", "classes", "ids", "odd", "table", "bare")


def labelled_pages(n: int = 400, seed: int = 7, styles: tuple[str, ...] = STYLES) -> list[tuple[str, list[int]]]:
    """Pages with a label for each block (1: text), in several styles of markup, some of it broken.

    semantic: tags say what a part is; classes, ids: words do; odd: made-up words, so that links and text must tell;
    table: parts are cells; bare: the text has no frame of its own.
    """
    rng = random.Random(seed)
    syllables = "la re mi so ta ne ku do vi an er in on th es".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=1, b=18: phrase(a, b).capitalize() + "."
    para = lambda: " ".join(sentence() for _ in range(rng.randint(1, 7)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{phrase(a, b)}</a>'
    pick = rng.choice

    def frame(kind: str, inner: str, style: str) -> str:
        named = pick(NAMES[kind].split("|"))
        telling = named.replace(" ", "-").split("-")[0]
        if rng.random() < 0.3 and any(x in telling for x in STEMS):  # one word of two, of which a stem tells
            named = telling
            named = pick([f"{word()}{named.capitalize()}", f"{named}{word().capitalize()}"])
        if style == "bare" and kind == "article":
            return inner
        if style == "semantic" and kind in SEMANTIC:
            tag = pick(["article", "article", "main"]) if kind == "article" else SEMANTIC[kind]
            label = f' class="{named}"' if kind == "comments" or rng.random() < 0.2 else ""
            return f"<{tag}{label}>{inner}</{tag}>"
        if style in ("odd", "bare", "table") and kind in ("menu", "header", "footer", "side", "article"):
            named = pick([word() + pick("qxzj") + word(), named]) if style == "table" else word() + pick("qxzj") + word()
        if style == "table":
            return f'<table><tr><td class="{named}">{inner}</td></tr></table>'
        return f'<div id="{named}">{inner}</div>' if style == "ids" else f'<div class="{named}">{inner}</div>'

    def items(k, inner, tag="li"):
        return "".join(f"<{tag}>{inner()}</{tag}>" for _ in range(k)), [0] * k

    def part(kind: str, style: str) -> tuple[str, list[int]]:
        """A part of a page that is not its text."""
        plain = style in ("odd", "bare", "table")  # no word says what it is: its links or its size must
        if kind == "menu":
            if rng.random() < 0.25:
                return frame(kind, pick(["<br>", " | ", " "]).join(link() for _ in range(rng.randint(2, 7))), style), [0]
            body, labels = items(rng.randint(2, 7), link, pick(["li", "li", "div"]))
            return frame(kind, pick([f"<ul>{body}</ul>", body]), style), labels
        if kind == "header":
            return frame(kind, pick([f"<div>{phrase(1, 4)}</div>", f"<p>{phrase(1, 4)}</p>", phrase(1, 5)]), style), [0]
        if kind == "footer":
            rights = f"&copy; {phrase(1, 8)}"
            inner = pick([rights, f"<p>{rights} &middot; {para()}</p>", link(1, 4)]) if plain else pick([rights, f"<p>{rights} {para()}</p>", f"<p>{para()}</p>"])
            return frame(kind, inner, style), [0]
        if kind == "side":
            body, labels = items(rng.randint(1, 5), lambda: link(2, 8))
            h = pick(["h3", "h4", "h2"])
            return frame(kind, f"<{h}>{phrase(1, 3)}</{h}><ul>{body}</ul>", style), [0, *labels]
        if kind == "comments":
            tag = pick(["div", "p", "li"])
            label = pick([' class="comment"', "", f' class="{word()}"'])
            k, h = rng.randint(1, 4), pick(["h3", "h2", "h4"])
            body = "".join(f"<{tag}{label}>{pick([para, sentence])()}</{tag}>" for _ in range(k))
            return frame(kind, f"<{h}>{phrase(1, 2)}</{h}>{body}", style), [0] * (k + 1)
        if kind == "form":
            if rng.random() < 0.5:
                return f'<form action="/s"><label>{phrase(1, 4)}</label><input name="q"></form>', [0]
            return pick([f'<form class="newsletter"><p>{para()}</p><input type="email"></form>', frame(kind, sentence(), "classes")]), [0]
        if kind == "meta":
            return frame(kind, pick([phrase(2, 6), f"{phrase(1, 2)} {link()}", f"{link()} {link()} {link()}"]), "classes"), [0]
        inner = pick([para(), f"<p>{para()}</p>", link(2, 8)])
        return frame(kind, inner, pick(["classes", "ids"])), [0]

    def article(style: str) -> tuple[str, list[int]]:
        ending = lambda: pick(["", "", "", ".", ".", "***", " |", ".%%%", "!!", "?"])
        h = pick(["h1", "h1", "h1", "h1", "h2"])
        out, labels = ([f"<{h}>{phrase(1, pick([2, 4, 12])).capitalize()}{ending()}</{h}>"], [1]) if rng.random() < 0.85 else ([], [])
        usual = pick(["p", "p", "p", "div"])
        shapes = [lambda: f"<{usual}>{para()}</{usual}>"] * 9 + [
            lambda: f"<p><b>{para()}<br>", lambda: f"<p>{para()}", lambda: f"<p>{link()} {para()}</p>", lambda: f"<h2>{phrase(1, 6)}</h2>",
            lambda: f"<blockquote>{para()}</blockquote>", lambda: f"<div>{para()}</div>", lambda: f"<pre>{phrase(2, 9)}</pre>",
            lambda: f"<ul><li>{phrase(3, 14)}</li></ul>", lambda: f"<table><tr><td>{phrase(1, 5)}</td></tr></table>", lambda: f"<p>{sentence()}</p>",
            lambda: f"<p>{phrase(1, 3).capitalize()}{ending()}</p>", lambda: f"<h3>{phrase(1, 5)}</h3>",
        ]
        for _ in range(rng.randint(1, 12)):
            out.append(pick(shapes)())
            labels.append(1)
            if rng.random() < 0.1:
                extra, more = part(pick(["advert", "side", "form", "meta", "notice"]), "classes")
                out.append(extra)
                labels += more
        if rng.random() < 0.3:
            extra, more = part("comments", pick(["classes", "ids", "semantic"]))
            out.append(extra)
            labels += more
        return frame("article", "".join(out), style), labels

    pages = []
    for _ in range(n):
        style = pick(styles)
        parts, labels = [], []
        before = [k for k in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.5]
        after = [k for k in ("comments", "side", "advert", "form", "notice", "footer") if rng.random() < 0.5]
        for kind in [*before, "article", *after]:
            extra, more = article(style) if kind == "article" else part(kind, pick(["classes", "ids"]) if kind == "comments" and style in ("odd", "bare", "table") else style)
            parts.append(extra)
            labels += more
        body = "".join(parts)
        for _ in range(rng.randint(0, 2)):
            body = f'<div class="{pick(["wrap", "page", "container", word()])}">{body}</div>'
        head = f"<!DOCTYPE html><html><head><title>{phrase(2, 9)}</title><style>p{{x:y}}</style><script>var t='</p>';</script></head><body>"
        pages.append((head + body + pick(["</body></html>", ""]), [0, *labels]))
    return pages


_FIELD: dict[int, Field] = {}


def trained_field() -> Field:
    """The field of the labelled pages; the same weights each time."""
    if 0 not in _FIELD:
        pages = [(blocks_of(p), y) for p, y in labelled_pages()]
        _FIELD[0] = train([(features(b), y) for b, y in pages if len(b) == len(y)])
    return _FIELD[0]


def main_blocks(page: str | None, field: Field) -> list[str]:
    blocks = blocks_of(page, field.names)
    return [b.text for b, state in zip(blocks, field.decode(features(blocks)), strict=True) if state]


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """page_id, the columns to keep, text and n_chars for every row."""
    held = pages.sparkSession.sparkContext.broadcast(trained_field())  # a few hundred weights
    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("_html"))

    def run(source):
        field = held.value
        for batch in slices(source):
            texts = ["\n".join(main_blocks(cell.as_py(), field)) for cell in batch.column("_html")]
            columns = [batch.column(n) for n in batch.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", *keep, "text", "n_chars"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_html")
    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
