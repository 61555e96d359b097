"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two block-level tags.  Each
block has features of its ancestors (tags, and what their class, id and role
names speak of), of its text (length, links, punctuation, place), of the
lengths of its neighbours, and of the page: whether an element for the article
is there at all, and where the first heading is.  A two-label chain, trained on
labelled pages, is decoded by Viterbi; the blocks labelled as main text, in
page order, are the result.

The training pages (``labelled_pages``) are laid out by rule in many ways and
carry a mark on the blocks that are main text: with semantic tags, with named
``div``s, or with an article in an element whose name says nothing, alone or
inside wrappers around the whole page.  Their number is a parameter.

Broken markup: a quoted value that was left open ends at the tag's ``>``; a
comment, script or style that was left open hides the rest of the page; a tag
without any ``>`` after it is text.

Nulls: a null page is empty and has no text.  Of label sequences with equal
scores, the one that keeps fewer blocks at the end is taken.  Long pages,
repeated rows and extra columns need no special case (an old column of the
result's name is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import random
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .text import sub_batches

TRAIN_PAGES = 600
_OPEN = re.compile(r"<(?:!--|[!?]|/(?=[^a-zA-Z])|(/?)([a-zA-Z][^\s/>]*+))")
_COMMENT_END = re.compile(r"--!?>")
#: where a tag ends, or a quoted value starts
_STOP = re.compile(r">|=\s*+([\"'])")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"']++)", re.I)
_WORDS = re.compile(r"[a-z]+")
#: content of these is never text
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in
        ("script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "title", "math")}
#: if never closed, these hide the rest of the page; the others are passed over
_HIDES = frozenset(("script", "style"))
_BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
    ol option p pre search section select summary table tbody td textarea tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open tag of the key closes an open one of the set, up to a tag of the fence
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= {t: {"p"} for t in _BLOCK - set(_CLOSES) - {"button", "label", "option", "html", "head", "body"}}
_FENCE = frozenset("article aside body div footer form header main nav section table ul ol dl blockquote".split())
#: what a class, id or role name speaks of
TOPICS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "ad": "ad ads adv advert advertisement advertising banner sponsor sponsored promo promoted promotion",
    "comment": "comment comments reply replies disqus discussion respond",
    "footer": "footer foot copyright legal imprint contentinfo colophon",
    "side": "sidebar aside side related recommend recommended recommendations widget complementary trending popular",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup gdpr paywall dialog",
    "header": "header head masthead logo brand topbar top banner",
    "form": "form search login register signin contact",
    "share": "share sharing social follow tags byline meta author",
    "text": "article content post entry main story body text page",
}
_TOPIC_OF = {}
for _topic, _names in TOPICS.items():
    for _n in _names.split():
        _TOPIC_OF.setdefault(_n, []).append(_topic)


#: ancestors that an article is likely, or unlikely, to have
_HOME = frozenset(("in:article", "in:main", "name:text"))
_SHELL = frozenset(("in:nav", "in:aside", "in:footer", "in:form", *(f"name:{t}" for t in TOPICS if t != "text")))


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]   # ancestor features
    linked: int             # characters inside links


def _topics(attr: str) -> set[str]:
    out: set[str] = set()
    for m in _NAMES.finditer(attr):
        for word in _WORDS.findall(m.group(1).lower()):
            out.update(_TOPIC_OF.get(word, ()))
    return out


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """(place of the ``>`` that ends the tag, whether its quotes are in order); ``at`` is behind the tag's name.

    A quoted value that holds a ``>`` and is not followed by white space, ``/``
    or ``>`` was left open: the tag ends at that ``>``.
    """
    while m := _STOP.search(page, at):
        if not m.group(1):
            return m.start(), True
        at = m.end()
        close = page.find(m.group(1), at)
        inner = page.find(">", at, close if close >= 0 else len(page))
        if inner >= 0 and (close < 0 or not (page[close + 1:close + 2].isspace() or page[close + 1:close + 2] in ("", "/", ">"))):
            return inner, True
        if close < 0:
            break
        at = close + 1
    return -1, False


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order; linear in its length, whatever is broken in it."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    places: dict[str, list[int]] = {}   # where on the stack each tag is open
    fences = [0]
    parts: list[str] = []
    links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1][1], links))
            parts.clear()
        links = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if in_link:
                links += len(raw)

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()
            if fences[-1] == len(stack):
                fences.pop()

    at = 0
    last = page.rfind(">")
    quotes = True           # until a tag with quotes runs to the page's end
    unclosed: set[str] = set()
    while m := _OPEN.search(page, at, last + 1):
        tag = m.group(2)
        if tag is None:
            comment = m.group() == "<!--"
            end = _COMMENT_END.search(page, m.start() + 2) if comment else None
            text(page[at:m.start()])
            # without its own end, a comment hides the rest
            at = end.end() if end else len(page) if comment else page.index(">", m.start()) + 1
            continue
        stop, quotes = _tag_end(page, m.end()) if quotes else (-1, False)
        if stop < 0:
            stop = page.find(">", m.end())
        if stop < 0:
            break
        text(page[at:m.start()])
        at = stop + 1
        tag, attr = tag.lower(), page[m.end():stop]
        if m.group(1):
            if tag == "a":
                in_link = False
            if tag in _BLOCK:
                flush()
                if places.get(tag):
                    cut(places[tag][-1])
            continue
        if tag in _RAW and not attr.endswith("/") and tag not in unclosed:
            end = _RAW[tag].search(page, at)
            if end:
                at = page.find(">", end.end()) + 1 or len(page)
                continue
            if tag in _HIDES:
                at = len(page)
                continue
            unclosed.add(tag)
        if tag == "a":
            in_link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            k = max((places[t][-1] for t in _CLOSES.get(tag, ()) if places.get(t)), default=0)
            if k > fences[-1]:
                cut(k)
            if tag not in _VOID:
                above = stack[-1][1]
                own = [f"in:{tag}", *(f"name:{t}" for t in sorted(_topics(attr)))]
                path = [f for f in above if not f.startswith(("last:", "near:"))]
                path += [f for f in own if f not in path]
                near = [f for f in own if f.startswith("name:")]
                path += [f"near:{f[5:]}" for f in near] if near else [f for f in above if f.startswith("near:")]
                if tag in _FENCE:
                    fences.append(len(stack))
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, tuple([*path, f"last:{tag}"])))
    text(page[at:])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    sizes = [min(7, (b.text.count(" ") + 1).bit_length()) for b in page]
    homes = [any(f in _HOME for f in b.path) for b in page]
    title = next((i for i, b in enumerate(page) if "last:h1" in b.path and not any(f in _SHELL for f in b.path)), None)
    for i, b in enumerate(page):
        f = [*b.path, "bias", f"words:{sizes[i]}"]
        f.append(f"before:{sizes[i - 1] if i else 0}")
        f.append(f"behind:{sizes[i + 1] if i + 1 < len(page) else 0}")
        f.append("home:" + ("in" if homes[i] else "out" if any(homes) else "none"))
        f.append("title:" + ("none" if title is None else "above" if i > title else "here" if i == title else "below"))
        share = b.linked / len(b.text)
        f.append("links:" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
        f.append("stop" if b.text[-1] in ".!?:;\"”»…" else "open")
        if "©" in b.text or "copyright" in b.text[:200].lower():
            f.append("sign")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


class Model(NamedTuple):
    weights: dict[str, float]   # score of "main text" over "other" per feature
    step: tuple[tuple[float, float], tuple[float, float]]  # from label, to label


def decode(model: Model, page: list[Block]) -> list[bool]:
    """Viterbi: the best label sequence of a page."""
    if not page:
        return []
    (s00, s01), (s10, s11) = model.step
    get = model.weights.get
    back: list[tuple[int, int]] = []
    a0 = a1 = 0.0
    for i, names in enumerate(features(page)):
        e = sum(get(n, 0.0) for n in names)
        if i == 0:
            a0, a1 = 0.0, e
            continue
        to0, to1 = (a0 + s00, a1 + s10), (a0 + s01, a1 + s11)
        back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
        a0, a1 = max(to0), max(to1) + e
    label = int(a1 > a0)
    out = [label]
    for b in reversed(back):
        label = b[label]
        out.append(label)
    return [bool(x) for x in reversed(out)]


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = 300, rate: float = 0.2,
        decay: float = 1e-4) -> Model:
    """Maximum likelihood of the chain by gradient steps (Adam); exact forward-backward sums."""
    names = sorted({n for p, _ in pages for f in features(p) for n in f})
    index = {n: i for i, n in enumerate(names)}
    longest = max(len(p) for p, _ in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y = np.zeros((len(pages), longest), np.int64)
    live = np.zeros((len(pages), longest), bool)
    for k, (p, labels) in enumerate(pages):
        for i, f in enumerate(features(p)):
            x[k, i, [index[n] for n in f]] = 1
        y[k, :len(p)], live[k, :len(p)] = labels, True
    both = live[:, 1:] & live[:, :-1]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    flat, total = x[live], live.sum()
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, step = theta[:-4], theta[-4:].reshape(2, 2)
        emit = np.zeros((len(pages), longest, 2))
        emit[..., 1] = x @ w.astype(np.float32)
        fore, back = np.zeros_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0]
        for i in range(1, longest):
            new = np.logaddexp(fore[:, i - 1, :1] + step[0], fore[:, i - 1, 1:] + step[1]) + emit[:, i]
            fore[:, i] = np.where(live[:, i, None], new, fore[:, i - 1])
        z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        for i in range(longest - 2, -1, -1):
            nxt = emit[:, i + 1] + back[:, i + 1]
            new = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            back[:, i] = np.where(live[:, i + 1, None], new, 0)
        prob = np.exp(fore + back - z[:, None, None])[..., 1]
        grad_w = flat.T @ (prob[live] - y[live])
        grad_s = -seen
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(fore[:, :-1, a] + step[a, b] + emit[:, 1:, b] + back[:, 1:, b] - z[:, None])
                grad_s[a, b] += pair[both].sum()
        g = np.concatenate([grad_w, grad_s.ravel()]) / total + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    step = theta[-4:].reshape(2, 2)
    return Model(dict(zip(names, theta[:-4].tolist())), tuple(map(tuple, step.tolist())))


_MARK = "\ue000"


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 0) -> list[tuple[list[Block], list[bool]]]:
    """Training pages: (blocks, which of them are main text)."""
    out = []
    for k in range(n):
        found = blocks(laid_out_page(random.Random(f"{seed}:{k}")))
        labels = [_MARK in b.text for b in found]
        clean = [b._replace(text=b.text.replace(_MARK, "") or "x") for b in found]
        if clean:
            out.append((clean, labels))
    return out


def laid_out_page(r: random.Random) -> str:
    """A page by rule: shells of several kinds around one article; ``_MARK`` is in its main-text blocks."""
    def sentence(lo: int, hi: int) -> str:
        words = ["".join(r.choice(("ta", "ri", "no", "el", "os", "ü", "mé", "st")) for _ in range(r.randint(1, 4)))
                 for _ in range(r.randint(lo, hi))]
        return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?", ""))

    def prose(lo: int = 1, hi: int = 6) -> str:
        return " ".join(sentence(1, 25) for _ in range(r.randint(lo, hi)))

    def links(tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{i}'>{sentence(1, 3)}</a></{tag}>" for i in range(r.randint(1, 8)))

    def named(topic: str, semantic: str, body: str) -> str:
        name = r.choice(TOPICS[topic].split())
        if r.random() < 0.3:
            name += r.choice(("-box", "_wrap", " inner", "-1"))
        attr = r.choice(("class", "class", "id")) + f'="{name}"'
        if semantic and r.random() < 0.6:
            return f"<{semantic}{' ' + attr if r.random() < 0.4 else ''}>{body}</{semantic}>"
        tag = r.choice(("div", "div", "div", "section"))
        return f"<{tag} {attr}>{body}</{tag}>"

    def plain(body: str, most: int) -> str:
        """Up to ``most`` elements whose names say nothing."""
        for _ in range(r.randint(0, most)):
            name = r.choice(("wrapper", "container", "news-item", "row", "inner", "c12", "block", "item", "box", "holder"))
            attr = r.choice(("", "", f' class="{name}"', f' id="{name}"', f" id={name}"))
            body = f"<div{attr}>{body}</div>" if r.random() < 0.8 else f"<section{attr}>{body}</section>"
        return body

    def loose() -> str:
        return r.choice((prose(), f"<p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>", f"<h3>{sentence(1, 5)}</h3><p>{prose()}</p>"))

    def paragraph() -> str:
        body = prose()
        if r.random() < 0.2:
            body += f" <a href='/x'>{sentence(1, 4)}</a> {sentence(1, 8)}"
        if r.random() < 0.1:
            return f"<p><b>{_MARK}{body}<br>"
        return f"<p>{_MARK}{body}" + ("</p>" if r.random() < 0.9 else "")

    def article() -> str:
        body = f"<h1>{_MARK}{sentence(2, 10)}</h1>" if r.random() < 0.85 else ""
        for _ in range(r.randint(1, 14)):
            body += r.choices((
                paragraph, lambda: f"<h2>{_MARK}{sentence(1, 7)}</h2>",
                lambda: "<ul>" + "".join(f"<li>{_MARK}{sentence(1, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>",
                lambda: f"<blockquote>{_MARK}{prose()}</blockquote>",
                lambda: named(r.choice(("ad", "ad", "side", "notice", "comment")), "aside", loose()),
                lambda: named("form", "form", f"<p>{prose(1, 2)}</p><input><button>{sentence(1, 2)}</button>"),
                lambda: named("share", "", f"<ul>{links()}</ul>"),
                lambda: f"<table><tr><td>{_MARK}{sentence(1, 4)}</td><td>{_MARK}{sentence(1, 4)}</td></tr></table>",
                lambda: f"<figure><img src='x'><figcaption>{_MARK}{sentence(2, 9)}</figcaption></figure>",
            ), (60, 8, 5, 3, 5, 1, 2, 2, 2))[0]()
        kind = r.random()
        if kind < 0.4:
            return f"<article>{body}</article>"
        if kind < 0.65:
            return plain(body, 2)
        name = r.choice(TOPICS["text"].split())
        inner = f'<div class="{name}{r.choice(("", "-body", "-text"))}">{body}</div>'
        return r.choice((inner, f"<main>{inner}</main>", f"<main>{body}</main>", f"<article>{inner}</article>"))

    before = [lambda: named("menu", "nav", f"<ul>{links()}</ul>" if r.random() < 0.8 else links("span")),
              lambda: named("header", "header", f"<a href='/'>{sentence(1, 3)}</a><p>{sentence(2, 8)}</p>"),
              lambda: named("ad", "", loose()), lambda: named("notice", "", loose() + f"<button>{sentence(1, 2)}</button>"),
              lambda: named("form", "form", f"<label>{sentence(1, 3)}</label><input><button>{sentence(1, 2)}</button>")]
    after = [lambda: named("side", "aside", f"<h3>{sentence(1, 4)}</h3>" + r.choice((f"<ul>{links()}</ul>", loose()))),
             lambda: named("comment", "", f"<h3>{sentence(1, 3)}</h3>" + "".join(
                 f'<div class="comment"><p>{prose(1, 3)}</p></div>' for _ in range(r.randint(1, 4)))),
             lambda: named("notice", "", loose()), lambda: named("ad", "", loose()), lambda: named("share", "", f"<ul>{links()}</ul>"),
             lambda: named("form", "form", f"<p>{prose(1, 2)}</p><input><button>{sentence(1, 2)}</button>"),
             lambda: named("menu", "nav", f"<ul>{links()}</ul>")]
    foot = named("footer", "footer", r.choice((f"&copy; {sentence(1, 6)}", loose(), f"<p>&copy; {sentence(1, 5)}</p><ul>{links()}</ul>")))
    page = "".join(f() for f in r.sample(before, r.randint(0, 4))) + article()
    page += "".join(f() for f in r.sample(after, r.randint(0, 4))) + (foot if r.random() < 0.9 else "")
    if r.random() < 0.3:
        page = plain(page, 2) if r.random() < 0.7 else f'<div class="{r.choice(("page", "main", "content"))}">{page}</div>'
    return f"<html><head><title>{sentence(2, 8)}</title></head><body>{page}</body></html>"


@functools.lru_cache(maxsize=4)
def default_model(pages: int = TRAIN_PAGES) -> Model:
    return fit(labelled_pages(pages))


def main_text(model: Model, page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, decode(model, found)) if keep)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: Model | None = None) -> DataFrame:
    """``pages`` with the main text of every page (a column of that name is replaced); no shuffle."""
    ship_package(pages.sparkSession)
    model = model or default_model()
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    src = pages.select(*keep, F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(out_col, T.StringType())])

    def run(batches):
        for whole in batches:
            for b in sub_batches(whole, "html"):
                texts = [main_text(model, p) for p in b.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out_col])

    return src.mapInArrow(run, schema)
