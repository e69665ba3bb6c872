"""HTML extraction (operator 9): a bidirectional LSTM in numpy labels the blocks of a page.

A page is read into leaf blocks: text between block-level tags, with the path of open block-level
elements and their class, id and role words. A block's vector holds hashed path words, hashed words of
its text, and its length, link share and punctuation. The network reads a page's blocks in both
directions, so that a block's label may follow from the whole page. It is trained once per driver
process, in a few seconds, on pages that a seeded generator writes with their labels; no row of the
corpus is used. Weights (some 100 kB) go to the tasks with the function.

The main text is the blocks labelled as content: character references decoded, white space inside a
block made one space, blocks joined by a line feed in page order.

Cases: a null or empty html, and a page without content, give an empty text; null ids and urls stay;
unclosed elements end with their parent or the page; scripts, styles, other raw texts and comments are never
blocks, nor are closed elements of CLOSED, whose self-closed or unclosed tags alone count as inline; tags in
bad form end where HTML's own tokenizer ends them; text in math and object stays; repeated rows give equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Sizes of the hashed parts of a block's vector, and of each direction's state.
PATH_BINS, WORD_BINS, NUMBERS, HIDDEN = 96, 16, 4, 12
#: Pages of the generator that the network is trained on, passes over them, and the seed.
TRAINED_ON, PASSES, SEED = 800, 30, 7
#: Blocks that are labelled together, at most (but a page is never cut).
MOST_BLOCKS = 20_000

#: Elements whose text holds no tags: dropped up to the end tag. Without one, those of ENDLESS take the rest.
RAW = frozenset("script style iframe noembed noframes xmp textarea".split())
ENDLESS = frozenset(("script", "style"))
#: Elements that are dropped if they are closed; else their tags count as inline.
CLOSED = frozenset("noscript svg canvas select button template".split())
#: A tag in good form. Nothing in it runs beyond the next "<", so that reading takes linear time.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'=<>`]++))?+)*+\s*+/?)>"""
)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: A step through a tag in bad form: its end, or an attribute's name with the quote that opens its value.
_STEP = re.compile(r"""[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+(=)\s*+(["']?))?)""")
_BARE = re.compile(r"[^\s>]*+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*RAW, "title")}
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Words of a block's path, and open elements that an end of another is looked for in, at most.
MOST_WORDS, MOST_OPEN = 200, 50
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr object math mi mn mo ms mtext mspace mrow mfrac msqrt mroot "
    "msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose mfenced mtable mtr mtd "
    "semantics annotation".split()
) | CLOSED | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that closes an open one of these, up to the nearest of what can hold it.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
for _t in (
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol pre section table ul"
).split():
    CLOSES[_t] = {"p"}
HOLDS = frozenset("ul ol dl table article aside section div main nav form body header footer blockquote".split())


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(mark, name or text, attributes) in order: mark "" for text, "<" for a start, "." for a start that
    closes itself, "/" for an end. Comments, declarations and raw texts are left out.

    Follows the states of HTML's own tokenizer, but a quote that is never closed doesn't open a value, and
    a raw text that is never closed holds nothing. Each character is read a bounded number of times.
    """
    out: list[tuple[str, str, str]] = []
    missing: set[str] = set()  # what is not found further on
    at = text = 0

    def found(what: str, start: int) -> int:
        place = -1 if what in missing else page.find(what, start)
        if place < 0:
            missing.add(what)
        return place

    def bad_form(start: int) -> int:
        """The end of a tag whose attributes begin at start; 0 if it has none."""
        while m := _STEP.match(page, start):
            start = m.end()
            if m[1]:
                return start
            if m[3] and (end := found(m[3], start)) >= 0:
                start = end + 1
            elif m[2]:
                start = _BARE.match(page, start).end()
        return 0

    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        beyond = page[at + 2 : at + 3]
        if after and after in "!?" or after == "/" and beyond and not beyond.isalpha():
            what, start = ("-->", at + 2) if page.startswith("<!--", at) else (">", at + 2)
            end = found(what, start)
            if text < at:
                out.append(("", page[text:at], ""))
            if end < 0:
                return out
            at = text = end + len(what)
            continue
        m = _TAG.match(page, at)
        if m:
            end, attributes = m.end(), m[3]
        else:
            m = _NAME.match(page, at)
            if not m:
                at += 1
                continue
            end = bad_form(m.end())
            attributes = page[m.end() : end - 1]
        if text < at:
            out.append(("", page[text:at], ""))
        if not end:
            return out
        name = m[2].lower()
        mark = "/" if m[1] else "." if attributes.endswith("/") else "<"
        at = text = end
        if mark != "/" and name in _ENDS:
            close = None if name in missing else _ENDS[name].search(page, at)
            if close is None:
                missing.add(name)
                if name in ENDLESS and mark == "<":
                    return out
            elif name in RAW:
                end = page.find(">", close.end())
                if end < 0:
                    return out
                at = text = end + 1
                continue
            else:  # a title's text holds no tags either
                out += [(mark, name, attributes), ("", page[at : close.start()], "")]
                at = text = close.start()
                continue
        out.append((mark, name, attributes))
    if text < len(page):
        out.append(("", page[text:], ""))
    return out


def shown(page: str) -> list[tuple[str, str, str]]:
    """The tokens without elements of CLOSED that are closed. An end that closes an outer element ends what
    is open within it, so that an element that was never closed takes nothing along."""
    read = tokens(page)
    if not any(name in CLOSED for mark, name, _ in read if mark):
        return read
    gone = np.zeros(len(read) + 1, dtype=np.int64)
    count: dict[str, int] = {}
    stack: list[tuple[str, int]] = []
    for i, (mark, name, _) in enumerate(read):
        if mark == "<" and name not in VOID:
            stack.append((name, i))
            count[name] = count.get(name, 0) + 1
        elif mark == "/" and count.get(name):
            while True:
                last, start = stack.pop()
                count[last] -= 1
                if last == name:
                    break
            if name in CLOSED:
                gone[start] += 1
                gone[i + 1] -= 1
    return [x for x, n in zip(read, np.cumsum(gone)) if not n]


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path words, text, code points in links) of each leaf block of a page, in order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    count: dict[str, int] = {}
    parts: list[str] = []
    links = linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1] if stack else (), text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def close(i: int) -> None:
        for name, _ in stack[i:]:
            count[name] -= 1
        del stack[i:]

    for mark, name, attributes in shown(page):
        if not mark:
            parts.append(name)
            if links:
                linked += len(name)
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if mark == "/" else 1
            elif name == "br":
                parts.append("\n")
            continue
        end()
        if mark == "/":
            if count.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            links = 0
            continue
        if name in VOID:
            continue
        closed = CLOSES.get(name)
        if closed and any(count.get(x) for x in closed):
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - MOST_OPEN), -1):
                if stack[i][0] in closed:
                    close(i)
                    break
                if stack[i][0] in HOLDS:
                    break
        words = [name]
        if "=" in attributes:
            for a in _NAMES.finditer(attributes):
                words += [f"{name}.{w}" for w in re.split(r"[\s_\-]+", (a[1] or a[2] or a[3] or "").lower()) if w]
                words += [f".{w[len(name) + 1:]}" for w in words[1:] if w.startswith(name + ".")]
        before = stack[-1][1] if stack else ()
        room = MOST_WORDS - len(before)
        stack.append((name, before + tuple([w for w in words if w not in before][:room])))
        count[name] = count.get(name, 0) + 1
    end()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if path not in _paths:
        if len(_paths) > 50_000:
            _paths.clear()
        v = np.zeros(PATH_BINS, dtype=np.float32)
        for w in path:
            v[zlib.crc32(w.encode()) % PATH_BINS] = 1
        _paths[path] = v
    return _paths[path]


def vectors(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    out = np.zeros((len(page), PATH_BINS + WORD_BINS + NUMBERS), dtype=np.float32)
    crc = zlib.crc32
    for row, (path, text, linked) in zip(out, page):
        row[:PATH_BINS] = _path_vector(path)
        words = text.lower().encode().split()
        bins = np.bincount([crc(w) & (WORD_BINS - 1) for w in words], minlength=WORD_BINS)
        row[PATH_BINS : PATH_BINS + WORD_BINS] = np.minimum(bins / len(words), 0.25)
        marks = sum(map(text.count, ".,;:!?"))
        row[-NUMBERS:] = (
            min(1.0, np.log1p(len(words)) / 5), linked / len(text), min(1.0, marks / len(words)), text[-1] in ".!?:"
        )
    return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, vector) and the mask of real blocks."""
    t = max(map(len, pages))
    x = np.zeros((t, len(pages), pages[0].shape[1]), dtype=np.float32)
    mask = np.zeros((t, len(pages), 1), dtype=np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, size: int = PATH_BINS + WORD_BINS + NUMBERS, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.h = hidden
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.2, (size, 4 * hidden))
            w["h" + d] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            w["c" + d] = np.r_[np.ones(hidden), np.zeros(3 * hidden)]
        w["o"] = rng.normal(0, 0.2, (2 * hidden, 1))
        w["z"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction. Padding leaves the state as it is."""
        n = self.h
        gates = x @ self.w["x" + d] + self.w["c" + d]
        h = np.zeros((x.shape[1], n), dtype=np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*x.shape[:2], n), dtype=np.float32)
        kept = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = gates[t] + h @ self.w["h" + d]
            f, i, o = (_sigmoid(g[:, k * n : (k + 1) * n]) for k in range(3))
            u = np.tanh(g[:, 3 * n :])
            c1 = f * c + i * u
            s = np.tanh(c1)
            h1 = o * s
            m = mask[t]
            if keep:
                kept.append((t, h, c, f, i, o, u, s, m))
            h, c = m * h1 + (1 - m) * h, m * c1 + (1 - m) * c
            out[t] = h
        return out, kept

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.w["o"] + self.w["z"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over real blocks; y as (time, page)."""
        n, w = self.h, self.w
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        error = (_sigmoid(both @ w["o"] + w["z"]) - y[:, :, None]) * mask / mask.sum()
        out = {"o": both.reshape(-1, 2 * n).T @ error.reshape(-1, 1), "z": error.sum((0, 1))}
        for k, d in enumerate("fb"):
            above = error @ w["o"][k * n : (k + 1) * n].T
            dg = np.zeros((*x.shape[:2], 4 * n), dtype=np.float32)
            dh = np.zeros((x.shape[1], n), dtype=np.float32)
            dc = np.zeros_like(dh)
            dw = np.zeros_like(w["h" + d])
            for t, h, c, f, i, o, u, s, m in reversed(runs[d][1]):
                dh = dh + above[t]
                dh1, dc1 = dh * m, dc * m
                dc1 = dc1 + dh1 * o * (1 - s * s)
                g = np.concatenate(
                    [dc1 * c * f * (1 - f), dc1 * u * i * (1 - i), dh1 * s * o * (1 - o), dc1 * i * (1 - u * u)], axis=1
                )
                dg[t] = g
                dw += h.T @ g
                dh = dh * (1 - m) + g @ w["h" + d].T
                dc = dc * (1 - m) + dc1 * f
            flat = dg.reshape(-1, 4 * n)
            out |= {"x" + d: x.reshape(len(flat), -1).T @ flat, "h" + d: dw, "c" + d: flat.sum(0)}
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], passes: int, seed: int, group: int = 100) -> None:
        """Adam over groups of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for turn in range(passes):
            rate = 0.02 * (1 - turn / passes) + 0.001
            order = rng.permutation(len(pages))
            for at in range(0, len(order), group):
                own = order[at : at + group]
                x, mask = _padded([pages[i] for i in own])
                y, _ = _padded([labels[i][:, None] for i in own])
                step += 1
                for k, g in self.gradients(x, mask, y[:, :, 0]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    self.w[k] -= (rate * first[k] / (1 - 0.9**step) / scale).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks are content. Pages of similar length are run together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            group, longest = [], 0
            while order and len(group) < 512:
                longest = max(longest, len(pages[order[-1]]))
                if group and longest * (len(group) + 1) > MOST_BLOCKS:
                    break
                group.append(order.pop())
            scores = self.scores(*_padded([pages[i] for i in group]))
            for k, i in enumerate(group):
                out[i] = scores[: len(pages[i]), k] > 0
        return out


# Words of the generator's pages (fixed values, by use).
CONTENT_TAGS = ("p", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "dd", "dt")
CONTENT_ROOTS = ("article", "article", "article", "main", "main", 'div class="article-body"', 'div class="post-content"',
                 'div id="content"', 'section class="entry"', 'div class="story"')
MENUS = ("nav", 'div class="menu"', 'ul class="nav"', 'div class="breadcrumb"', 'div id="navigation"')
HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'div class="banner"')
FOOTERS = ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"')
SIDES = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'section class="widget"',
         'div class="share"', 'div class="social"', 'div class="recommended"', 'div class="newsletter"')
ADVERTS = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad"',
           'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'ins class="adsbygoogle"',
           'p class="ad"', 'section class="ad"')
NOTICES = ('div class="cookie"', 'div class="cookie-notice"', 'div id="consent"', 'div class="popup"',
           'div class="notice"', 'div role="dialog"', 'div class="alert"', 'div class="gdpr"', 'dialog',
           'p class="notice"', 'section class="notice"')
FORMS = ("form", 'form class="search"', 'form id="login"', "form class=\"signup\"", 'fieldset')
COMMENTS = ('section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"',
            'ul class="comments"', 'div id="disqus_thread"', 'div class="replies"', 'section id="comments"',
            'article class="comment"', 'li class="comment"')


_WORDS = ["".join(random.Random(i).choices("aeiounstrlmdpkvéüñ", k=1 + i % 11)) for i in range(500)]


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page in random layout, and for each of its blocks whether it is content."""
    page: list[str] = []
    labels: list[bool] = []

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high) * rng.choice((1, 1, 1, 1, 8))
        if rng.random() < 0.1:
            n, pool = n * rng.choice((1, 5)), rng.choices(_WORDS, k=rng.randint(1, 2))
        else:
            pool = _WORDS
        glue = rng.choice((" ", " ", " ", " ", " | ", "### ", ", ", ". ", "$$$ "))
        return glue.join(rng.choices(pool, k=n)).capitalize() + rng.choice(("", ".", ".", "!", "?"))

    def put(tag: str, text: str, content: bool, close: bool = True) -> None:
        page.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        labels.append(content)

    def link(low: int, high: int) -> str:
        return f'<a href="/{rng.random()}">{words(low, high)}</a>'

    def boiler(kinds: tuple[str, ...]) -> None:
        tag = rng.choice(kinds)
        how = rng.random()
        page.append(f"<{tag}>")
        if how < 0.35:
            page.append(words(1, 30))
            labels.append(False)
        elif how < 0.7:
            page.append("<ul>")
            for _ in range(rng.randint(1, 7)):
                put("li", link(1, 4) if rng.random() < 0.8 else words(1, 8), False)
            page.append("</ul>")
        else:
            for _ in range(rng.randint(1, 4)):
                put(rng.choice(("p", "div", "h3", "h4", "li", "span_", "p")).replace("span_", "div"), words(1, 40), False)
        page.append(f"</{tag.split()[0]}>")

    outside = (MENUS, HEADERS, SIDES, ADVERTS, NOTICES, FORMS)
    page.append("<!DOCTYPE html><html><head><meta charset=utf-8>")
    put("title", words(2, 12), False)
    page.append("<style>p{}</style><script>var x='<p>';</script></head><body>")
    for _ in range(rng.randint(0, 4)):
        boiler(rng.choice(outside))
    wrapped = rng.random() < 0.3
    if wrapped:
        page.append(rng.choice(("<div>", '<div class="container">', "<main>", '<div id="page">', '<div class="row">')))
    root = rng.choice(CONTENT_ROOTS)
    page.append(f"<{root}>")
    nested = rng.random() < 0.2
    if nested:
        page.append(rng.choice(("<section>", "<div>", '<div class="text">')))
    if rng.random() < 0.8:
        put("h1", words(2, 12), True)
    for _ in range(rng.randint(0, 9)):
        kind = rng.random()
        if kind < 0.12:
            boiler(rng.choice((ADVERTS, SIDES, NOTICES, FORMS, MENUS, ADVERTS)))
        elif kind < 0.2:
            page.append("<ul>")
            for _ in range(rng.randint(1, 5)):
                put("li", words(1, 25) if rng.random() < 0.8 else link(1, 6), True)
            page.append("</ul>")
        elif kind < 0.24:
            page.append("<table><tr>")
            for _ in range(rng.randint(1, 4)):
                put("td", words(1, 6), True)
            page.append("</tr></table>")
        else:
            text = words(1, 60)
            if rng.random() < 0.3:
                text = f"<b>{text}" + rng.choice(("</b>", "<br>", ""))
            if rng.random() < 0.2:
                text += " " + link(1, 3)
            put(rng.choice(("p",) * 8 + CONTENT_TAGS[1:5]), text, True, rng.random() < 0.9)
    if nested:
        page.append("</section>" if "<section>" in page else "</div>")
    if rng.random() < 0.25:
        boiler(COMMENTS)
    page.append(f"</{root.split()[0]}>")
    if wrapped and rng.random() < 0.5:
        boiler(rng.choice((SIDES, COMMENTS, ADVERTS)))
    if wrapped:
        page.append("</main>" if "<main>" in page else "</div>")
    for _ in range(rng.randint(0, 3)):
        boiler(rng.choice((*outside, COMMENTS)))
    if rng.random() < 0.8:
        boiler(FOOTERS)
    page.append(rng.choice(("</body></html>", "")))
    return "".join(page), labels


def generated(n: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    pages, labels = [], []
    while len(pages) < n:
        page, own = generated_page(rng)
        read = blocks(page)
        if len(read) == len(own):  # an unclosed element can join two blocks; such pages are left out
            pages.append(vectors(read))
            labels.append(np.asarray(own, dtype=np.float32))
    return pages, labels


_trained: list[Labeller] = []


def trained() -> Labeller:
    """The labeller, trained on first use in this process; the same on every run."""
    if not _trained:
        model = Labeller()
        model.fit(*generated(TRAINED_ON, SEED), PASSES, SEED)
        _trained.append(model)
    return _trained[0]


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    read = [blocks(p) if p else [] for p in pages]
    chosen = model.label([vectors(b) for b in read])
    return ["\n".join(b[1] for b, keep in zip(bs, own) if keep) for bs, own in zip(read, chosen)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html): a row per row."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                }
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
