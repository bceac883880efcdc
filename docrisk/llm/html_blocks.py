"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with its tag
path (names of open elements and words of their class, id and role) and its words. A bidirectional
LSTM, written in numpy, reads the whole sequence and labels every block as main text or not; each
block's input is the sum of learned vectors of its path and the average of learned vectors of its
hashed words. It is trained on a bounded sample of the given pages: their blocks are dealt into
page layouts whose parts are known, named as pages name them, so that no page needs a label.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrisk.llm import words as W
from docrisk.llm.scratch import small_batches

#: A comment, a declaration, an end tag, a start tag, or a tag the page's end cuts off.
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Elements whose content is no text of the page: raw text, which runs to the page's end if it never ends, and
#: others, which are like any element if they never end or end at once. Some of these hold their own kind.
RAW = frozenset("script style title textarea xmp".split())
NESTED = frozenset("svg template select".split())
SKIPPED = RAW | NESTED | frozenset("noscript iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others bound blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br "
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
#: Start tags that end an open element of their own kind.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What such an end must not reach beyond.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ()}

PATH_BITS, WORD_BITS = 11, 11
PATH_SIZE, WORD_SIZE, HIDDEN = 24, 8, 24


@dataclass
class Block:
    """A run of text, its tag path's parts, and how many of its characters are in links."""

    text: str
    path: tuple[str, ...]
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """Parts of one element for the tag path."""
    found = [tag]
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            found += ["." + part.lower() for part in PART.findall(html.unescape(m[1] or m[2] or m[3] or ""))]
    return tuple(found)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of a kind ends, by where it starts; without those that never end."""
    found: dict[int, int] = {}
    opened: list[int] = []
    either = re.compile(
        r"<!--(?:.*?-->|.*\Z)|<(?:script|style|textarea|xmp)\b[^>]*(?<!/)>(?:.*?</(?:script|style|textarea|xmp)\b|.*\Z)"
        rf"|<(/?){tag}(?![^\s/>])((?>[^>\"']+|\"[^\"]*\"|'[^']*')*|[^>]*)>",
        re.I | re.S,
    )
    for m in either.finditer(page):
        if m[1]:
            if opened:
                found[opened.pop()] = m.end()
        elif m[1] is not None and not m[2].endswith("/"):
            opened.append(m.start())
    return found


def blocks(page: str | None) -> list[Block]:
    """A page's text blocks in order.

    Character references are decoded, white space inside a block becomes one space. Comments,
    scripts, styles and the like have no blocks; formulas and an object's fallback have. End tags
    without a start are ignored; elements that stay open end with their parent, raw text with the page.
    """
    if not page:
        return []
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    links = linked = 0
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()

    def end_of(tag: str, start: int, at: int) -> int | None:
        """Where a skipped element ends, None if it is to be read."""
        if tag in NESTED:
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            return ends[tag].get(start)
        if tag not in endless:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end:
                return end.end()
            endless.add(tag)
        return size if tag in RAW else None

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, path, linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal path, linked
        if not parts:
            if text.isspace():
                return
            path = tuple(x for _, names in stack for x in names)
        parts.append(text)
        if links:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag not in INLINE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    links = sum(x[0] == "a" for x in stack)
                    break
            continue
        start = m[2] or m[4]
        if not start:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3]))
            continue
        tag, attributes = start.lower(), m[3] or m[5] or ""
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag not in INLINE:
            close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDS.get(tag, ("p",)):
                    del stack[i:]
                    links = sum(x[0] == "a" for x in stack)
                    break
                if stack[i][0] in SCOPE.get(tag, ()) or stack[i][0] not in INLINE and tag not in SCOPE:
                    break
        if tag not in RAW and (tag in VOID or attributes.endswith("/")):
            continue
        end = end_of(tag, m.start(), at) if tag in SKIPPED else None
        if end is not None:
            at = end
        else:
            stack.append((tag, _names(tag, attributes)))
            links += tag == "a"
    close()
    return found


def _bucket(name: str, bits: int) -> int:
    value = 0xCBF29CE484222325
    for byte in name.encode():
        value = (value ^ byte) * 0x100000001B3 % (1 << 64)
    return (value ^ value >> 29) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - bits)


class Buckets(dict):
    """Table rows of path parts, worked out once each."""

    def __missing__(self, name: str) -> int:
        self[name] = row = _bucket(name, PATH_BITS)
        return row


def path_rows(path: tuple[str, ...], text: str, linked: int, rows: Buckets) -> list[int]:
    """Table rows of a block's path, its own tag, its length and its share of links."""
    own = next((x for x in reversed(path) if x[0] != "."), "")
    return [
        *(rows[x] for x in set(path)), rows[f"own {own}"],
        rows[f"length {min(len(text).bit_length(), 11)}"], rows[f"links {min(4 * linked // max(len(text), 1), 4)}"],
    ]


def word_rows(texts: list[str], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, table row) of every word of some texts."""
    w = W.words(texts, fold)
    return w.doc, (W.mix(w.hashes()) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


@dataclass
class Model:
    """Vectors of path parts and words, the LSTM's weights for both directions, and the output."""

    weights: dict[str, np.ndarray]


def _initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = PATH_SIZE + WORD_SIZE
    w = {"path": rng.normal(0, 0.1, (1 << PATH_BITS, PATH_SIZE)), "word": rng.normal(0, 0.1, (1 << WORD_BITS, WORD_SIZE))}
    for d in "fb":
        w["x" + d] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN))
        w["h" + d] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w["c" + d] = np.zeros(4 * HIDDEN)
        w["c" + d][HIDDEN : 2 * HIDDEN] = 1
    # the output reads both directions and the block itself
    return w | {"out": rng.normal(0, 0.1, 2 * HIDDEN + size), "bias": np.zeros(1)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, unit) of one direction; padding leaves the state as it is."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.zeros((steps, pages, HIDDEN))
    given = x @ w["x" + d] + w["c" + d]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ w["h" + d]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tanh))
        c = np.where(m, new, c)
        h = np.where(m, o * tanh, h)
        out[t] = h
    return out


def _back(dout: np.ndarray, x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], d: str, kept: list, grad: dict[str, np.ndarray]) -> np.ndarray:
    """Gradients of one direction through all its steps; returns that of its input."""
    dx = np.zeros_like(x)
    dh, dc = np.zeros(kept[0][1].shape), np.zeros(kept[0][1].shape)
    for t, h, c, i, f, o, g, tanh in reversed(kept):
        m = mask[t][:, None]
        dh = dh + dout[t]
        dn = np.where(m, dh, 0)
        dnew = np.where(m, dc, 0) + dn * o * (1 - tanh**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dn * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        grad["x" + d] += x[t].T @ dz
        grad["h" + d] += h.T @ dz
        grad["c" + d] += dz.sum(axis=0)
        dx[t] = dz @ w["x" + d].T
        dh = np.where(m, 0, dh) + dz @ w["h" + d].T
        dc = np.where(m, dnew * f, dc)
    return dx


def _inputs(paths: list[list[int]], words: list[np.ndarray], w: dict[str, np.ndarray]) -> np.ndarray:
    """Input vectors of blocks."""
    n = len(paths)
    of, row = np.repeat(np.arange(n), [len(p) for p in paths]), np.concatenate([*map(np.asarray, paths), np.zeros(0, int)]).astype(int)
    x = np.zeros((n, PATH_SIZE + WORD_SIZE))
    for k in range(PATH_SIZE):
        x[:, k] = np.bincount(of, w["path"][row, k], n)
    of, row = np.repeat(np.arange(n), [len(p) for p in words]), np.concatenate([*words, np.zeros(0, int)]).astype(int)
    size = np.maximum(np.bincount(of, minlength=n), 1)
    for k in range(WORD_SIZE):
        x[:, PATH_SIZE + k] = np.bincount(of, w["word"][row, k], n) / size
    return x


def _grid(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time and page of every block of some pages, and the mask (time, page)."""
    page = np.repeat(np.arange(len(sizes)), sizes)
    time = np.arange(len(page)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    mask = np.zeros((max(sizes, default=0), len(sizes)), bool)
    mask[time, page] = True
    return time, page, mask


def label(pages: list[tuple[list[list[int]], list[np.ndarray]]], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of being main text of every block of some pages (path rows and word rows)."""
    sizes = [len(p[0]) for p in pages]
    if not sum(sizes):
        return [np.zeros(0)] * len(pages)
    x = _inputs([b for p in pages for b in p[0]], [b for p in pages for b in p[1]], w)
    time, page, mask = _grid(sizes)
    grid = np.zeros((*mask.shape, x.shape[1]))
    grid[time, page] = x
    h = np.concatenate([_run(grid, mask, w, "f"), _run(grid, mask, w, "b"), grid], axis=2)
    p = _sigmoid((h @ w["out"] + w["bias"])[time, page])
    return np.split(p, np.cumsum(sizes)[:-1])


Example = tuple[list[list[int]], list[np.ndarray], np.ndarray]


def fit(examples: list[Example], *, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 2) -> Model:
    """Train by Adam on the logistic loss of every block, whole pages at a time."""
    w = _initial(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            part = [examples[k] for k in order[at : at + batch]]
            paths, words = [b for p in part for b in p[0]], [b for p in part for b in p[1]]
            wanted = np.concatenate([p[2] for p in part])
            if not len(wanted):
                continue
            x = _inputs(paths, words, w)
            time, page, mask = _grid([len(p[0]) for p in part])
            grid = np.zeros((*mask.shape, x.shape[1]))
            grid[time, page] = x
            kept: dict[str, list] = {"f": [], "b": []}
            h = np.concatenate([_run(grid, mask, w, "f", kept["f"]), _run(grid, mask, w, "b", kept["b"]), grid], axis=2)
            wrong = np.zeros(mask.shape)
            wrong[time, page] = (_sigmoid((h @ w["out"] + w["bias"])[time, page]) - wanted) / len(wanted)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"] = np.tensordot(wrong, h, 2)
            grad["bias"] = wrong.sum(keepdims=True).ravel()
            dh = wrong[:, :, None] * w["out"]
            dx = dh[:, :, 2 * HIDDEN :].copy()
            dx += _back(dh[:, :, :HIDDEN], grid, mask, w, "f", kept["f"], grad)
            dx += _back(dh[:, :, HIDDEN : 2 * HIDDEN], grid, mask, w, "b", kept["b"], grad)
            d = dx[time, page]
            for name, rows, part_ in (("path", paths, slice(0, PATH_SIZE)), ("word", words, slice(PATH_SIZE, None))):
                sizes = np.array([len(r) for r in rows])
                of = np.repeat(np.arange(len(rows)), sizes)
                row = np.concatenate([*map(np.asarray, rows), np.zeros(0, int)]).astype(int)
                share = 1 if name == "path" else 1 / np.maximum(sizes, 1)[of][:, None]
                np.add.at(grad[name], row, d[of][:, part_] * share)
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w)


#: How pages name their parts: the names that layouts for training are made of (fixed values).
MAIN_NAMES = "article main content post entry story body text page document blog news section column primary center single hentry".split()
OTHER_NAMES = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toolbar tabs links toc pagination pager skip".split(),
    "header": "header masthead top topbar logo branding banner site hero".split(),
    "footer": "footer foot bottom copyright legal imprint colophon credits".split(),
    "sidebar": "sidebar aside side rail widget complementary related recommended recent popular trending tags archive".split(),
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay banner dialog disclaimer privacy toast".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion commercial adsense dfp outbrain taboola".split(),
    "form": "form search login signup subscribe newsletter contact register input field share social".split(),
    "comments": "comment comments reply replies respond discussion disqus thread reader reviews responses".split(),
}
#: Elements of such parts.
OTHER_TAGS = {
    "menu": ("nav", "ul", "div"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"),
    "notice": ("div", "aside", "section"), "advert": ("div", "aside", "ins"), "form": ("form", "div"), "comments": ("div", "section", "ol"),
}
INSIDE = {"menu": (("ul", "li", "a"), ("a",), ("li",)), "form": (("label",), ("p",), ("div",), ()), "comments": (("p",), ("li", "p"), ("article", "p"), ("div",))}


def layouts(texts: list[list[str]], n: int, seed: int) -> list[list[tuple[Block, int]]]:
    """``n`` pages of known parts, filled with the blocks of sampled pages (texts of each page)."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    if not any(texts):
        return []
    texts = [t for t in texts if t]

    def box(tag: str, names: list[str], always: bool) -> tuple[str, ...]:
        if not always and rng.random() < 0.4:
            return (tag,)
        parts = [pick(names)] if rng.random() < 0.6 else [pick(names), pick(["wrapper", "container", "box", "area", "block", "inner", "list", "1", "main"])]
        return (tag, *("." + p for p in parts))

    def sentence(source: list[str]) -> str:
        words = pick(source).split()
        k = int(rng.integers(1, 25))
        return " ".join(words[:k]) or "-"

    pages = []
    for _ in range(n):
        outer = ("html", "body") + (box("div", ["page", "wrapper", "container", "site", "root", "app"], False) if rng.random() < 0.6 else ())

        def other(kind: str, above: tuple[str, ...], inside_main: bool = False) -> list[tuple[Block, int]]:
            tag = pick(OTHER_TAGS[kind])
            named = tag in ("nav", "header", "footer", "aside", "form")
            path = above + box(tag, OTHER_NAMES[kind], inside_main or not named)
            made = []
            for _ in range(int(rng.integers(2, 8)) if kind == "menu" else int(rng.integers(1, 4))):
                text = sentence(pick(texts))
                if kind == "menu":
                    text = " ".join(text.split()[:3])
                if kind == "comments" and rng.random() < 0.5:
                    text = pick(pick(texts))
                if kind == "footer" and rng.random() < 0.5:
                    text = "© " + text
                inside = pick(INSIDE.get(kind, (("p",), (), ("ul", "li"), ("span",), ("h2",), ("h3",))))
                made.append((Block(text, path + inside, len(text) if "a" in inside else 0), 0))
            return made

        before = [k for k in ("notice", "header", "menu", "advert", "form") if rng.random() < 0.45]
        after = [k for k in ("sidebar", "comments", "form", "menu", "advert", "notice", "footer") if rng.random() < 0.45]
        rng.shuffle(before)
        page = [b for k in before for b in other(k, outer)]
        tag = pick(["article", "article", "main", "div", "section", "td"])
        main = outer + (box("div", MAIN_NAMES, True) if rng.random() < 0.3 else ()) + box(tag, MAIN_NAMES, tag in ("div", "section", "td"))
        if rng.random() < 0.2:
            main = outer + ("table", "tr", "td") if rng.random() < 0.3 else outer + ("article",)
        body = pick(texts)
        for i, text in enumerate(body):
            inside = ("h1",) if i == 0 else pick([("p",)] * 8 + [("p", "b"), ("h2",), ("ul", "li"), ("blockquote", "p"), ("pre",), ("div",), ("ol", "li"), ("h3",), ("table", "tr", "td"), ("figure", "figcaption"), ()])
            page.append((Block(text if rng.random() < 0.8 else sentence(body), main + inside, 0), 1))
            # parts that stand inside the article are named
            if rng.random() < 0.08:
                page += other(pick(list(OTHER_NAMES)), main, True)
        if rng.random() < 0.15:
            page += other("comments", main, True)
        page += [b for k in after for b in other(k, outer)]
        pages.append(page)
    return pages


def learn(pages: DataFrame, *, n_pages: int = 200, n_layouts: int = 1200, max_blocks: int = 40, max_chars: int = 2000, seed: int = 2) -> Model:
    """Train on ``n_layouts`` layouts filled with blocks of at most ``n_pages`` pages, chosen by a
    seeded hash of the id; of each, at most ``max_blocks`` blocks, cut to ``max_chars``, which bounds the
    sample. No page's labels are known or needed.
    """
    small_batches(pages.sparkSession, 200)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[b.text[:max_chars] for b in blocks(page)[:max_blocks]] for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["texts"])

    ids = pages.where("page_id is not null and html is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id", F.lit(seed)), "page_id").limit(n_pages)
    sampled = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id").select("html")
    fills = sorted(list(r.texts) for r in sampled.mapInArrow(texts, "texts array<string>").toLocalIterator())
    rows, fold, examples = Buckets(), W.folding(), []
    for page in layouts(fills, n_layouts, seed):
        of, row = word_rows([b.text for b, _ in page], fold)
        words = np.split(row, np.searchsorted(of, np.arange(1, len(page))))
        examples.append(([path_rows(b.path, b.text, b.linked, rows) for b, _ in page], words, np.array([y for _, y in page], float)))
    return fit(examples, seed=seed)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Every page with its main text.

    One row per given row: ``page`` (a struct of all given columns but ``html``), ``text`` (blocks
    labelled as main text, in order, joined by one line feed), ``n_chars`` (its code points),
    ``n_blocks`` and ``n_kept``. The whole of every page is read. Null and empty pages, and pages
    without any text, get an empty text. An empty table gives an empty result.
    """
    weights = model.weights

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, fold = Buckets(), W.folding()
        for batch in batches:
            column = batch.column("html").to_pylist()
            for i, j in W.chunks(column):
                found = [blocks(p) for p in column[i:j]]
                texts = [b.text for page in found for b in page]
                of, row = word_rows(texts, fold)
                words = np.split(row, np.searchsorted(of, np.arange(1, len(texts)))) if texts else []
                begin = np.concatenate([[0], np.cumsum([len(p) for p in found])])
                read = [([path_rows(b.path, b.text, b.linked, rows) for b in page], words[begin[k] : begin[k + 1]]) for k, page in enumerate(found)]
                # pages of like length run together
                order = sorted(range(len(read)), key=lambda k: len(found[k]))
                kept: dict[int, list[str]] = {}
                for s in range(0, len(order), 64):
                    part = order[s : s + 64]
                    for k, p in zip(part, label([read[k] for k in part], weights), strict=True):
                        kept[k] = [b.text for b, y in zip(found[k], p.tolist(), strict=True) if y >= 0.5]
                out = ["\n".join(kept[k]) for k in range(len(found))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page").slice(i, j - i), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()),
                        pa.array([len(p) for p in found], pa.int64()), pa.array([len(kept[k]) for k in range(len(found))], pa.int64()),
                    ],
                    names=["page", "text", "n_chars", "n_blocks", "n_kept"],
                )

    small_batches(pages.sparkSession, 200)
    rows_ = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"]).alias("page"), F.col("html").cast("string").alias("html"))
    schema = T.StructType([
        rows_.schema["page"], T.StructField("text", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept")],
    ])
    return rows_.mapInArrow(extracted, schema)


def digest(extracted: DataFrame) -> DataFrame:
    """The contract's columns of ``extract``."""
    return extracted.select(F.col("page.page_id").alias("page_id"), F.col("page.url").alias("url"), "text", "n_chars")
