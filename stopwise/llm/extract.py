"""HTML main text by a recurrent block labeller.

A page is cut into blocks (runs of text between block-level tags), each with its tag path. A bidirectional LSTM in numpy
reads the sequence of blocks, as hashed tag-path and hashed-word vectors with a few figures, and says for each block
whether it belongs to the article. It is trained here, on pages made up by rule with a fixed seed, so it is the same in
every run and never sees the input. Pages are labelled in batches of like length.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RAW = {k: re.compile(rf"</{k}\s*>", re.I) for k in "script style noscript template iframe svg textarea title".split()}
_TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_CUT_OFF = re.compile(r"[a-zA-Z!?]|/[a-zA-Z]")
_TAG_BREAK = re.compile(r"[\"'>]")
_MARKS = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")
#: Elements without an end tag, and elements that stand inside a run of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: What an opening tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PATH_DIMS, WORD_DIMS, FIGURES, HIDDEN = 192, 24, 8, 20
#: Blocks that are read at once, of many short pages or as a stretch of a long one.
CELLS = 20_000


class _Tags:
    """Cuts a page into texts and tags in one pass over it, whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.last_end, self.last_data_end, self.quotes = page.rfind(">"), page.rfind("]]>"), True

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, outside quotes; once quotes do not close, the first ``>`` ends every tag."""
        start = at
        while self.quotes and (m := _TAG_BREAK.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            if m.start() >= self.last_quote[m[0]]:
                break
            at = self.page.index(m[0], m.end()) + 1
        self.quotes = False
        return self.page.find(">", start)

    def __iter__(self) -> Iterator[tuple[str, bool, str, str]]:
        """(text before, whether an end tag, tag or '', attributes); the text behind the last tag comes with the tag ''."""
        page, at, begun = self.page, 0, 0
        while (lt := page.find("<", at)) >= 0:
            kept = ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                end = len(page) if end < 0 else end + 3
                name = attrs = ""
                closes = False
            elif page.startswith("<![CDATA[", lt) and lt < self.last_data_end:
                end = page.index("]]>", lt) + 3
                kept, name, attrs, closes = page[lt + 9 : end - 3], "", "", False
            elif lt > self.last_end:  # as in browsers, a tag that the page's end cuts off is no text
                if _CUT_OFF.match(page, lt + 1):
                    break
                at = lt + 1
                continue
            elif page.startswith(("<!", "<?"), lt):
                end, name, attrs, closes = page.index(">", lt) + 1, "", "", False
            else:
                closes = page.startswith("</", lt)
                m = _TAG_NAME.match(page, lt + 1 + closes)
                if not m or (gt := self._tag_end(m.end())) < 0:
                    at = lt + 1
                    continue
                name, attrs, end = m[0].lower(), page[m.end() : gt], gt + 1
                if name in _RAW and not closes:
                    shut = _RAW[name].search(page, end)
                    end = shut.end() if shut else len(page)
            yield page[begun:lt] + kept, closes, name, attrs
            at = begun = end
        yield page[begun : lt if lt >= 0 else len(page)], False, "", ""


class Path:
    """Open tags and their marks, outermost first, with a bit for the slot of each; an element adds to its parent's path."""

    __slots__ = ("bits", "depth", "names", "parent")

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.depth, self.bits = (parent.depth + 1, parent.bits) if parent else (0, 0)
        for name in names:
            self.bits |= 1 << _slot(name, PATH_DIMS)

    def __iter__(self) -> Iterator[str]:
        levels, at = [], self
        while at:
            levels.append(at.names)
            at = at.parent
        return (name for names in reversed(levels) for name in names)


def blocks(page: str | None) -> list[tuple[Path, str, float]]:
    """(path of tags and their marks, text, share of it in links) of the non-empty blocks of a whole page, in page order."""
    root = Path(None, ())
    stack: list[tuple[str, Path]] = []
    opened: Counter = Counter()
    found: list[tuple[Path, str, float]] = []
    run: list[str] = []
    linked, in_link = 0, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            run.append(raw)
            linked += len(raw) if in_link else 0

    def close() -> None:
        nonlocal linked
        whole = " ".join("".join(run).split())
        if whole:
            found.append((stack[-1][1] if stack else root, whole, min(1.0, linked / len(whole))))
        run.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for before, closes, tag, attrs in _Tags(page or ""):
        text(before)
        if not tag or (tag in _RAW and tag != "textarea" and not closes):
            continue
        if tag == "textarea" and not closes:
            close()
            continue
        if tag == "a":
            in_link = 0 if closes else 1
        if tag == "br":
            run.append(" ")
        elif tag in INLINE:
            continue
        else:
            close()
            if closes:
                if opened[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in VOID:
                in_link = 0
                if stack and stack[-1][0] == "p":
                    pop()
                if stack and stack[-1][0] in _ENDS.get(tag, ()):
                    pop()
                marks = [n.lower() for got in _MARKS.findall(attrs) for n in _NAME.findall("".join(got))] if "=" in attrs else []
                stack.append((tag, Path(stack[-1][1] if stack else root, (tag, *("." + n for n in dict.fromkeys(marks))))))
                opened[tag] += 1
    close()
    return found


@lru_cache(1 << 16)
def _slot(kind: str, dims: int) -> int:
    return zlib.crc32(kind.encode("utf-8", "surrogatepass")) % dims


@lru_cache(1 << 14)
def _path_vector(bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def vectors(found: list[tuple[Path, str, float]], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """A row for each block from ``lo`` to ``hi``: hashed path, hashed words, and figures on length, links, place, depth and punctuation."""
    some, n = found[lo:hi], max(1, len(found))
    out = np.zeros((len(some), PATH_DIMS + WORD_DIMS + FIGURES), np.float32)
    for k, (path, text, linked) in enumerate(some):
        out[k, :PATH_DIMS] = _path_vector(path.bits)
        slots = [_slot(w, WORD_DIMS) for w in text.lower().split()]
        out[k, PATH_DIMS:-FIGURES] = np.bincount(slots, minlength=WORD_DIMS) / len(slots)
        size = len(text)
        out[k, -FIGURES:] = (np.log1p(size) / 8, linked, (lo + k) / n, (n - lo - k) / n, path.depth / 12, min(1, 20 * text.count(",") / size), min(1, 20 * text.count(".") / size), text[-1] in ".!?")
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, rng: np.random.Generator):
        d, h = PATH_DIMS + WORD_DIMS + FIGURES, HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 0.15, (d, 4 * h))
            self.p["u" + side] = rng.normal(0, 0.2, (h, 4 * h))
            self.p["c" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        self.p["o"], self.p["q"] = rng.normal(0, 0.2, 2 * h + d), np.zeros(1)

    def _read(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """Outputs, what the gradients need, and the state at the end, from which a further stretch goes on."""
        n, t, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        out, tape = np.zeros((n, t, HIDDEN)), []
        z_in = x @ self.p["w" + side] + self.p["c" + side]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = z_in[:, k] + h @ self.p["u" + side]
            g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            new = f * c + i * a
            s = np.tanh(new)
            if keep:
                tape.append((k, h, c, i, f, o, a, s, m))
            c, h = m * new + (1 - m) * c, m * (o * s) + (1 - m) * h
            out[:, k] = h
        return out, tape, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf, _ = self._read(x, mask, "f", keep)
        b, tb, _ = self._read(x, mask, "b", keep)
        wide = np.concatenate([f, b, x], 2)
        return self._said(wide), wide, tf, tb

    def _said(self, wide: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(wide @ self.p["o"] + self.p["q"], -30, 30)))

    def read_long(self, found: list[tuple[Path, str, float]], cells: int = CELLS) -> np.ndarray:
        """What :meth:`forward` says of one page, read by stretches of ``cells`` blocks: the whole page is the context, and
        only its outputs are kept."""
        stretches = [(lo, min(lo + cells, len(found))) for lo in range(0, len(found), cells)]
        back, state = np.zeros((len(found), HIDDEN), np.float32), None
        for lo, hi in reversed(stretches):
            x = vectors(found, lo, hi)[None].astype(np.float64)
            out, _, state = self._read(x, np.ones(x.shape[:2]), "b", False, state)
            back[lo:hi] = out[0]
        said, state = np.zeros(len(found)), None
        for lo, hi in stretches:
            x = vectors(found, lo, hi)[None].astype(np.float64)
            out, _, state = self._read(x, np.ones(x.shape[:2]), "f", False, state)
            said[lo:hi] = self._said(np.concatenate([out, back[None, lo:hi], x], 2))[0]
        return said

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        said, wide, tf, tb = self.forward(x, mask, True)
        d = (said - y) * mask / mask.sum()
        g = {"o": np.einsum("nt,ntd->d", d, wide), "q": np.array([d.sum()])}
        dh_all = d[:, :, None] * self.p["o"]
        for side, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
            u, dh, dc = self.p["u" + side], np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            dz_all, du = np.zeros((*x.shape[:2], 4 * HIDDEN)), np.zeros_like(u)
            for k, h, c, i, f, o, a, s, m in reversed(tape):
                dh = dh + dh_all[:, k, lo : lo + HIDDEN]
                on_h, on_c = dh * m, dc * m
                on_c = on_c + on_h * o * (1 - s * s)
                dz = np.concatenate([on_c * a * i * (1 - i), on_c * c * f * (1 - f), on_h * s * o * (1 - o), on_c * i * (1 - a * a)], 1)
                dz_all[:, k] = dz
                du += h.T @ dz
                dh, dc = dh * (1 - m) + dz @ u.T, dc * (1 - m) + on_c * f
            g["u" + side], g["c" + side] = du, dz_all.sum((0, 1))
            g["w" + side] = np.einsum("ntd,ntg->dg", x, dz_all)
        return g


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), t, rows[0].shape[1])), np.zeros((len(rows), t))
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


#: What the made-up training pages call their parts, and stock words of the parts that are not the article.
_PARTS = {
    "nav": ("nav menu navbar breadcrumb toc pagination skip", "home about contact login next previous menu search"),
    "header": ("header masthead banner topbar logo branding", "welcome to the site of our home"),
    "footer": ("footer bottom copyright legal colophon", "© copyright all rights reserved terms privacy imprint ·"),
    "aside": ("sidebar aside related widget popular recommended rail", "related stories most read more from trending popular tags"),
    "notice": ("cookie notice consent gdpr alert popup modal newsletter banner", "we use cookies accept this site uses consent subscribe newsletter sign up"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo adsbygoogle", "advertisement buy now sponsored offer sale click here"),
    "form": ("form search login signup contact", "name email password submit send search message"),
    "comments": ("comments comment replies disqus discussion responses", "reply said wrote great post thanks comment ago like"),
    "share": ("share social tags meta byline toolbar", "share tweet facebook follow us print email"),
}
#: Classes that say how an element looks, not what it is; on dressed pages they stand before the telling one.
_LOOKS = (
    "w-full md:w-1/2 px-4 mb-8 flex flex-col items-center justify-between text-gray-700 bg-white rounded-lg shadow-md border-t hidden lg:block grid gap-6 max-w-7xl mx-auto py-2 "
    "text-sm font-bold leading-tight space-y-4 hover:underline col-span-8 order-2 relative absolute z-10 row d-flex p-3 mt-4 w-100 overflow-hidden uppercase tracking-wide sm:inline"
).split()
_DRESSED = re.compile(r"<(div|section|article|main|nav|header|footer|aside|form|p|ul|li|h[1-4])\b([^>]*)>")


def made_page(rng: random.Random, dressed: float = 0.4) -> tuple[str, list[bool]]:
    """A page made up by rule and, for each of its blocks, whether it is of the article.

    A share ``dressed`` of the pages has elements with up to twelve classes of looks before the one that tells what they are.
    """
    looks = rng.random() < dressed

    def dress(m: re.Match) -> str:
        if rng.random() < 0.3:
            return m[0]
        names = " ".join(rng.sample(_LOOKS, rng.randint(1, 12)))
        attrs = m[2].replace('class="', f'class="{names} ') if 'class="' in m[2] else f'{m[2]} class="{names}"'
        return f"<{m[1]}{attrs}>"

    syllables = [rng.choice("bcdfglmnprstvwz") + rng.choice("aeiouéäñ") + rng.choice(["", "n", "r", "s", "t", "ch"]) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int = 1, hi: int = 25) -> str:
        end = rng.choice([".", ".", ".", ".", "", "?", "!"])
        extra = rng.choice(["", "", "", "***", "&amp;&amp;", "!!", " |", "###", "%%%"])
        return " ".join(word() + (extra if rng.random() < 0.7 else "") + ("," if rng.random() < 0.1 else "") for _ in range(rng.randint(lo, hi))).capitalize() + end

    def prose() -> str:
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 1, 2, 3, 5])))

    def small(kind: str) -> str:
        stock = _PARTS[kind][1].split()
        return " ".join(rng.choice(stock) if rng.random() < 0.5 else word() for _ in range(rng.randint(1, 10))) if rng.random() < 0.7 else prose()

    out: list[tuple[str, bool | None]] = []  # markup (None) and texts (whether article)
    put = lambda markup: out.append((_DRESSED.sub(dress, markup) if looks else markup, None))
    say = lambda text, main: out.append((text, main))

    def part(kind: str, inside: bool = False) -> None:
        names = _PARTS[kind][0].split()
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        tag = own if own != "div" and rng.random() < 0.6 else rng.choice(["div", "div", "section", own])
        marks = f' class="{rng.choice(names)}{rng.choice(["", "-box", " wide", "_1"])}"' if tag != own or own == "div" or rng.random() < 0.4 else ""
        put(f"<{tag}{marks}>")
        if kind in ("nav", "share", "aside") and rng.random() < 0.75:
            if rng.random() < 0.3:
                put("<h3>")
                say(small(kind), False)
                put("</h3>")
            put("<ul>")
            for _ in range(rng.randint(1, 8)):
                put("<li><a href='/x'>")
                say(word() if rng.random() < 0.6 else small(kind), False)
                put("</a></li>" if rng.random() < 0.8 else "</a>")
            put("</ul>")
        else:
            for _ in range(rng.choice([1, 1, 2, 3]) * (3 if kind == "comments" else 1)):
                wrap = rng.choice(["", "p", "div", "span", "h4"]) if kind != "form" else rng.choice(["label", "button", "p", "div"])
                put(f"<{wrap}>" if wrap else "")
                say(small(kind) if rng.random() < 0.8 else prose(), False)
                put(f"</{wrap}>" if wrap else "<br>")
                put("<hr>")
        put(f"</{tag}>")

    put("<!DOCTYPE html><html><head><title>" + word() + "</title><style>p{margin:0}</style></head><body>")
    shell = rng.random() < 0.3
    put('<div class="%s">' % rng.choice(["page", "wrapper", "container", "site"]) if shell else "")
    for kind in ("header", "nav", "notice", "ad", "aside", "share", "form"):
        if rng.random() < {"nav": 0.8, "header": 0.5, "ad": 0.5}.get(kind, 0.2):
            part(kind)
    main = rng.choice(["<article>"] * 5 + ["<main>", "<main><article>", '<div class="content">', '<div id="article">', '<div class="post">', '<section class="entry">', '<div class="story">'])
    put(main)
    if rng.random() < 0.9:
        put("<h1>")
        say(sentence(1, 12), True)
        put("</h1>")
    for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 20])):
        kind = rng.random()
        if kind < 0.06:
            part(rng.choice(["ad", "share", "aside", "notice", "form"]), True)
        elif kind < 0.12:
            put("<ul>")
            for _ in range(rng.randint(1, 4)):
                put("<li>")
                say(sentence(), True)
                put("</li>")
            put("</ul>")
        elif kind < 0.2:
            tag = rng.choice(["h2", "h3", "blockquote", "pre", "figcaption", "td"])
            put(f"<table><tr><{tag}>" if tag == "td" else f"<{tag}>")
            say(sentence(), True)
            put(f"</{tag}></tr></table>" if tag == "td" else f"</{tag}>")
        else:
            put("<p>" + rng.choice(["", "", "<b>"]))
            say(sentence(1, 3) if rng.random() < 0.15 else prose(), True)
            put(rng.choice(["</p>", "</p>", "</p>", "<br>", ""]))
            put("<hr>" if rng.random() < 0.02 else "")
    if rng.random() < 0.15:
        part("comments", True)
    for tag in reversed(re.findall(r"<(\w+)", main)):
        put(f"</{tag}>")
    for kind in ("share", "comments", "aside", "ad", "form", "notice", "nav", "footer"):
        if rng.random() < {"footer": 0.85, "comments": 0.35}.get(kind, 0.2):
            part(kind)
    put("</div>" if shell else "")
    put("</body></html>")
    # each text carries a mark by which its block is found again
    page = "".join(text if main is None else text + (" qqyes" if main else " qqno") for text, main in out)
    truth = ["qqyes" in text for _, text, _ in blocks(page)]
    return page.replace(" qqyes", "").replace(" qqno", ""), truth


def trained(seed: int = 5, pages: int = 1600, epochs: int = 14) -> Labeller:
    """The labeller, trained by Adam on made-up pages, in half a minute."""
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    rows, truths = [], []
    while len(rows) < pages:
        page, truth = made_page(draw)
        found = vectors(blocks(page))
        if len(found) == len(truth) and 0 < len(truth) <= 90:
            rows.append(found)
            truths.append(np.array(truth, float))
    model = Labeller(rng)
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    order = sorted(range(pages), key=lambda k: len(rows[k]))
    groups = [order[lo : lo + 40] for lo in range(0, pages, 40)]
    for epoch in range(epochs):
        rng.shuffle(groups)
        for group in groups:
            x, mask = padded([rows[k] for k in group])
            y = padded([truths[k][:, None] for k in group])[0][:, :, 0]
            x[:, :, PATH_DIMS : PATH_DIMS + WORD_DIMS] *= rng.random((len(x), 1, 1)) < 0.7
            x[:, :, :PATH_DIMS] *= rng.random((len(x), 1, PATH_DIMS)) > 0.03
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


_shared: dict[int, Labeller] = {}


def shared(spark: SparkSession, seed: int = 5) -> Labeller:
    """The trained labeller, made in one task, once per driver and seed; the driver gets its parameters, under a megabyte."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = trained(k).p
                cols = [pa.array(list(p)), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int32())), pa.array([v.tobytes() for v in p.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["name", "shape", "raw"])

    if seed not in _shared:
        made = spark.range(seed, seed + 1, 1, 1).mapInArrow(learn, "name string, shape array<int>, raw binary").collect()
        own = Labeller.__new__(Labeller)
        own.p = {r["name"]: np.frombuffer(r["raw"]).reshape(r["shape"]) for r in made}
        _shared[seed] = own
    return _shared[seed]


def labels(model: Labeller, rows: list[np.ndarray], cells: int = 3 * CELLS) -> list[np.ndarray]:
    """Whether each block is of the article; batches hold pages of like length and at most ``cells`` blocks, or one page."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    group: list[int] = []
    for at, k in enumerate(order):
        group.append(k)
        if at + 1 == len(order) or (len(group) + 1) * len(rows[order[at + 1]]) > cells or len(rows[order[at + 1]]) > 1.3 * len(rows[group[0]]) + 4:
            x, mask = padded([rows[g] for g in group])
            said = model.forward(x, mask)[0]
            for row, g in enumerate(group):
                out[g] = said[row, : len(rows[g])] >= 0.5
            group = []
    return out


def article(model: Labeller, pages: list[str | None]) -> list[str]:
    """The main text of each page. Pages are read together up to ``CELLS`` blocks; longer ones alone, by stretches."""
    out, found, group = [""] * len(pages), [], []

    def say(own: list[int], cut: list, said: list[np.ndarray]) -> None:
        for k, f, y in zip(own, cut, said, strict=True):
            out[k] = " ".join(b[1] for b, keep in zip(f, y, strict=True) if keep)

    for k, page in enumerate(pages):
        cut = blocks(page)
        if len(cut) > CELLS:
            say([k], [cut], [model.read_long(cut) >= 0.5])
            continue
        found.append(cut)
        group.append(k)
        if sum(map(len, found)) > CELLS:
            say(group, found, labels(model, [vectors(f) for f in found]))
            found, group = [], []
    say(group, found, labels(model, [vectors(f) for f in found]))
    return out


def main_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the article of every whole page, its blocks joined by one space.

    A null page is empty and gives ''. A tag that is not closed before the page ends is text; quotes that do not close end at
    the next ``>``. Repeated rows give a row each; null identifiers and urls are carried; other columns are not read. An
    empty table gives no rows. The model that is sent to the tasks has a fixed size (under a megabyte).
    """
    sent = pages.sparkSession.sparkContext.broadcast((model or shared(pages.sparkSession)).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller.__new__(Labeller)
        own.p = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                texts = article(own, part.column(2).to_pylist())
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
