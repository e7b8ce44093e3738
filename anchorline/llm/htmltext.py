"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, in order. Each block has its tag path (with class and id
words), its hashed words and a few counts; a bidirectional LSTM in numpy reads the whole
sequence and says of every block whether it is main text. It is trained on pages laid
out at random, with known labels, from block texts of a bounded sample of the table.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory
from .common import slices

#: Pages whose blocks give texts to the training pages, and blocks of each, at most, of at most so many characters.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS = 256, 24, 1200
#: Training pages, passes, pages of a step, step size.
PAGES, EPOCHS, BATCH, RATE = 500, 8, 32, 0.012
#: Hashed path words, their vector, hashed words, counts, hidden units of a direction.
PATH, EMBED, WORDS, NUMBERS, HIDDEN = 1024, 24, 64, 10, 20

#: Elements without an end tag, elements inside a block, elements whose content is no text, elements that a sibling ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror semantics annotation annotation-xml".split())
SILENT = frozenset("script style noscript template head title textarea select button svg annotation annotation-xml iframe object canvas audio video".split())
RAW = frozenset("script style textarea title".split())
ENDED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: What stands in a head; silent elements that a block ends if their own end tag is left out, and what they hold; what ends an open svg.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
OMITTED, HELD = frozenset("select button noscript".split()), INLINE | VOID | SILENT | {"option", "optgroup"}
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main nav header footer aside form figure".split())

#: Silent elements that leave the block around them whole.
QUIET = frozenset("script style template".split())

#: A comment (``<!-->`` and ``<!--->`` are whole, and ``--!>`` ends one too), a tag (quoted values may hold ``>``, unless a quote is never closed), or a declaration; each may be cut off by the end.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SELF_CLOSED = re.compile(r"(?<!=)(?:^|\s|[\"']|(?:^|\s)[^\s=]+)/\Z")
_AGAIN = {tag: re.compile(f"<(/?){tag}\\b", re.I) for tag in OMITTED}
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's words for the tag path: its name, and the words of its class, id and role."""
    found = [_CAMEL.sub(" ", a or b or c) for _, a, b, c in _ATTRIBUTE.findall(attributes)] if attributes else []
    return (f"<{tag}", *(w for x in found for w in _NAME.findall(x.lower())))


def _bit(word: str, before: bytes = b"") -> int:
    return crc32(before + word.encode("utf-8", "surrogatepass")) % PATH


class Path:
    """The words of an element and of those around it, outermost first. Elements share what is around them, and the buckets of all words are kept as bits, so one costs no more at any depth."""

    __slots__ = ("around", "last", "mask", "words")

    def __init__(self, around: Path | None = None, words: tuple[str, ...] = ()):
        self.around, self.words = around, words
        self.mask, self.last = (around.mask if around else 0), (_bit(words[0], b"last") if words else None)
        for word in words:
            self.mask |= 1 << _bit(word)

    def __iter__(self):
        parts, at = [], self
        while at is not None:
            parts.append(at.words)
            at = at.around
        return iter([w for ws in reversed(parts) for w in ws])

    def __getitem__(self, k):
        return tuple(self)[k]


class Open:
    """The elements that are open at a place of a page, in order, with what a step needs to know of them without going through all."""

    def __init__(self, page: str):
        self.page, self.top = page, Path()
        self.tags: list[str] = []
        self.paths: list[Path] = []
        self.counts: dict[str, int] = {}
        self.solid: list[int] = []
        self.marks: list[int] = []
        self.silent = 0
        self.next: dict[str, re.Match | None] = {}

    def path(self) -> Path:
        return self.paths[-1] if self.paths else self.top

    def push(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.solid.append(len(self.tags))
        if tag in SILENT or tag in ("foreignobject", "desc"):
            self.marks.append(len(self.tags))
        self.paths.append(self.path() if tag in INLINE else Path(self.path(), names(tag, attributes)))
        self.tags.append(tag)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in SILENT

    def cut(self, size: int) -> None:
        """Close all elements but the first so many."""
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.paths.pop()
            self.counts[tag] -= 1
            self.silent -= tag in SILENT
        while self.solid and self.solid[-1] >= size:
            self.solid.pop()
        while self.marks and self.marks[-1] >= size:
            self.marks.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the last element of its name and all in it; without one it does nothing."""
        if self.counts.get(tag):
            k = len(self.tags) - 1
            while self.tags[k] != tag:
                k -= 1
            self.cut(k)

    def again(self, name: str, at: int) -> re.Match | None:
        """The next tag of that name from a place on; places only grow."""
        known = self.next.get(name, False)
        if known is False or known is not None and known.start() < at:
            known = self.next[name] = _AGAIN[name].search(self.page, at)
        return known

    def stay(self, tag: str, at: int) -> int:
        """How many open elements stay so at a start tag inside a silent one, where end tags may be left out."""
        stay = len(self.tags)
        for k in reversed(self.marks):
            name = self.tags[k]
            if name == "head":
                return stay if tag in HEAD else k
            if name == "svg":
                if tag not in BREAKOUT:
                    return stay
                stay = k
            elif name in OMITTED:
                if tag != name:
                    if tag in HELD:
                        return stay
                    after = self.again(name, at)
                    if after and after[1]:
                        return stay
                stay = k
            else:
                return stay
        return stay


def blocks_of(page: str | None) -> list[tuple[Path, str, int]]:
    """``(path words, text, characters in links)`` of each leaf block with text, in page order.

    References are decoded in each piece of text between tags, then white space is folded. A page of any depth takes time in proportion to its length.
    """
    page = page or ""
    stack = Open(page)
    out: list[tuple[Path, str, int]] = []
    held: list[str] = []
    linked = at = 0

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((stack.path(), text, linked))
            held.clear()
            linked = 0

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else end
        if stack.silent and stack.tags[-1] == "head" and page[at:upto].strip():
            stack.cut(len(stack.tags) - 1)
        if not stack.silent and upto > at:
            held.append(html.unescape(page[at:upto]))
            linked += (upto - at) * bool(stack.counts.get("a"))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        breaks = tag not in INLINE and tag not in QUIET
        if m[1] and stack.silent:
            # What is inside of a silent element breaks no block, unless it ends the element.
            stack.end(tag)
            if breaks and not stack.silent:
                close()
            continue
        if stack.silent:
            stack.cut(stack.stay(tag, at))
        if breaks and not stack.silent:
            close()
        elif tag == "br" and not stack.silent:
            held.append(" ")
        if m[1]:
            stack.end(tag)
            continue
        if tag in VOID or tag in ("svg", "math") and _SELF_CLOSED.search(m[3]):
            continue
        if tag not in INLINE and tag not in QUIET and stack.solid:
            # Unclosed inline elements and a paragraph end where a new block begins.
            k = stack.solid[-1]
            if stack.tags[k] in ENDED_BY and (ENDED_BY[stack.tags[k]] is None or tag in ENDED_BY[stack.tags[k]]):
                stack.cut(k)
        stack.push(tag, m[3])
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else end
    close()
    return out


def word_bucket(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) % WORDS


_buckets = Memory(word_bucket, 1 << 16)


def path_key(path: Path | tuple[str, ...]) -> tuple[int, int | None]:
    """The buckets of a path's words as bits, and that of the last element's name apart."""
    if isinstance(path, Path):
        return path.mask, path.last
    mask = 0
    for word in path:
        mask |= 1 << _bit(word)
    last = max((k for k, w in enumerate(path) if w[0] == "<"), default=0)
    return mask, _bit(path[last], b"last") if path else None


def path_bits(path: Path | tuple[str, ...]) -> list[int]:
    """The numbers of those buckets."""
    mask, last = path_key(path)
    if last is not None:
        mask |= 1 << last
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")).tolist()


def numbers(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """Hashed words and counts of a page's blocks, one row each."""
    x = np.zeros((len(blocks), WORDS + NUMBERS), np.float32)
    for k, (_, text, linked) in enumerate(blocks):
        words = text.lower().split(" ")
        n = len(words)
        x[k, :WORDS] = np.bincount(list(map(_buckets.__getitem__, words)), minlength=WORDS) / n
        x[k, WORDS:] = np.log1p(n) / 4, n <= 3, n >= 12, min(1.0, linked / len(text)), text[-1] in ".!?…", text.count(".") / n, text.count(",") / n, text[0].isupper(), k / len(blocks), 1
    return x


@dataclass
class Labeller:
    """Parameters: path vectors, then for each direction input, recurrent and bias weights, then the output."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        size = EMBED + WORDS + NUMBERS
        p = {"path": rng.normal(0, 0.3, (PATH, EMBED)), "out": rng.normal(0, 0.1, (2 * HIDDEN, 1)), "out_bias": np.zeros(1)}
        for d in "fb":
            p |= {f"{d}x": rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN)), f"{d}h": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)), f"{d}b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, paths: list[tuple[str, ...]], x: np.ndarray) -> np.ndarray:
        known: dict[tuple, int] = {}
        at = [known.setdefault(path_key(path), len(known)) for path in paths]
        first = {k: path for k, path in zip(reversed(at), reversed(paths), strict=True)}
        vectors = np.array([self.p["path"][path_bits(first[k])].sum(axis=0) for k in range(len(known))], np.float32).reshape(-1, EMBED)
        return np.concatenate([vectors[at], x], axis=1)

    def score(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """Main-text log odds of each block of each page; all pages that still run take a step together."""
        lengths = np.array([len(b) for b in pages])
        order = np.argsort(-lengths, kind="stable")
        if not len(pages) or not lengths[order[0]]:
            return [np.zeros(0)] * len(pages)
        x = self.inputs([path for k in order for path, *_ in pages[k]], np.concatenate([numbers(pages[k]) for k in order]))
        size, starts = lengths[order], np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
        running = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        z = np.full(len(x), self.p["out_bias"][0])
        for d in "fb":
            given = x @ self.p[f"{d}x"] + self.p[f"{d}b"]
            out = self.p["out"][:HIDDEN, 0] if d == "f" else self.p["out"][HIDDEN:, 0]
            h = c = np.zeros((len(size), HIDDEN), np.float32)
            for t, n in enumerate(running):
                at = starts[:n] + (t if d == "f" else size[:n] - 1 - t)
                h, c, _ = step(given[at] + h[:n] @ self.p[f"{d}h"], c[:n])
                z[at] += h @ out
        found: list = [None] * len(pages)
        for k, page in enumerate(order):
            found[page] = z[starts[k] : starts[k] + size[k]]
        return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def step(gates: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """One LSTM step from summed gate inputs (input, forget, output, candidate)."""
    s = sigmoid(gates[:, : 3 * HIDDEN])
    i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(gates[:, 3 * HIDDEN :])
    new = f * c + i * g
    tanh = np.tanh(new)
    return o * tanh, new, (i, f, o, g, c, tanh)


def gradients(net: Labeller, pages: list[tuple[list[tuple], np.ndarray]]) -> dict[str, np.ndarray]:
    """Of the mean logistic loss over all blocks, by back-propagation through the page."""
    p = net.p
    longest, count = max(len(y) for _, y in pages), len(pages)
    shape = (longest, count)
    there = np.zeros(shape, bool)
    x, y = np.zeros((*shape, EMBED + WORDS + NUMBERS), np.float32), np.zeros(shape, np.float32)
    back = np.zeros(shape, int)
    for k, (blocks, labels) in enumerate(pages):
        n = len(labels)
        there[:n, k], y[:n, k] = True, labels
        x[:n, k] = net.inputs([b[0] for b in blocks], numbers(blocks))
        back[:, k] = np.concatenate([np.arange(n)[::-1], np.arange(n, longest)])
    column = np.arange(count)
    states, z = {}, np.full(shape, p["out_bias"][0])
    for d in "fb":
        xs = x if d == "f" else x[back, column]
        given = xs @ p[f"{d}x"] + p[f"{d}b"]
        h = c = np.zeros((count, HIDDEN), np.float32)
        hs, kept = [h], []
        for t in range(longest):
            h, c, memory = step(given[t] + h @ p[f"{d}h"], c)
            hs.append(h)
            kept.append(memory)
        hs = np.stack(hs)
        states[d] = xs, hs, kept
        own = hs[1:] @ p["out"][:HIDDEN if d == "f" else None][0 if d == "f" else HIDDEN :, 0]
        z += own if d == "f" else own[back, column]
    wrong = (sigmoid(z) - y) * there / there.sum()
    g = {"out_bias": np.array([wrong.sum()], np.float32), "out": np.zeros_like(p["out"]), "path": np.zeros_like(p["path"])}
    dx = np.zeros_like(x)
    for d in "fb":
        xs, hs, kept = states[d]
        part = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        own = wrong if d == "f" else wrong[back, column]
        g["out"][part, 0] = np.einsum("tb,tbh->h", own, hs[1:])
        dgates = np.zeros((longest, count, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((count, HIDDEN), np.float32)
        for t in range(longest - 1, -1, -1):
            i, f, o, cand, before, tanh = kept[t]
            dh = dh + own[t][:, None] * p["out"][part, 0]
            dc = dc + dh * o * (1 - tanh**2)
            dgates[t] = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - cand**2)], axis=1)
            dh, dc = dgates[t] @ p[f"{d}h"].T, dc * f
        flat = dgates.reshape(-1, 4 * HIDDEN)
        g[f"{d}x"], g[f"{d}b"] = xs.reshape(len(flat), -1).T @ flat, flat.sum(axis=0)
        g[f"{d}h"] = hs[:-1].reshape(len(flat), -1).T @ flat
        more = (flat @ p[f"{d}x"].T).reshape(x.shape)
        dx += more if d == "f" else more[back, column]
    for k, (blocks, labels) in enumerate(pages):
        for t in range(len(labels)):
            g["path"][path_bits(blocks[t][0])] += dx[t, k, :EMBED]
    return g


#: Containers of main text and of everything else, as (tag, class words, how its texts are laid out).
MAIN = [("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article body"), ("div", "post content"), ("div", "entry content"), ("section", "story"), ("div", "main text"), ("div", "page")]
REST = [
    ("nav", "", "links"), ("nav", "menu", "links"), ("ul", "menu navigation", "links"), ("div", "nav", "links"), ("div", "breadcrumb", "links"), ("header", "", "short"), ("header", "site header", "links"), ("div", "header top", "short"),
    ("footer", "", "short"), ("footer", "site footer", "links"), ("div", "footer bottom", "short"), ("aside", "", "prose"), ("aside", "sidebar", "links"), ("div", "sidebar", "prose"), ("div", "widget", "links"), ("div", "related", "links"),
    ("div", "ad", "short"), ("div", "ad", "prose"), ("div", "ads banner", "short"), ("div", "advert", "prose"), ("div", "advertisement sponsored", "short"), ("div", "promo", "prose"), ("section", "promotion", "short"),
    ("div", "cookie notice", "prose"), ("div", "notice", "prose"), ("div", "consent banner", "short"), ("div", "alert", "short"), ("div", "popup modal", "prose"), ("form", "", "form"), ("form", "search", "form"), ("form", "newsletter subscribe", "form"),
    ("div", "share social", "links"), ("section", "comments", "comments"), ("div", "comments", "comments"), ("ol", "comment list", "comments"), ("div", "comment", "prose"), ("div", "replies", "comments"), ("div", "login", "form"), ("div", "copyright", "short"), ("div", "pagination", "links"), ("div", "tags", "links"),
]


def training_page(rng: np.random.Generator, prose: list[str], short: list[str]) -> list[tuple[tuple[tuple[str, ...], str, int], int]]:
    """Blocks with labels of a page laid out at random: other blocks, main text with some of them inside it, other blocks."""

    def take(pool: list[str]) -> str:
        return pool[rng.integers(len(pool))]

    def some(kind: str, around: tuple[str, ...]) -> list[tuple[tuple[tuple[str, ...], str, int], int]]:
        if kind == "links":
            texts = [take(short) for _ in range(rng.integers(2, 9))]
            inner = [("<ul", "<li"), ("<li",), ("<div",)][rng.integers(3)]
            return [((around + inner, t, len(t)), 0) for t in texts]
        if kind == "form":
            return [((around + [("<div",), ("<p",), ()][rng.integers(3)], take(short), 0), 0) for _ in range(rng.integers(1, 4))]
        if kind == "comments":
            inner = [("<div", "comment"), ("<article", "comment"), ("<li", "comment"), ("<li",), ("<div", "comment", "<p")][rng.integers(5)]
            return [((around + inner, take(prose), 0), 0) for _ in range(rng.integers(1, 6))]
        pool = prose if kind == "prose" else short
        inner = [("<p",), (), ("<div",), ("<h3",)][rng.integers(4)]
        return [((around + inner, t, len(t) if rng.random() < 0.2 else 0), 0) for t in (take(pool) for _ in range(rng.integers(1, 3)))]

    def other(around: tuple[str, ...], count: int) -> list:
        made = []
        for _ in range(count):
            tag, words, kind = REST[rng.integers(len(REST))]
            made += some(kind, (*around, f"<{tag}", *words.split()))
        return made

    outer = [("<html", "<body"), ("<html", "<body", "<div"), ("<html", "<body", "<div", "container"), ("<html", "<body", "<div", "wrapper", "page")][rng.integers(4)]
    tag, words = MAIN[rng.integers(len(MAIN))]
    main = (*outer, f"<{tag}", *words.split())
    body = []
    if rng.random() < 0.85:
        body.append(((main + [("<h1",), ("<h2",), ("<header", "<h1")][min(2, rng.integers(8))], take(prose)[:90], 0), 1))
    for _ in range(rng.integers(1, 16)):
        kind = rng.random()
        text = take(prose) if rng.random() < 0.85 else take(short)
        inner = ("<p",) if kind < 0.75 else ("<ul", "<li") if kind < 0.82 else ("<blockquote",) if kind < 0.88 else ("<h2",) if kind < 0.94 else ("<div",) if kind < 0.97 else ("<td",)
        body.append(((main + inner, text, int(len(text) * 0.2 * (rng.random() < 0.2))), 1))
        if rng.random() < 0.08:
            body += other(main, 1)
    return other(outer, rng.integers(0, 5)) + body + other(outer, rng.integers(0, 5))


def train(texts: list[str], pages: int = PAGES, epochs: int = EPOCHS, seed: int = 3) -> Labeller:
    """A labeller trained by Adam on pages laid out from ``texts``; without texts it is untrained and calls nothing main text."""
    net, rng = Labeller.new(seed), np.random.default_rng(seed)
    prose, short = [t for t in texts if t.count(" ") >= 7], [" ".join(t.split()[: 1 + k % 6]) for k, t in enumerate(texts)]
    if not prose:
        net.p["out_bias"][:] = -30
        net.p["out"][:] = 0
        return net
    made = []
    for _ in range(pages):
        page = training_page(rng, prose, short)
        made.append(([b for b, _ in page], np.array([y for _, y in page], np.float32)))
    made.sort(key=lambda x: len(x[1]))
    batches = [made[k : k + BATCH] for k in range(0, len(made), BATCH)]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            t += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in gradients(net, batches[b]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """Train on block texts of a bounded number of pages, those of least hashed id."""

    def texts(batches):
        for part in slices(batches):
            found = [t[:SAMPLE_CHARS] for page in part.column(1).to_pylist() for _, t, _ in sorted(blocks_of(page), key=lambda b: crc32(b[1].encode("utf-8", "surrogatepass")))[:SAMPLE_BLOCKS]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    some = pages.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", F.col("html").cast("string").alias("html"))
    return train(sorted({r["text"] for r in some.mapInArrow(texts, "text string").collect()}))


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """``page_id, url, text, blocks, main_blocks`` of each row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without main text, have the empty text; repeated rows are read alike;
    an unfinished page is read to its end; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in slices(batches):
            blocks = [blocks_of(page) for page in part.column(2).to_pylist()]
            chosen = [[b[1] for b, z in zip(own, odds, strict=True) if z > 0] for own, odds in zip(blocks, shared.value.score(blocks), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(["\n".join(c) for c in chosen], pa.string()), pa.array(map(len, blocks), pa.int64()), pa.array(map(len, chosen), pa.int64())], ["page_id", "url", "text", "blocks", "main_blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, blocks long, main_blocks long")


def query(pages: DataFrame) -> DataFrame:
    """Train on the table and extract every page, under the contract."""
    return extract(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
