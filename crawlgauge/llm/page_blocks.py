"""HTML extraction: a bidirectional LSTM in numpy labels every text block of a page as main text or not.

A page is cut into leaf blocks in page order. Each block becomes a vector of its hashed tag path (tags, class and id
words of its open elements), its hashed words and a few sizes; the network reads the whole sequence from both ends, so
each block is judged by the entire page. Blocks judged main text are joined.

The network is trained here, on the driver, on a bounded, documented sample of the corpus' own pages (``N_PAGES``). The
training labels come from the meaning of tags and common class names (``rule_labels``); half of the training pages lose
their semantic tags or gain foreign parts, so that it learns paths, words and neighbours rather than one tag. Labelling
is a map over all pages, whole HTML, without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgauge.llm.common import by_hash, prepared, table

N_PAGES = 160
#: Longer training pages are learned in stretches of so many blocks, one after another.
STRETCH = 64
HIDDEN = 20
PATH_SLOTS, WORD_SLOTS, SIZES = 512, 32, 5
WIDTH = PATH_SLOTS + WORD_SLOTS + SIZES
SEED = 11

TOKEN = re.compile(r"""<!--.*?(?:--\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN_TEXT = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "math"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Open elements that a new element of the same kind ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDABLE = {tag for tags in ENDS.values() for tag in tags}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body"}

FOREIGN_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "option", "label"}
FOREIGN_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ENDABLE |= SCOPES
TAG_BEGIN = re.compile("/?[a-zA-Z]")
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, {"article", "main", "content", "post", "entry", "story"}


class Element:
    """An open element and, by ``parent``, all that are open around it; what its path says is worked out once."""

    __slots__ = ("tag", "names", "parent", "depth", "in_link", "foreign", "main", "slots", "block", "end")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 1
        self.in_link = tag == "a" or bool(parent and parent.in_link)
        self.foreign = tag in FOREIGN_TAGS or bool(FOREIGN_NAMES.intersection(names)) or bool(parent and parent.foreign)
        self.main = tag in MAIN_TAGS or bool(MAIN_NAMES.intersection(names)) or bool(parent and parent.main)
        self.slots = parent.slots if parent else 0
        for word in (tag, *("." + name for name in names)):
            self.slots |= 1 << zlib.crc32(word.encode()) % PATH_SLOTS
        # the nearest that is no inline element, and the nearest that another may end or that keeps ends inside
        self.block = self if tag not in INLINE or not parent else parent.block
        self.end = self if tag in ENDABLE or not parent else parent.end


def element_of(path: tuple[tuple[str, tuple[str, ...]], ...], above: Element | None = None) -> Element | None:
    for tag, names in path:
        above = Element(tag, names, above)
    return above


class Block:
    """One leaf block: its text with plain spaces, its innermost open element, and characters inside links."""

    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element | None, linked: int):
        self.text, self.element, self.linked = text, element, linked

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """(tag, names) of the open elements from the root."""
        out, at = [], self.element
        while at:
            out.append((at.tag, at.names))
            at = at.parent
        return tuple(reversed(out))


class TagEnds:
    """Ends of tags of a page that has one without an end: each ``<`` is answered by the marks behind it, worked out once.

    A tag ends at the next ``>`` outside quotes; a quote that never closes leaves all tags before it without an end.
    """

    def __init__(self, page: str):
        marks = [m.start() for m in re.finditer("[\"'>]", page)]
        ends, later = [-1] * (len(marks) + 1), {'"': -1, "'": -1}
        for k in range(len(marks) - 1, -1, -1):
            mark = page[marks[k]]
            if mark == ">":
                ends[k] = marks[k]
            else:
                ends[k] = ends[later[mark] + 1] if later[mark] >= 0 else -1
                later[mark] = k
        self.marks, self.ends = marks, ends

    def has_end(self, at: int) -> bool:
        return self.ends[bisect_left(self.marks, at)] >= 0


def names_of(attributes: str) -> tuple[str, ...]:
    if not attributes:
        return ()
    found: list[str] = []
    for _, value in NAMES.findall(attributes):
        found += re.findall("[a-z]+", value.strip("\"'").lower())
    return tuple(found)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of the whole page in order; null or empty HTML has none. Linear in the page, however it is made."""
    page = page or ""
    out: list[Block] = []
    top: Element | None = None
    open_: Counter = Counter()
    pieces: list[str] = []
    leaf: tuple[Element | None] | None = None
    ends: TagEnds | None = None
    linked, at, n = 0, 0, len(page)

    def flush() -> None:
        nonlocal pieces, leaf, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, leaf[0] if leaf else None, linked))
            pieces, leaf, linked = [], None, 0

    def close(element: Element) -> None:
        """End ``element`` and all open inside it."""
        nonlocal top
        while top is not element:
            open_[top.tag] -= 1
            top = top.parent
        open_[top.tag] -= 1
        top = top.parent

    while at < n:
        if ends and page[at] == "<" and page[at + 1 : at + 2] not in ("!", "?") and not ends.has_end(at):
            token, at, tag, piece = None, at + 1, None, "<"
        else:
            token = TOKEN.match(page, at)
            at, tag, piece = token.end(), token.group(2), token.group()
        if tag is None:
            if piece.startswith(("<!", "<?")) and len(piece) > 1:
                continue
            if piece == "<" and ends is None and TAG_BEGIN.match(page, at):
                ends = TagEnds(page)
            text = entities.unescape(piece)
            if leaf is None and not text.isspace():
                leaf = (top,)
            pieces.append(text)
            if top and top.in_link:
                linked += len(text)
            continue
        tag = tag.lower()
        if token.group(1):
            if tag not in INLINE:
                flush()
            if open_[tag]:
                found = top
                while found.tag != tag:
                    found = found.parent
                close(found)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in HIDDEN_TEXT:
            if not token.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag in ENDS:
            found = top.end if top else None
            while found and found.tag not in ENDS[tag] and found.tag not in SCOPES:
                found = found.parent.end if found.parent else None
            if found and found.tag in ENDS[tag]:
                close(found)
        elif tag not in INLINE and top and top.block.tag == "p":  # a paragraph ends where a block begins
            close(top.block)
        top = Element(tag, names_of(token.group(3)), top)
        open_[tag] += 1
    flush()
    return out


def rule_labels(blocks: list[Block]) -> np.ndarray:
    """Training labels: main text is what stands in an article or main part (anywhere, if there is none) and in no part
    whose tag or name says that it is something else."""

    some = any(b.element and b.element.main for b in blocks)
    return np.array([not (b.element and b.element.foreign) and (not some or bool(b.element and b.element.main)) for b in blocks], bool)


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        if b.element:
            x[i, :PATH_SLOTS] = np.unpackbits(np.frombuffer(b.element.slots.to_bytes(PATH_SLOTS // 8, "little"), np.uint8), bitorder="little")
            x[i, zlib.crc32(b"leaf " + b.element.tag.encode()) % PATH_SLOTS] = 1
        words = b.text.lower().split()
        for word in words:
            code = zlib.crc32(word.encode("utf-8", "replace"))
            x[i, PATH_SLOTS + (code >> 1) % WORD_SLOTS] += 1 if code & 1 else -1
        x[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] /= 3 * max(1.0, float(np.linalg.norm(x[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS])))
        n = len(b.text)
        x[i, -SIZES:] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, b.linked / max(n, 1), i / len(blocks), sum(b.text.count(c) for c in ".,") / max(len(words), 1))
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Two LSTMs, one from each end, and a logistic layer over both states of each block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, hidden: int = HIDDEN):
        draw = np.random.default_rng(SEED)
        self.hidden = hidden
        self.w = weights or {k: w.astype(np.float32) for k, w in {
            **{f"{d}x": draw.normal(0, 0.08, (WIDTH, 4 * hidden)) for d in "fb"},
            **{f"{d}h": draw.normal(0, 0.2, (hidden, 4 * hidden)) for d in "fb"},
            **{f"{d}c": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]) for d in "fb"},
            "o": draw.normal(0, 0.3, 2 * hidden),
            "o0": np.zeros(1),
        }.items()}

    def _run(self, x: np.ndarray, on: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States over (pages, blocks); blocks that are padding keep the state. ``x`` is in reading order for ``d``."""
        n, t, k = len(x), x.shape[1], self.hidden
        given = x @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states, kept = np.zeros((n, t, k), np.float32), []
        for i in range(t):
            z = given[:, i] + h @ self.w[f"{d}h"]
            a, f, o, g = sigmoid(z[:, :k]), sigmoid(z[:, k : 2 * k]), sigmoid(z[:, 2 * k : 3 * k]), np.tanh(z[:, 3 * k :])
            new = f * c + a * g
            out = o * np.tanh(new)
            live = on[:, i, None]
            kept.append((h, c, a, f, o, g, new, live))
            h, c = np.where(live, out, h), np.where(live, new, c)
            states[:, i] = h
        return states, kept

    def _back(self, x: np.ndarray, kept: list, d_states: np.ndarray, d: str) -> dict[str, np.ndarray]:
        n, t, k = len(x), x.shape[1], self.hidden
        d_given, d_wh = np.zeros((n, t, 4 * k), np.float32), np.zeros_like(self.w[f"{d}h"])
        dh, dc = np.zeros((n, k)), np.zeros((n, k))
        for i in range(t - 1, -1, -1):
            h, c, a, f, o, g, new, live = kept[i]
            dh = dh + d_states[:, i]
            now, tanh = np.where(live, dh, 0), np.tanh(new)
            dnew = np.where(live, dc, 0) + now * o * (1 - tanh**2)
            dz = np.concatenate([dnew * g * a * (1 - a), dnew * c * f * (1 - f), now * tanh * o * (1 - o), dnew * a * (1 - g**2)], axis=1)
            d_given[:, i] = dz
            d_wh += h.T @ dz
            dh = np.where(live, dz @ self.w[f"{d}h"].T, dh)
            dc = np.where(live, dnew * f, dc)
        return {f"{d}x": x.reshape(-1, x.shape[2]).T @ d_given.reshape(-1, 4 * k), f"{d}h": d_wh, f"{d}c": d_given.sum((0, 1))}

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(pages), max(map(len, pages)), WIDTH), np.float32)
        on = np.zeros(x.shape[:2], bool)
        for i, p in enumerate(pages):
            x[i, : len(p)], on[i, : len(p)] = p, True
        return x, on

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of main text for every block of every page; pages of like length share a pass, memory is bounded."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            take = max(1, min(len(order), 8000 // len(pages[order[-1]])))
            some, order = order[-take:], order[:-take]
            x, on = self.padded([pages[i] for i in some])
            f, _ = self._run(x, on, "f")
            b, _ = self._run(x[:, ::-1], on[:, ::-1], "b")
            p = sigmoid(np.concatenate([f, b[:, ::-1]], axis=2) @ self.w["o"] + self.w["o0"])
            for row, i in enumerate(some):
                out[i] = p[row, : len(pages[i])]
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 18, batch: int = 48, rate: float = 0.02) -> BlockLabeller:
        """Adam over batches, back-propagation through time, in a fixed order, the step falling to nothing."""
        pairs = [(p, y) for p, y in zip(pages, labels, strict=True) if len(p)]
        if not pairs:
            return self
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        draw, step = np.random.default_rng(SEED), 0
        for turn in range(rounds):
            order, pace = draw.permutation(len(pairs)), rate * 0.5 * (1 + np.cos(np.pi * turn / rounds))
            for start in range(0, len(order), batch):
                some = [pairs[i] for i in order[start : start + batch]]
                x, on = self.padded([p for p, _ in some])
                y = np.zeros(on.shape)
                for i, (_, label) in enumerate(some):
                    y[i, : len(label)] = label
                f, f_kept = self._run(x, on, "f")
                b, b_kept = self._run(x[:, ::-1], on[:, ::-1], "b")
                both = np.concatenate([f, b[:, ::-1]], axis=2)
                gap = ((sigmoid(both @ self.w["o"] + self.w["o0"]) - y) * on / on.sum()).astype(np.float32)
                d_both = gap[:, :, None] * self.w["o"]
                k = self.hidden
                grad = {"o": np.einsum("nt,ntk->k", gap, both), "o0": np.array([gap.sum()])}
                grad |= self._back(x, f_kept, d_both[:, :, :k], "f")
                grad |= self._back(x[:, ::-1], b_kept, d_both[:, ::-1, k:], "b")
                step += 1
                for key, g in grad.items():
                    m[key] = 0.9 * m[key] + 0.1 * g
                    v[key] = 0.999 * v[key] + 0.001 * g * g
                    self.w[key] = self.w[key] - pace * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
        return self


#: Places of main text in the changed copies of training pages; None leaves the page's own.
MAIN_PLACES = [
    None, None, "article", "main/article", "main", "main.content", "div.content", "div.page/div.content", "div.post", "div.container/div.entry", "section.story", "div.wrapper/main/article.post",
]
MAIN_LEAVES = ["p", "p", "p", "p", "h1", "h2", "h3", "ul/li", "ul/li", "ol/li", "blockquote", "table/tr/td", "pre", "section/p", "div", "figure/figcaption", "div/p", "p/b", "p/em", "h2/b"]
FOREIGN_LEAVES = ["p", "p", "ul/li", "ul/li/a", "div", "h2", "h3", "span", "a", "button", "form/label", "div/p", "p/b", "ol/li/p", "section/p", "div.text/p", "article/p", "article.item/h3"]
COPIES = 3


def _path(place: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    steps = [step.partition(".") for step in place.split("/")]
    return tuple((tag, (name,) if name else ()) for tag, _, name in steps)


def variants(blocks: list[Block], labels: np.ndarray, draw: np.random.Generator) -> list[tuple[list[Block], np.ndarray]]:
    """The page as it is, and copies whose main text stands elsewhere and which have foreign parts before, in and after it."""
    pick = lambda some: some[int(draw.integers(len(some)))]
    out, names, tags = [(blocks, labels)], sorted(FOREIGN_NAMES), sorted(FOREIGN_TAGS - {"head", "option"})
    outer = element_of((("html", ()), ("body", ())))
    for _ in range(COPIES if blocks else 0):
        place = pick(MAIN_PLACES)
        copies, marks = [], []
        for block, label in zip(blocks, labels, strict=True):
            element = block.element
            if label and place:
                element = element_of(_path(place) + _path(pick(MAIN_LEAVES)), outer)
            linked = int(len(block.text) * draw.random() * 0.6) if label and draw.integers(3) == 0 else block.linked
            copies.append(Block(block.text, element, linked))
            marks.append(bool(label))
        inside = next((b.element.parent for b, y in zip(copies, marks, strict=True) if y and b.element), outer)
        if place:
            inside = element_of(_path(place), outer)
        for _ in range(int(draw.integers(0, 6))):
            part = (pick(tags), ()) if draw.integers(2) else (pick(["div", "div", "section", "aside", "ul", "p", "span", "table"]), (pick(names),) if draw.integers(3) else (pick(names), pick(names)))
            above = inside if draw.integers(2) else outer
            leaf = _path(pick(FOREIGN_LEAVES))
            at = int(draw.integers(len(copies) + 1))
            added = [Block(pick(blocks).text, element_of((part, *leaf), above), 0) for _ in range(int(draw.integers(1, 5)))]
            for b in added:
                b.linked = len(b.text) if b.element.in_link else 0
            copies[at:at] = added
            marks[at:at] = [False] * len(added)
        out.append((copies, np.array(marks, bool)))
    return out


def train(pages: DataFrame, n_pages: int = N_PAGES) -> BlockLabeller:
    """Fit on about ``n_pages`` distinct pages, chosen by a hash; only the HTML of these leaves the tasks."""
    filled = pages.select("html", F.xxhash64("html").alias("__hash")).where("html IS NOT NULL")
    sample = filled.where(by_hash("__hash", n_pages, filled.count())).dropDuplicates(["__hash"])
    rows = sample.collect() or filled.limit(n_pages).collect()  # few distinct pages may leave the hash without one
    return fit([r["html"] for r in sorted(rows, key=lambda r: r["__hash"])])


def fit(sample: list[str]) -> BlockLabeller:
    draw = np.random.default_rng(SEED)
    x, y = [], []
    for page in sample:
        blocks = blocks_of(page)
        for copy, labels in variants(blocks, rule_labels(blocks), draw):
            found = vectors(copy)
            for at in range(0, len(copy), STRETCH):
                x.append(found[at : at + STRETCH])
                y.append(labels[at : at + STRETCH])
    return BlockLabeller().fit(x, y)


def labelled_pages(pages: DataFrame, model: BlockLabeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of every row.

    Null and empty HTML gives empty text and no blocks; pages without main text give empty text. Null ids and urls stay
    null, repeated rows give repeated results, other columns are not read.
    """
    weights, hidden = {k: w.astype(np.float32) for k, w in model.w.items()}, model.hidden

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockLabeller(weights, hidden)
        for batch in batches:
            blocks = [blocks_of(h) for h in batch.column("html").to_pylist()]
            main = [p > 0.5 for p in own.chances([vectors(b) for b in blocks])]
            texts = ["\n".join(b.text for b, y in zip(page, keep, strict=True) if y) for page, keep in zip(blocks, main, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int64()), pa.array([int(k.sum()) for k in main], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"
    )


def op10_page_blocks(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepared(spark)
    pages = table(spark, sf_dir, "pages")
    return labelled_pages(pages, train(pages))
