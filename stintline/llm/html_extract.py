"""HTML extraction: a bidirectional LSTM labels every block of a page as main text or not."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import read, without

#: Pages the labeller is trained on at most, variants of each, passes over them, and blocks of a training sequence.
TRAIN_PAGES, VARIANTS, PASSES, TRAIN_BLOCKS = 192, 5, 10, 64
#: Width of a state, of the hashed tag path (a multiple of 8), of the hashed own tag, of the hashed words and of the measures; cells of a batch of sequences.
STATE, PATH, OWN, WORDS, MEASURES, CELLS = 12, 256, 48, 32, 10, 40_000
WIDTH = PATH + OWN + WORDS + MEASURES

# What HTML says of its elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
SILENT = frozenset("head noscript template svg object math canvas select datalist audio video".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_NEST = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Containers of training variants, as tag and name. A name that none of the three lists has says nothing to the labeller.
MAIN = ("article", "main", "section.article", "div.content", "div.main-content", "div.post", "div.entry-content", "div.article-body", "div.story", "div.text")
ASIDE = (
    "nav", "header", "footer", "aside", "form", "div.menu", "ul.menu", "div.navbar", "div.breadcrumbs", "div.header", "div.footer", "div.sidebar", "div.widget",
    "div.cookie-notice", "div.notice", "div.banner", "div.alert", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.promo", "div.sponsored", "div.site-header",
    "div.newsletter", "div.subscribe", "form.search", "form.login", "div.popup", "div.share", "ul.social", "div.related", "div.recommended", "div.tags", "div.copyright", "dialog",
    "div.site-footer", "ul.main-navigation", "div.navigation", "div.cookie-banner", "div.ad-slot",
)
READERS = (
    "section.comments", "div.comments", "div.comment", "ol.comment-list", "ul.comments", "div.comment-body", "div.responses", "div.replies", "div.discussion", "aside.comments",
    "div.comments-area", "div.comment-respond",
)
_KNOWN = frozenset(n for c in (*MAIN, *ASIDE, *READERS) for n in c.split(".")[1:])
_PLAIN_MAIN = ("div", "div", "section", "td")
_APART = frozenset(("nav", "footer", "aside", "form", "header", "dialog", "button"))

_SPACE = " \\t\\n\\r\\f"
_NAME = re.compile(rf"[a-zA-Z][^{_SPACE}/>]*+")
_ATTRIBUTE = re.compile(rf"[{_SPACE}/]*+(?:(>)|([^{_SPACE}/>][^{_SPACE}/>=]*+)([{_SPACE}]*+=[{_SPACE}]*+)?+)")
_BARE = re.compile(rf"[^{_SPACE}>]*+")
_ENDS = {name: re.compile(rf"</{name}(?=[{_SPACE}/>])", re.I) for name in RAW}


@lru_cache(8192)
def _bits(entry: tuple[str, ...]) -> int:
    """The cells of PATH that a tag and its names hash to, as one number."""
    bits = 0
    for name in entry:
        bits |= 1 << crc32(name.encode("utf-8", "replace")) % PATH
    return bits


class Path:
    """The block elements around a leaf, outermost first.

    An entry (the tag and its known names) with a link to the path before it, so that a deeply nested
    page takes no copies. ``bits`` are the hashed entries of the whole path, ``main`` and ``apart`` say
    whether it leads through an article or main element, and through a menu, footer, form or the like.
    """

    __slots__ = ("apart", "before", "bits", "depth", "entry", "main")

    def __init__(self, before: Path | None, entry: tuple[str, ...]):
        self.before, self.entry = before, entry
        tag = entry[0]
        self.depth, self.bits, self.main, self.apart = 0, 0, False, False
        if before is not None:
            self.depth, self.bits = before.depth + 1, before.bits | _bits(entry)
            self.main, self.apart = before.main or tag in ("article", "main"), before.apart or tag in _APART

    def __len__(self) -> int:
        return self.depth

    def __iter__(self):
        chain, at = [], self
        while at.before is not None:
            chain.append(at.entry)
            at = at.before
        return reversed(chain)

    def __getitem__(self, k: int) -> tuple[str, ...]:
        return self.entry if k == -1 else tuple(self)[k]


ROOT = Path(None, ("",))
Leaf = tuple[Path, str, int]


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, list[str], bool]:
    """(position after the tag, its class, id and role, whether it closes itself); ``at`` follows the tag's name.

    What browsers do: a quote opens a value only behind ``=``, and one within a name is part of it. A quote
    without a partner (``last`` has the last of either kind) does not open a value; a tag without an end reaches to the page's.
    """
    values: list[str] = []
    while (m := _ATTRIBUTE.match(page, at)) is not None:
        at = m.end()
        if m[1]:
            return at, values, page[at - 2] == "/"
        if m[3]:
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
            if m[2].lower() in ("class", "id", "role"):
                values.append(value)
    return len(page), values, False


def _entry_of(tag: str, values: list[str]) -> tuple[str, ...]:
    return (tag, *["." + w for v in values for w in v.lower().split() if w in _KNOWN]) if values else (tag,)


def blocks(page: str) -> list[Leaf]:
    """(path, text, characters in links) of each leaf block in page order.

    One scan from left to right; the work is in proportion to the page, however its tags are nested, left open or
    malformed. Inline elements do not part a text. Comments, scripts, styles, the head and the like are no blocks.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    links, in_link, quiet, at, end = 0, False, 0, 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1] if stack else ROOT, text, min(links, len(text))))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if not quiet:
            parts.append(entities.unescape(text) if "&" in text else text)
            links += len(text) if in_link else 0

    def close(to: int) -> None:
        nonlocal quiet
        while len(stack) > to:
            tag = stack.pop()[0]
            places[tag].pop()
            quiet -= tag in SILENT

    def innermost(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    while at < end:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        if start > at:
            say(page[at:start])
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if page.startswith("!--", start + 1):
                stop = page.find("-->", start + 2)
                at = end if stop < 0 else stop + 3
            elif closing or page[start + 1 : start + 2] in ("!", "?"):
                stop = page.find(">", start + 2)
                at = end if stop < 0 else stop + 1
            else:
                say("<")
                at = start + 1
            continue
        at, values, closed = _attributes(page, name.end(), last)
        tag = name[0].lower()
        if closing:
            if tag in INLINE:
                in_link = in_link and tag != "a"
                continue
            if not quiet:
                flush()
            if places.get(tag):
                close(places[tag][-1])
            continue
        if places.get("head") and tag not in IN_HEAD:
            close(places["head"][-1])
        if tag in RAW:
            stop = _ENDS[tag].search(page, at)
            at = end if stop is None else _attributes(page, stop.end(), last)[0]
            continue
        if tag in INLINE:
            in_link = in_link or tag == "a"
            continue
        if quiet or tag in SILENT:
            if tag not in VOID and not (closed and tag in ("svg", "math")):
                places.setdefault(tag, []).append(len(stack))
                stack.append((tag, stack[-1][1] if stack else ROOT))
                quiet += tag in SILENT
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and places.get("p"):
            close(places["p"][-1])
        elif tag in SELF_NEST and innermost(tag) > innermost(*SELF_NEST[tag]):
            close(places[tag][-1])
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, Path(stack[-1][1] if stack else ROOT, _entry_of(tag, values))))
    flush()
    return out


def _context(leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each leaf lies in the page's dominant container, and the share of the page's text in its own element.

    The dominant container is the innermost element that holds at least half of the page's text outside links.
    """
    size: dict[Path, int] = {ROOT: 0}
    for path, text, links in leaves:
        at = path
        while at not in size:
            size[at] = 0
            at = at.before
        size[path] += len(text) - links
    by_depth = sorted(size, key=lambda p: p.depth)
    for p in reversed(by_depth):
        if p.before is not None:
            size[p.before] += size[p]
    total = size[ROOT]
    dominant = max((p for p in by_depth if 2 * size[p] >= total), key=lambda p: p.depth)
    inside: dict[Path, bool] = {}
    for p in by_depth:
        inside[p] = p is dominant or (p.before is not None and inside[p.before])
    around = [size[p.before or p] for p, _, _ in leaves]
    return np.array([inside[p] for p, _, _ in leaves], bool), np.array(around) / max(total, 1)


def features(leaves: list[Leaf]) -> np.ndarray:
    """(leaves, WIDTH): tag path, own tag and words, each hashed, and measures of the text and of its place in the page."""
    x = np.zeros((len(leaves), WIDTH), np.float32)
    if not leaves:
        return x
    raw = b"".join(p.bits.to_bytes(PATH // 8, "little") for p, _, _ in leaves)
    x[:, :PATH] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(leaves), -1), axis=1, bitorder="little")
    inside, around = _context(leaves)
    headed = False
    for n, (path, text, links) in enumerate(leaves):
        for name in path.entry:
            x[n, PATH + crc32(name.encode("utf-8", "replace")) % OWN] = 1
        words = text.split()
        x[n, PATH + OWN : PATH + OWN + WORDS] = np.bincount([crc32(w.encode("utf-8", "replace")) % WORDS for w in words], minlength=WORDS) / len(words) ** 0.5 / 2
        headed = headed or path.entry[0] == "h1"
        size = len(text)
        x[n, -MEASURES:] = (
            min(np.log1p(size) / 8, 2), min(np.log1p(len(words)) / 6, 2), links / size, sum(map(text.count, ".,;:!?")) * 5 / size, text.endswith((".", "!", "?")),
            min(path.depth, 12) / 12, inside[n], around[n], headed, n / len(leaves),
        )
    return x


@dataclass
class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer over both states of a block."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.15, (WIDTH, 4 * STATE))
            w["h" + d] = rng.normal(0, 0.25, (STATE, 4 * STATE))
            w["c" + d] = np.concatenate([np.zeros(STATE), np.ones(STATE), np.zeros(2 * STATE)])
        w["o"], w["p"] = rng.normal(0, 0.3, 2 * STATE), np.zeros(1)
        return Labeller(w)

    @staticmethod
    def untaught() -> Labeller:
        """A labeller that has seen no labelled page: every block is main text, so nothing is lost."""
        weights = {k: np.zeros_like(w) for k, w in Labeller.new(0).weights.items()}
        return Labeller(weights | {"p": np.ones(1)})

    def run(self, x: np.ndarray, sizes: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """Logits (steps, batch) of padded sequences (steps, batch, WIDTH), and (with ``keep``) what the gradient needs."""
        steps, batch = x.shape[:2]
        t = np.arange(steps)[:, None]
        live = t < sizes
        turn = np.where(live, sizes - 1 - t, t)
        states, saved = [], []
        for d in "fb":
            own = x if d == "f" or not keep else np.take_along_axis(x, turn[:, :, None], 0)
            pre = own @ self.weights["x" + d] + self.weights["c" + d]
            if d == "b" and not keep:
                pre = np.take_along_axis(pre, turn[:, :, None], 0)
            h, c = np.zeros((batch, STATE)), np.zeros((batch, STATE))
            hs, log = np.zeros((steps, batch, STATE)), []
            for k in range(steps):
                z = pre[k] + h @ self.weights["h" + d]
                gate = 1 / (1 + np.exp(-z[:, : 3 * STATE]))
                i, f, o = gate[:, :STATE], gate[:, STATE : 2 * STATE], gate[:, 2 * STATE :]
                g = np.tanh(z[:, 3 * STATE :])
                m = live[k][:, None]
                c2 = np.where(m, f * c + i * g, c)
                th = np.tanh(c2)
                if keep:
                    log.append((h, c, i, f, o, g, th, m))
                h, c = np.where(m, o * th, h), c2
                hs[k] = h
            saved.append((own, log))
            states.append(hs if d == "f" else np.take_along_axis(hs, turn[:, :, None], 0))
        both = np.concatenate(states, 2)
        return both @ self.weights["o"] + self.weights["p"][0], [both, saved, live, turn]

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy, by back-propagation through time."""
        logit, (both, saved, live, turn) = self.run(x, sizes)
        error = np.where(live, 1 / (1 + np.exp(-logit)) - y, 0) / live.sum()
        grad = {"o": np.einsum("tb,tbs->s", error, both), "p": np.array([error.sum()])}
        down = error[:, :, None] * self.weights["o"]
        for n, d in enumerate("fb"):
            dh_out = down[:, :, n * STATE : (n + 1) * STATE]
            if d == "b":
                dh_out = np.take_along_axis(dh_out, turn[:, :, None], 0)
            own, log = saved[n]
            dz = np.zeros((*x.shape[:2], 4 * STATE))
            gh = np.zeros_like(self.weights["h" + d])
            dh, dc = np.zeros_like(log[0][0]), np.zeros_like(log[0][0])
            for k in range(len(log) - 1, -1, -1):
                h, c, i, f, o, g, th, m = log[k]
                dh = dh + dh_out[k]
                inner = dc + dh * o * (1 - th * th)
                step = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), dh * th * o * (1 - o), inner * i * (1 - g * g)], 1) * m
                dz[k] = step
                gh += h.T @ step
                dh = np.where(m, step @ self.weights["h" + d].T, dh)
                dc = np.where(m, inner * f, dc)
            grad["x" + d] = np.einsum("tbw,tbz->wz", own, dz, optimize=True)
            grad["h" + d], grad["c" + d] = gh, dz.sum((0, 1))
        return grad

    def labels(self, pages: list[list]) -> list[np.ndarray]:
        """For each page's blocks, whether they are main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop - at + 1) * len(pages[order[stop]]) <= CELLS // 8 and stop - at < 128:
                stop += 1
            some = order[at:stop]
            sizes = np.array([len(pages[k]) for k in some])
            logit = self.run(_padded([features(pages[k]) for k in some], sizes), sizes, keep=False)[0]
            for n, k in enumerate(some):
                out[k] = logit[: sizes[n], n] > 0
            at = stop
        return out


def _padded(rows: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    x = np.zeros((sizes.max(), len(rows), WIDTH), np.float32)
    for n, row in enumerate(rows):
        x[: len(row), n] = row
    return x


def _entry(name: str) -> tuple[str, ...]:
    tag, *names = name.split(".")
    return (tag, *["." + n for n in names])


def known_labels(leaves: list[Leaf]) -> list[int] | None:
    """Labels of a page whose structure tells them: inside its article or main element. None for other pages."""
    inside = [path.main for path, _, _ in leaves]
    if not any(inside) or all(inside):
        return None
    return [int(path.main and not path.apart) for path, _, _ in leaves]


def variant(leaves: list[Leaf], labels: list[int], spare: list[Leaf], rng: random.Random) -> tuple[list[Leaf], list[int]]:
    """The page with its main container renamed, with some blocks left out and with blocks of other kinds put in.

    Half of the main containers get a plain tag without a name, and in a third of the variants no element of the page keeps a
    name: the labeller has to go by tags, text and place, and a name it does not know (or a known one on the wrong container) changes little.
    """
    name = _entry(rng.choice(_PLAIN_MAIN if rng.random() < 0.5 else MAIN))
    bare = rng.random() < 0.33
    moved: dict[Path, Path] = {ROOT: ROOT}

    def move(path: Path) -> Path:
        chain = []
        while path not in moved:
            chain.append(path)
            path = path.before
        for p in reversed(chain):
            entry = name if p.entry[0] in ("article", "main") else p.entry
            moved[p] = Path(moved[p.before], entry[:1] if bare else entry)
        return moved[chain[0]] if chain else moved[path]

    kept = [((move(path), text, links), y) for (path, text, links), y in zip(leaves, labels) if y or rng.random() < 0.7]
    body = Path(Path(ROOT, ("html",)), ("body",))
    main = Path(body, name[:1] if bare else name)
    for _ in range(rng.randint(0, 4)):
        inside, readers = rng.random() < 0.4, rng.random() < 0.4
        kind = _entry(rng.choice(READERS if readers else ASIDE))
        if not inside and kind[0] not in ("div", "ul", "section") and rng.random() < 0.3:
            kind = kind[:1]
        path = Path(main if inside else body, kind)
        if rng.random() < 0.8:
            path = Path(path, (rng.choice(("p", "div", "li", "h3", "td", "button")),))
        first = next((k for k, (_, y) in enumerate(kept) if y), 0)
        final = max((k for k, (_, y) in enumerate(kept) if y), default=0)
        spot = rng.randint(first, final + 1) if inside else rng.choice((0, first, final + 1, len(kept)))
        kept[spot:spot] = [((path, *rng.choice(spare)[1:]), 0) for _ in range(rng.randint(1, 5))]
    for k, ((path, text, links), y) in enumerate(kept):  # plain paragraphs of the main text also stand in quotes, lists and headings
        if y and path.before is not None and rng.random() < 0.05:
            kept[k] = (Path(path.before, (rng.choice(("blockquote", "li", "h2", "h3", "pre", "td", "div")),)), text, links), 1
    return [x for x, _ in kept], [y for _, y in kept]


def train(pages: list[str], seed: int = 5) -> Labeller:
    """A labeller from pages whose structure tells main text from the rest, and from variants of them; without any it is ``untaught``.

    Of a longer page TRAIN_BLOCKS blocks that follow each other are used.
    """
    rng = random.Random(seed)
    known = [(x, y) for x in map(blocks, pages) if (y := known_labels(x)) is not None]
    if not known:
        return Labeller.untaught()
    model = Labeller.new(seed)
    spare = [leaf for x, _ in known for leaf in x]
    rows = []
    for x, y in known:
        for k in range(VARIANTS + 1):
            a, b = (x, y) if not k else variant(x, y, spare, rng)
            at = rng.randint(0, max(0, len(a) - TRAIN_BLOCKS))
            if a:
                rows.append((features(a)[at : at + TRAIN_BLOCKS], b[at : at + TRAIN_BLOCKS]))
    first = {k: np.zeros_like(w) for k, w in model.weights.items()}
    second = {k: np.zeros_like(w) for k, w in model.weights.items()}
    turn, total = 0, PASSES * ((len(rows) + 31) // 32)
    for _ in range(PASSES):
        rng.shuffle(rows)
        for at in range(0, len(rows), 32):
            some = rows[at : at + 32]
            sizes = np.array([len(x) for x, _ in some])
            y = np.zeros((sizes.max(), len(some)))
            for n, (_, labels) in enumerate(some):
                y[: len(labels), n] = labels
            turn += 1
            rate = 0.02 * (1 - 0.9 * turn / total)
            for k, g in model.gradient(_padded([x for x, _ in some], sizes), sizes, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.weights[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return model


def fit(pages: DataFrame, key: str = "page_id", page: str = "html") -> Labeller:
    """Train on at most TRAIN_PAGES pages (a fixed bound), the first by hash of their key of those that have an article or main element.

    One task trains, and its weights come back. Without such pages the labeller is ``untaught``.
    """
    labelled = pages.where(F.col(page).rlike(r"(?i)<(article|main)[\s/>]"))
    sample = labelled.select(F.xxhash64(F.col(key)).alias("h"), F.col(page).alias("page")).orderBy("h", "page").limit(TRAIN_PAGES)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = train([p for pdf in batches for p in pdf["page"]])
        yield pd.DataFrame([(k, list(w.shape), w.ravel().tolist()) for k, w in model.weights.items()], columns=["k", "shape", "w"])

    rows = sample.coalesce(1).mapInPandas(work, "k string, shape array<int>, w array<double>").collect()
    return Labeller({r.k: np.array(r.w).reshape(r["shape"]) for r in rows}) if rows else Labeller.untaught()


def extract(pages: DataFrame, model: Labeller, page: str = "html") -> DataFrame:
    """Add ``text``, the page's main blocks joined by one space, and ``n_chars``, its code points.

    * a null or empty page, and one without main blocks, gives an empty text;
    * all blocks of a page are labelled in one pass, however many there are; equal pages get equal texts;
    * malformed tags are read as browsers read them; a tag or comment without an end takes the rest of the page;
    * input columns named ``text`` and ``n_chars`` are replaced (also where one of them holds the page); an empty input gives an empty result.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # some hundreds of kilobytes

    @F.pandas_udf("string")
    def main_text(htmls: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(htmls), 64):
            leaves = [blocks(h or "") for h in htmls.iloc[at : at + 64]]
            out += [" ".join(text for (_, text, _), is_main in zip(x, y) if is_main) for x, y in zip(leaves, shipped.value.labels(leaves))]
        return pd.Series(out, dtype=object)

    rows = without(pages.withColumn("__html", F.col(f"`{page}`")), "text", "n_chars").withColumn("text", main_text("__html"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).drop("__html")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; the labeller is trained on the table's own pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
