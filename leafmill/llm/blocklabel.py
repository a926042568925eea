"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: the text between two block-level tags, with
the path of block-level elements above it.  Each block becomes a vector of its
tag path (tags, class, id and role words, hashed), its words (hashed) and a few
measures (length, link share, punctuation, place).  A bidirectional LSTM in
numpy reads the blocks of the whole page in order and labels every one, so
what surrounds a block, near and far, decides with it.

The labeller is trained here on N_TRAIN generated pages (a documented bound;
the generator varies layouts, tags and class names, leaves names or even
structural tags out of some pages, and knows the labels).

Pages are labelled in groups of at most CELLS padded blocks; a longer page is
a group of its own, so memory grows with the longest page alone.  The path of
a block holds all elements above it.

Null and empty pages have an empty text.  Broken markup is read as browsers
do, roughly: unclosed elements end with their parent, stray end tags are
ignored, `<` that starts no tag is text.  Rows keep their multiplicity; extra
columns pass through ``extract``, but for those named like its results.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

N_TRAIN, EPOCHS, SEED = 1200, 12, 7
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 56, 24, 10, 24
#: Pages taken at a time, and padded blocks of a group.
BATCH, CELLS = 256, 20_000

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template title iframe object svg canvas video audio map".split())
#: Elements that end the text before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: An element of the first kind ends an open one of the second.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
_SCOPES = frozenset("ul ol menu dl table tbody thead tfoot select article section div aside nav header footer form body html".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PIECE = re.compile(r"[A-Za-z]+")


class Block:
    """Text, the vector of the elements above it, and how many of its characters are links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: np.ndarray, linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(100_000)
def names(tag: str, attributes: str) -> tuple[str, ...]:
    """Words of an element: its tag and the parts of its class, id and role."""
    found = [x.lower() for m in _ATTR.finditer(attributes) for v in m.groups() if v for x in _PIECE.findall(v)]
    return (tag, *dict.fromkeys(f".{x}" for x in found))


def cut(page: str) -> list[Block]:
    """The leaf blocks of a page, white space collapsed, character references decoded."""
    out: list[Block] = []
    # open elements: tag, sum of the vectors from the root on, and the path vector of blocks right below
    stack: list[tuple[str, np.ndarray, np.ndarray]] = []
    nothing = np.zeros(PATH_DIM, np.float32)
    text: list[str] = []
    linked = in_link = at = 0
    closing: dict[str, re.Pattern] = {}

    def flush() -> None:
        nonlocal linked
        if text:
            plain = " ".join("".join(text).split())
            if plain:
                out.append(Block(plain, stack[-1][2] if stack else nothing, linked))
            text.clear()
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        chars, tag = m[4], m[2]
        if chars is not None:
            plain = entities.unescape(chars) if "&" in chars else chars
            text.append(plain)
            if in_link:
                linked += len(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not m[1] and not m[3].endswith("/"):
                end = closing.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>", re.I)).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if m[1] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        in_link = 0
                        break
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPES:
                        break
            if tag != "hr" and not m[3].endswith("/"):
                own = element(tag, m[3])
                total = own + stack[-1][1] if stack else own
                # the three innermost count in full, those above by 0.7
                stack.append((tag, total, total - np.float32(0.3) * stack[-3][1] if len(stack) > 2 else total))
    flush()
    return out


# --------------------------------------------------------------------- features


@lru_cache(200_000)
def bucket(word: str, salt: str, size: int) -> int:
    """Signed hash bucket: below size for +1, from size on for -1."""
    h = zlib.crc32(f"{salt}{word}".encode())
    return h % size + (size if h >> 31 else 0)


@lru_cache(50_000)
def element(tag: str, attributes: str) -> np.ndarray:
    """Vector of an element's names."""
    v = np.zeros(PATH_DIM, np.float32)
    for name in names(tag, attributes):
        for salt in "abc":
            b = bucket(name, salt, PATH_DIM)
            v[b % PATH_DIM] += 1 if b < PATH_DIM else -1
    return v


@lru_cache(500_000)
def word_bucket(word: str) -> int:
    return bucket(word.lower().strip(".,;:!?\"'()|"), "w", WORD_DIM)


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """One row for each block of all pages."""
    n = sum(map(len, pages))
    out = np.zeros((n, PATH_DIM + WORD_DIM + MEASURES), np.float32)
    ids, counts, r = [], np.zeros(n, np.int64), 0
    for page in pages:
        m = len(page)
        for i, b in enumerate(page):
            words = b.text.split(" ")
            ids.append(np.fromiter(map(word_bucket, words), np.int64, len(words)))
            counts[r] = len(words)
            size = len(b.text)
            out[r, :PATH_DIM] = b.path
            out[r, PATH_DIM + WORD_DIM :] = (
                np.log1p(size) / 5, np.log1p(len(words)) / 4, min(1.0, b.linked / size), b.text[-1] in ".!?…。", min(1.0, (b.text.count(".") + b.text.count(",")) / len(words)),
                (i + 1) / m, i < 3, i >= m - 3, "©" in b.text, 1.0,
            )
            r += 1
    if n:
        flat, row = np.concatenate(ids), np.repeat(np.arange(n), counts)
        sign = np.where(flat < WORD_DIM, 1.0, -1.0)
        words = np.bincount(row * WORD_DIM + flat % WORD_DIM, weights=sign, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
        out[:, PATH_DIM : PATH_DIM + WORD_DIM] = words / np.sqrt(counts)[:, None]
    return out


# ------------------------------------------------------------------------ model


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(x: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray], side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, page, unit) of one direction; x is (time, page, feature) and mask (time, page, 1)."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    out = np.zeros((steps, pages, HIDDEN), np.float32)
    drive = x @ w[f"x{side}"] + w[f"b{side}"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = drive[t] + h @ w[f"h{side}"]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t]
        c2 = (f * c + i * g) * m + c * (1 - m)
        tc = np.tanh(c2)
        h2 = o * tc * m + h * (1 - m)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc))
        h, c = h2, c2
        out[t] = h
    return out


def backward(x, mask, w, side, keep, d_out, grad) -> None:
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t, h, c, i, f, o, g, tc in reversed(keep):
        m = mask[t]
        dh = dh + d_out[t]
        own = dh * m
        dct = dc * m + own * o * (1 - tc * tc)
        dz = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), own * tc * o * (1 - o), dct * i * (1 - g * g)), 1)
        grad[f"x{side}"] += x[t].T @ dz
        grad[f"h{side}"] += h.T @ dz
        grad[f"b{side}"] += dz.sum(0)
        dh = dz @ w[f"h{side}"].T + dh * (1 - m)
        dc = dct * f + dc * (1 - m)


def padded(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, feature) and its mask, from the rows of consecutive pages."""
    steps, at = max(sizes), 0
    x, mask = np.zeros((steps, len(sizes), rows.shape[1]), np.float32), np.zeros((steps, len(sizes), 1), np.float32)
    for p, n in enumerate(sizes):
        x[:n, p], mask[:n, p] = rows[at : at + n], 1
        at += n
    return x, mask


def train(pages: int = N_TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of the labeller, fitted to generated pages with Adam."""
    rng = np.random.default_rng(seed)
    sample = [generate(random.Random(f"{seed}-{k}")) for k in range(pages)]
    blocks = [cut(page) for page, _ in sample]
    labels = [[b.text in main for b in own] for own, (_, main) in zip(blocks, sample)]
    size = PATH_DIM + WORD_DIM + MEASURES
    w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * HIDDEN + size, 1)), "bias": np.zeros(1)}
    for side in "fb":
        w[f"x{side}"], w[f"h{side}"] = rng.normal(0, size**-0.5, (size, 4 * HIDDEN)), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"b{side}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    use = [k for k in range(pages) if blocks[k]]
    by_size = sorted(use, key=lambda k: len(blocks[k]))
    groups = [by_size[k : k + 24] for k in range(0, len(by_size), 24)]
    ready = [(*padded(vectors([blocks[k] for k in g]), [len(blocks[k]) for k in g]), g) for g in groups]
    for epoch in range(epochs):
        for n in rng.permutation(len(ready)):
            x, mask, g = ready[n]
            # names that a page uses by chance shouldn't decide alone: drop some features of each page
            x = x * (rng.random((1, x.shape[1], x.shape[2])) > 0.1)
            y = np.zeros(mask.shape, np.float32)
            for p, k in enumerate(g):
                y[: len(labels[k]), p, 0] = labels[k]
            kept_f: list = []
            kept_b: list = []
            hidden = np.concatenate((forward(x, mask, w, "f", kept_f), forward(x, mask, w, "b", kept_b), x), 2)
            d = (sigmoid(hidden @ w["out"] + w["bias"]) - y) * mask / mask.sum()
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"], grad["bias"] = np.tensordot(hidden, d, ([0, 1], [0, 1])), d.sum((0, 1))
            d_hidden = d @ w["out"].T
            backward(x, mask, w, "f", kept_f, d_hidden[:, :, :HIDDEN], grad)
            backward(x, mask, w, "b", kept_b, d_hidden[:, :, HIDDEN : 2 * HIDDEN], grad)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def label(pages: list[list[Block]], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page."""
    out = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    for at in range(0, len(order), BATCH):
        group = order[at : at + BATCH]
        # pages of similar length; a few very long ones don't pad the rest
        while group:
            take = [k for n, k in enumerate(group) if len(pages[k]) <= 2 * len(pages[group[0]]) + 16 and (not n or (n + 1) * len(pages[k]) <= CELLS)]
            sizes = [len(pages[k]) for k in take]
            x, mask = padded(vectors([pages[k] for k in take]), sizes)
            hidden = np.concatenate((forward(x, mask, w, "f"), forward(x, mask, w, "b"), x), 2)
            p = sigmoid(hidden @ w["out"] + w["bias"])[:, :, 0]
            for q, k in enumerate(take):
                out[k] = p[: sizes[q], q]
            group = group[len(take) :]
    return out


@lru_cache(1)
def trained() -> dict[str, np.ndarray]:
    """The weights, fitted once in a process."""
    return train()


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """pages with main_text (the main text, blocks joined by an empty line), n_blocks and n_main; input columns of these names are replaced."""
    added = ("main_text", "n_blocks", "n_main")
    held = pages.sparkSession.sparkContext.broadcast(weights or trained())
    own = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in added])
    at = own.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                blocks = [cut(t.decode()) for t in texts(part.column(at))]
                marks = [p > 0.5 for p in label(blocks, held.value)]
                text = ["\n\n".join(b.text for b, keep in zip(own, mark) if keep) for own, mark in zip(blocks, marks)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(text, pa.string()), pa.array([len(b) for b in blocks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())],
                    names=[*part.schema.names, *added],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(run, f"{schema}, main_text string, n_blocks long, n_main long")


# -------------------------------------------------------------- generated pages

_PARTS = "the of and to in re on er st en an th ou ing ion tion ment ver heit lich que le la de es ar os ción ez und ein sch ai au eau".split()
_LINKS = "Home About Contact News Shop Login Help Search Blog Products Services Archive Start Kontakt Accueil Inicio More Next Previous Share Tweet Print".split()
_NOTES = (
    "We use cookies to improve your experience. Accept all", "Subscribe to our newsletter for weekly updates", "© 2024 All rights reserved.", "Advertisement", "Sign up now and save 20%",
    "This site is maintained, some services may be slow.", "Related articles", "You may also like", "Terms of use | Privacy policy", "Sponsored content", "Please log in to comment",
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_PARTS) for _ in range(rng.choice((1, 1, 2, 2, 3)))) for _ in range(n))


def sentence(rng: random.Random, most: int = 18) -> str:
    return words(rng, rng.randint(1, most)).capitalize() + rng.choice((".", ".", ".", "!", "?"))


def paragraph(rng: random.Random) -> str:
    if rng.random() < 0.1:
        return " | ".join(words(rng, 1) for _ in range(rng.randint(2, 30))) + rng.choice((".", " |"))
    if rng.random() < 0.12:
        return " ".join(words(rng, 1) + rng.choice(("", ".", ",")) + rng.choice(("***", "$$$", "&amp;&amp;&amp;", "###", "%%%")) for _ in range(rng.randint(1, 60)))
    if rng.random() < 0.03:
        # long runs of the same words, without a sentence's end
        return " ".join(w for _ in range(rng.randint(1, 4)) for w in [words(rng, 1)] * rng.choice((5, 40, 400, 2000)))
    if rng.random() < 0.02:
        return " ".join(words(rng, 1) + rng.choice(("", "", ",", ".")) for _ in range(rng.choice((300, 3000)))) + "."
    return " ".join(sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 5, 9))))


def generate(rng: random.Random) -> tuple[str, set[str]]:
    """A page and the set of its main blocks (as ``cut`` would give them)."""
    main: set[str] = set()
    pick = rng.choice
    # some pages have no names, and some of these no structural tags either
    unnamed = rng.random() < 0.25
    plain_tags = unnamed and rng.random() < 0.5

    def tag(name: str, body: str, attributes: str = "", close: float = 1.0) -> str:
        if plain_tags and name in ("article", "aside", "footer", "header", "main", "nav", "section"):
            name = "div"
        return f"<{name}{'' if unnamed else attributes}>{body}" + (f"</{name}>" if rng.random() < close else "")

    def attr(*options: str) -> str:
        return pick(("", f' class="{pick(options)}"', f' class="{pick(options)} {pick(("box", "wide", "x1", "clearfix"))}"', f' id="{pick(options)}"'))

    def named(*options: str) -> str:
        return pick((f' class="{pick(options)}"', f' id="{pick(options)}"', f' class="{pick(("box", "row", "inner"))} {pick(options)}"'))

    def any_text() -> str:
        return pick((sentence(rng), paragraph(rng), pick(_NOTES), words(rng, rng.randint(1, 6))))

    def menu() -> str:
        item = lambda: tag("a", pick((pick(_LINKS), words(rng, rng.randint(1, 3)))), f' href="/{rng.randint(1, 99)}"')
        items = [item() for _ in range(rng.randint(2, 9))]
        return pick((tag("ul", "".join(tag("li", x) for x in items)), "".join(items), " | ".join(items), tag("ul", "".join(tag("li", x, close=0.3) for x in items))))

    def junk(kind: str) -> str:
        if kind == "nav":
            return pick((tag("nav", menu(), attr("menu", "navbar")), tag("div", menu(), named("nav", "menu", "navigation", "topnav", "breadcrumb"))))
        if kind == "header":
            body = tag(pick(("div", "p", "h1", "h2", "span")), words(rng, 2), attr("logo", "brand", "title")) + pick(("", menu(), tag("p", sentence(rng))))
            return pick((tag("header", body, attr("site", "top", "masthead")), tag("div", body, named("header", "masthead", "banner", "topbar"))))
        if kind == "footer":
            sign = pick(("©", "&#169;", "&copy;", "(c)", "Copyright", "®", ""))
            body = pick((f"{sign} {words(rng, rng.randint(1, 3))} {pick('-–|/·,')} {sentence(rng)}", tag("p", pick(_NOTES)) + menu(), tag("p", paragraph(rng)), sentence(rng)))
            return pick((tag("footer", body, attr("site", "bottom")), tag("div", body, named("footer", "foot", "copyright", "bottom"))))
        if kind == "aside":
            body = tag(pick(("h2", "h3", "h4")), pick((pick(_NOTES), words(rng, 2)))) + pick((menu(), tag("p", paragraph(rng)), tag("ul", "".join(tag("li", sentence(rng)) for _ in range(rng.randint(1, 5))))))
            return pick((tag("aside", body, attr("sidebar", "related")), tag("div", body, named("sidebar", "widget", "related", "aside", "recommended", "teaser", "popular"))))
        if kind == "notice":
            return tag(pick(("div", "section", "p", "dialog")), pick((any_text(), tag("p", any_text()) + tag("button", pick(_LINKS)))), named("cookie", "notice", "banner", "alert", "popup", "consent", "newsletter", "subscribe", "message"))
        if kind == "ad":
            return tag(pick(("div", "section", "aside")), pick((any_text(), tag("p", any_text()))), named("ad", "ads", "advert", "sponsor", "promo", "advertisement", "sponsored"))
        if kind == "form":
            body = tag("label", words(rng, 2)) + '<input type="text">' + pick(("", tag("select", "".join(tag("option", words(rng, 1)) for _ in range(3))))) + tag("button", pick(_LINKS)) + pick(("", tag("p", sentence(rng))))
            return tag("form", body, attr("search", "signup", "login", "contact"))
        if kind == "comments":
            one = lambda: pick((tag("div", tag("b", words(rng, 1)) + tag("p", paragraph(rng)), named("comment", "reply")), tag("li", tag("p", paragraph(rng)), named("comment", "reply")), tag("article", tag("p", paragraph(rng)), ' class="comment"')))
            body = pick(("", tag(pick(("h2", "h3")), pick(("Comments", "Kommentare", words(rng, 1))))) ) + "".join(one() for _ in range(rng.randint(1, 6)))
            return tag(pick(("div", "section", "ul")), body, named("comments", "responses", "discussion", "commentlist"))
        return tag("div", menu(), named("share", "social", "tags", "pagination", "toolbar"))

    def block(name: str, text: str, close: float = 1.0) -> str:
        body = text.replace("&&&", "&amp;&amp;&amp;") if "&amp;" not in text else text
        plain = " ".join(entities.unescape(body).split())
        main.add(plain)
        style = rng.random()
        if style < 0.12:
            inline = pick(("b", "i", "em", "strong", "span", "u", "small", "code"))
            body = f"<{inline}>{body}" + pick((f"</{inline}>", "<br>", "<br/>", "", f"</{inline}><br>"))
        elif style < 0.24 and " " in body:
            a, _, b = body.partition(" ")
            body = pick((f"<em>{a}</em> {b}", f'<a href="/x">{a}</a> {b}', f"{a}\n  {b}", f"{a}<br>{b}", f"{a}&nbsp;{b}"))
        return tag(name, body, close=close)

    def article() -> str:
        close = pick((1.0, 1.0, 0.5, 0.0))
        title = pick((sentence(rng), words(rng, rng.randint(1, 9)), words(rng, 5).capitalize()))
        out = [pick(("", block(pick(("h1", "h1", "h2")), title), block("h1", title), tag("header", block("h1", title))))]
        for _ in range(pick((0, 1, 3, 6, 12, 25))):
            kind = rng.random()
            if kind < 0.75:
                out.append(block("p", paragraph(rng), close))
            elif kind < 0.83:
                out.append(block(pick(("h2", "h3")), words(rng, rng.randint(1, 6)).capitalize()))
            elif kind < 0.9:
                out.append(tag(pick(("ul", "ol")), "".join(block("li", pick((sentence(rng), paragraph(rng)))) for _ in range(rng.randint(1, 6)))))
            elif kind < 0.94:
                out.append(tag("blockquote", block("p", paragraph(rng))))
            elif kind < 0.97:
                out.append(tag("table", "".join(tag("tr", "".join(block("td", words(rng, rng.randint(1, 3))) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            else:
                out.append(block(pick(("pre", "figcaption", "div")), paragraph(rng)))
            if rng.random() < 0.06:
                out.append(junk(pick(("ad", "aside", "share", "notice", "form"))))
        if rng.random() < 0.15:
            out.append(junk(pick(("comments", "share", "aside"))))
        body = "".join(out)
        return pick((
            tag("article", body), tag("article", body, attr("post", "entry", "story")), tag("main", body), tag("main", tag("article", body)),
            tag("div", body, named("content", "article", "post", "entry", "story", "main", "text", "body")), tag("section", body, named("content", "post", "main", "article")),
        ))

    before = [junk(k) for k in rng.sample(("nav", "header", "notice", "ad", "form", "aside"), rng.randint(0, 4))]
    after = [junk(k) for k in rng.sample(("footer", "aside", "comments", "ad", "form", "share", "notice", "nav"), rng.randint(0, 4))]
    rng.shuffle(before)
    body = "".join(before) + (f"<!-- {words(rng, rng.randint(1, 5))} -->" if rng.random() < 0.3 else "") + article() + "".join(after)
    if rng.random() < 0.3:
        body = tag("div", body, attr("wrapper", "page", "container", "site"))
    quoted = pick(("", f"'<div>{words(rng, 2)}</div>'", f'"</{pick(("p", "div", "body", "td"))}>"', f"/* {sentence(rng)} */"))
    script = f"<script{pick(('', ' async', ' type=\"text/javascript\"'))}>{words(rng, 1)} = {quoted or 0};</script>"
    style = f"<style>.{words(rng, 1).split()[0]} {{ {pick(('color', 'margin', 'padding'))}: {rng.randint(0, 20)}px }}</style>"
    head = f"<head><title>{words(rng, 3)}</title>{pick(('', style))}{pick(('', script))}</head>"
    body = pick(("", script)) + body + pick(("", script))
    page = f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"
    # a text that is also somewhere outside the main part can't be told by its text alone
    return page, main
