"""Operator 9: main text of web pages by a bidirectional recurrent labeller of their blocks."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchlark.plans.names import neutral, with_fields
from sketchlark.llm.recurrent import Adam, lstm_backward, lstm_forward, lstm_weights, sigmoid

#: Pages to learn from (expected number, chosen by hash), training steps, blocks of pages of about one length that a step takes.
SAMPLE, STEPS, BATCH, HIDDEN, SEED = 600, 200, 1200, 16, 3
PATH_DIMS, WORD_DIMS, OTHER_DIMS = 64, 64, 8
#: A worker labels so many blocks of pages of about one length at once.
TOGETHER = 40_000
#: A worker reads so many pages at once.
ROWS = 256

# Quantifiers that don't backtrack, and an end of page for whatever isn't closed, so that a page is read in one pass.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {x: re.compile(rf"</{x}\b[^>]*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stay within a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body main aside nav footer header form select".split())


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path of tag and tag.name labels, text, characters within links) of each leaf block with text, in page order.

    A block is the text between tags that aren't inline. Raw elements (script, style and the like) and comments hold no
    text. Character references are decoded, white space becomes one space, ends are trimmed.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, path = 0, 0, None

    def flush() -> None:
        nonlocal linked, path
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                if path is None:
                    path = tuple(x for _, names in stack for x in names)
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    def cut(i: int) -> None:
        nonlocal path
        del stack[i:]
        path = None

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if m[1] else 1
            continue
        flush()
        in_link = 0
        if m[1]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if i is not None:
                cut(i)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID:
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            shut = _CLOSES.get(tag, ("p",))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    cut(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        names = [x for a, b, c in _NAMES.findall(m[3]) for x in (a or b or c).lower().split()] if "=" in m[3] else []
        stack.append((tag, (tag, *(f"{tag}.{x}" for x in names))))
        path = None
    flush()
    return out


#: Names of page parts that aren't the article, for the labels that the network learns from.
_OTHER = re.compile(r"^(nav|header|footer|aside|form|menu|head|title|button|select|dialog)$|\.(.*[-_])?(ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|header|menu|nav\w*|newsletter|notice|popup|promo|related|share|sidebar|social|sponsor\w*|subscribe|widget)([-_].*)?$")
_MAIN = re.compile(r"^(article|main)$|\.(.*[-_])?(article|content|entry|main|post|story|text)([-_].*)?$")
#: Tags that tell a part of a page by their name; without names they are plain boxes.
_TELLING = frozenset("article main nav header footer aside section form menu head title dialog".split())
Found = list[tuple[tuple[str, ...], str, int]]


def weak_label(path: tuple[str, ...]) -> bool:
    """Whether the names of the tags around a block say that it belongs to the article."""
    return any(map(_MAIN.search, path)) and not any(map(_OTHER.search, path))


def weak_labels(found: Found) -> list[bool] | None:
    """``weak_label`` of each block; None for a page where no block has such names."""
    out = [weak_label(path) for path, _, _ in found]
    return out if any(out) else None


def sign_labels(found: Found) -> list[bool]:
    """Whether each block lies in the box that reads like running text.

    A sentence block has 60 characters or more, less than a third of them in links, an end mark, and no name of another
    page part around it. The box is the innermost one that holds two thirds of the page's sentence blocks' characters;
    blocks in it that are mostly links, or are named as another part, don't belong.
    """
    other = [any(map(_OTHER.search, path)) for path, _, _ in found]
    mass = [len(t) if len(t) >= 60 and 3 * linked < len(t) and t[-1] in END and not o else 0 for (_, t, linked), o in zip(found, other)]
    if not sum(mass):
        return [False] * len(found)
    box: tuple[str, ...] = ()
    while True:
        held: dict[tuple[str, ...], int] = {}
        for (path, _, _), n in zip(found, mass):
            if len(path) > len(box) and path[: len(box)] == box:
                inner = path[: len(box) + 1]
                held[inner] = held.get(inner, 0) + n
        best = max(held, key=held.__getitem__, default=None)
        if best is None or 3 * held[best] < 2 * sum(mass) or best[-1] == "p":
            break
        box = best
    return [path[: len(box)] == box and not o and 2 * linked < len(t) for (path, t, linked), o in zip(found, other)]


def stripped(found: Found) -> Found:
    """The blocks as of a page without telling names: no classes, ids and roles, and plain boxes for telling tags."""
    return [(tuple("div" if p in _TELLING else p for p in path if "." not in p), t, linked) for path, t, linked in found]


END = ".!?…\u3002\uff01\uff1f\u061f\u0964\"\u201d\u00bb"


class _Hashes(dict):
    """string -> dimension; forgets all when it holds many."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, x: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[x] = d = zlib.crc32(x.encode("utf-8", "surrogatepass")) * 2654435761 % 4294967296 * self.dims >> 32
        return d


_paths, _words = _Hashes(PATH_DIMS), _Hashes(WORD_DIMS)
_vectors: dict[tuple[str, ...], np.ndarray] = {}


def features(found: Found) -> np.ndarray:
    """One vector per block: hashed tag path, hashed words (relative counts), length, words, link and end-mark signs, the
    depth of its path, and how much of it is shared with the blocks before and after.
    """
    x = np.zeros((len(found), PATH_DIMS + WORD_DIMS + OTHER_DIMS), np.float32)
    last: tuple[str, ...] = ()
    for i, (path, text, linked) in enumerate(found):
        v = _vectors.get(path)
        if v is None:
            if len(_vectors) > 50_000:
                _vectors.clear()
            v = np.zeros(PATH_DIMS, np.float32)
            v[[_paths[p] for p in path]] = 1
            _vectors[path] = v
        x[i, :PATH_DIMS] = v
        words = text.split()
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(list(map(_words.__getitem__, words)), minlength=WORD_DIMS) * (4 / len(words))
        same = 0
        for a, b in zip(path, last):
            if a != b:
                break
            same += 1
        own = same / max(len(path), len(last), 1)
        x[i, -8:] = np.log1p(len(text)) / 5, np.log1p(len(words)) / 5, min(1.0, linked / len(text)), text[-1] in END, min(len(path), 20) / 10, own, 0, i == 0
        if i:
            x[i - 1, -2] = own
        last = path
    return x


class BlockLabeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def train(cls, pages: list[np.ndarray], labels: list[np.ndarray], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        dims = PATH_DIMS + WORD_DIMS + OTHER_DIMS
        w = lstm_weights(rng, dims, hidden, "f") | lstm_weights(rng, dims, hidden, "b")
        w |= {"v": (rng.standard_normal((2 * hidden, 1)) * 0.3).astype(np.float32), "c": np.zeros(1, np.float32)}
        made, adam = cls(w), Adam(w)
        # Whole pages of about one length make a batch: as many as hold BATCH blocks together, one at least.
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        size = np.array([len(pages[i]) for i in order], np.float64)
        for step in range(steps if order else 0):
            k = int(np.searchsorted(np.cumsum(size), rng.random() * size.sum()))
            n = max(1, min(BATCH // int(size[k]), len(order)))
            low = max(0, min(k - n // 2, len(order) - 2 * n))
            some = [order[i] for i in (rng.choice(np.arange(low, min(low + 2 * n, len(order))), n, replace=False) if n > 1 else [k])]
            x, y, live = made._batch([pages[i] for i in some], [labels[i] for i in some])
            hf, sf = lstm_forward(w, "f", x, live, True)
            hb, sb = lstm_forward(w, "b", x[::-1], live[::-1], True)
            both = np.concatenate([hf, hb[::-1]], 2)
            d = (sigmoid((both @ w["v"] + w["c"])[:, :, 0]) - y) * live / max(1.0, live.sum())
            grads = {"v": (both.reshape(-1, 2 * hidden).T @ d.reshape(-1, 1)), "c": d.sum().reshape(1)}
            back = d[:, :, None] * w["v"][:, 0]
            grads |= lstm_backward(w, "f", x, sf, back[:, :, :hidden])
            grads |= lstm_backward(w, "b", np.ascontiguousarray(x[::-1]), sb, np.ascontiguousarray(back[::-1, :, hidden:]))
            adam.rate = 0.02 * (1 - step / steps) + 0.001
            adam.step(grads)
        return made

    @staticmethod
    def _batch(pages, labels=None):
        longest = max(map(len, pages))
        x = np.zeros((longest, len(pages), PATH_DIMS + WORD_DIMS + OTHER_DIMS), np.float32)
        y, live = np.zeros((longest, len(pages)), np.float32), np.zeros((longest, len(pages)), np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], live[: len(p), k] = p, 1
            if labels is not None:
                y[: len(p), k] = labels[k]
        return x, y, live

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each block is main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        w = self.weights
        while order:
            n = max(1, min(len(order), TOGETHER // len(pages[order[-1]]), 128))
            some, order = order[-n:], order[:-n]
            x, _, live = self._batch([pages[i] for i in some])
            both = np.concatenate([lstm_forward(w, "f", x, live), lstm_forward(w, "b", x[::-1], live[::-1])[::-1]], 2)
            z = (both @ w["v"] + w["c"])[:, :, 0]
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k] > 0
        return out


def fit(pages: DataFrame, sample: int = SAMPLE, html: str = "html", **more) -> BlockLabeller:
    """A labeller from about ``sample`` pages, chosen by the hash of their html.

    Pages with telling names are labelled by these, and each is learnt twice: as it is, and ``stripped`` of all names
    with the same labels, so that pages without names are told by their structure, words and the blocks around. Pages
    without telling names are learnt by ``sign_labels``, but only if fewer than a tenth of the sample has names.
    """
    n = pages.count()
    share = (F.pmod(F.xxhash64(html), F.lit(1 << 30)) + 0.5) / (1 << 30)
    some = pages.where(F.col(html).isNotNull() & (share * max(n, 1) < sample)).select(html)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[bool, bytes, bytes]] = []
            for t in batch.column(0):
                found = blocks(t.as_py())
                own = weak_labels(found)
                for f in (found, stripped(found)) if own else (found,):
                    rows.append((own is not None, features(f).astype(np.float16).tobytes(), bytes(own if own else sign_labels(f))))
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, (pa.bool_(), pa.binary(), pa.binary()))], ["named", "x", "y"])

    rows = sorted((r["named"], bytes(r["x"]), bytes(r["y"])) for r in some.mapInArrow(read, "named boolean, x binary, y binary").collect() if r["y"])
    named = [r for r in rows if r[0]]
    rows = named if 10 * len(named) >= 2 * len(rows) else rows
    xs = [np.frombuffer(x, np.float16).reshape(len(y), -1).astype(np.float32) for _, x, y in rows]
    return BlockLabeller.train(xs, [np.frombuffer(y, np.uint8).astype(np.float32) for _, _, y in rows], **more)


def extract(pages: DataFrame, model: BlockLabeller, html: str = "html") -> DataFrame:
    """``pages`` without html, with text (main blocks joined by two newlines) and n_chars (its code points).

    A null or empty page, or one without main blocks, has an empty text. What a page leaves open (a tag, a comment, a
    quote) ends with the page. Repeated rows are read like others, an empty table gives an empty result, and columns of
    these names are replaced.
    """
    rows, (page,), back = neutral(pages, html, without=["text", "n_chars"])
    rows = rows.select(*(c for c in rows.columns if c != page), page)
    kept = rows.drop(page)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [blocks(t.as_py() or "") for t in part.column(part.num_columns - 1)]
                main = model.label([features(f) for f in found])
                texts = ["\n\n".join(t for (_, t, _), m in zip(f, mask) if m) for f, mask in zip(found, main)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[:-1], "text", "n_chars"])

    out = rows.mapInArrow(read, with_fields(kept, "text string, n_chars long"))
    return back(out, "text", "n_chars", less=page)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages))
