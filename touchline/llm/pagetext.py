"""Operator 11: main text of HTML pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block tags, each with the tags around it. A block's vector is the
mean of its tag path's and of its words' embeddings (both hashed) and a few measures. A bidirectional LSTM in numpy
reads the page's blocks in order, so that every block is judged by the whole document, and a logistic output tells the main text.

The network is trained here, on pages that ``layouts`` draws: sites of many structures with invented words, whose blocks are
known. Nothing is learned from the pages that are labelled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import ship
from touchline.llm.layouts import draw

#: Buckets and width of the two embeddings, measures, hidden units to each side, and blocks that a step of a batch of pages reads.
PATHS, WORDS, WIDTH, MEASURES, HIDDEN, STEP = 4096, 4096, 16, 8, 24, 6000
#: Pages drawn for training, passes over them, pages in a batch.
PAGES, EPOCHS, BATCH = 1200, 8, 32

# Element names of HTML, by how they part text.
RAW = ["script", "style", "noscript", "template", "iframe", "object", "svg", "math", "title", "head", "noembed", "noframes", "canvas", "audio", "video"]
INLINE = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "label"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
CLOSES_P = ["address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"]
SAME = [["li"], ["dt", "dd"], ["option", "optgroup"], ["tr"], ["td", "th"], ["thead", "tbody", "tfoot"]]
FENCES = ["ul", "ol", "menu", "dl", "table", "select", "article", "section", "aside", "div", "form", "body"]

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_WORD = re.compile(r"\w+|[^\w\s]")
_SIBLINGS = {tag: group for group in SAME for tag in group}
_ENDS = {tag: re.compile(rf"</{tag}\s*/?\s*>", re.I) for tag in RAW}


@dataclass
class Block:
    """A leaf block: its tag path as an index into ``Page.paths``, its text, and characters within links."""

    path: int
    text: str
    linked: int


def blocks(page: str) -> tuple[list[Block], list[tuple[str, ...]]]:
    """A page's leaf blocks in order and its distinct tag paths: (number of the path around, element with its names) each.

    Character references are decoded, white space within a block is one space. Comments and elements without shown text go
    unread. Any input has a reading: a stray ``<`` is text, an unclosed comment or raw element ends the page."""
    paths: list[tuple[int, tuple[str, ...]]] = [(-1, ())]
    known: dict[tuple[int, tuple[str, ...]], int] = {}
    stack: list[tuple[str, int]] = [("", 0)]
    made: list[Block] = []
    held: list[str] = []
    where, linked, links = [-1], [0], [0]
    pattern, at, end = _TAG, 0, len(page)

    def text(raw: str) -> None:
        if raw:
            if where[0] < 0 and not raw.isspace():
                where[0] = stack[-1][1]
            if links[0]:
                linked[0] += len(raw)
            held.append(raw)

    def flush() -> None:
        if where[0] >= 0:
            shown = " ".join(html.unescape("".join(held)).split())
            if shown:
                made.append(Block(where[0], shown, linked[0]))
        held.clear()
        where[0], linked[0] = -1, 0

    def close(to: int) -> None:
        for name, _ in stack[to:]:
            links[0] -= name == "a"
        del stack[to:]

    while at < end:
        lead = page.find("<", at)
        if lead < 0:
            text(page[at:])
            break
        text(page[at:lead])
        after = page[lead + 1 : lead + 2]
        if page.startswith("<!--", lead):
            found = page.find("-->", lead + 2 if page.startswith(("<!-->", "<!--->"), lead) else lead + 4)
            if found < 0:
                break
            at = found + 3
            continue
        if after in ("!", "?") or (after == "/" and not page[lead + 2 : lead + 3].isalpha()):
            found = page.find(">", lead)
            if found < 0:
                break
            at = found + 1
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            text("<")
            at = lead + 1
            continue
        match = pattern.match(page, lead)
        if not match and pattern is _TAG:  # a quote that never closes: from here on tags end at the next ">"
            pattern = _PLAIN
            match = pattern.match(page, lead)
        if not match:
            break
        at, name = match.end(), match.group(2).lower()
        if match.group(1):
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if name in RAW and name != "head":
            if match.group(3).endswith("/") and name in ("svg", "math"):
                continue
            found = _ENDS[name].search(page, at)
            if not found:
                break
            at = found.end()
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _SIBLINGS[name]:
                    close(k)
                    break
                if stack[k][0] in FENCES:
                    break
        if name in VOID:
            continue
        names = [name]
        if match.group(3):
            for found in _NAMES.finditer(match.group(3)):
                said = found.group(2) or found.group(3) or found.group(4) or ""
                names += [f".{x.lower()}" for x in _PART.findall(html.unescape(said))]
        key = (stack[-1][1], tuple(names))
        if key not in known:
            known[key] = len(paths)
            paths.append(key)
        stack.append((name, known[key]))
        links[0] += name == "a"
    flush()
    return made, paths


class Buckets(dict):
    """Buckets of names by hash, remembered up to a bound; every number is the same word."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, name: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[name] = k = crc32(b"0" if name[0].isdigit() else name.encode("utf-8", "surrogatepass")) % self.n
        return k


PATH_BUCKETS, WORD_BUCKETS = Buckets(PATHS), Buckets(WORDS)


@dataclass
class Leaves:
    """Pages' blocks as numbers: bags of path and word buckets with the block of each entry, measures, first block of each page (n + 1)."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray
    first: np.ndarray


def numbered(pages: list[tuple[list[Block], list[tuple[int, tuple[str, ...]]]]]) -> Leaves:
    """Blocks as numbers. A path's bag has its elements' names, its own element again as a mark, and of very deep ones the nearest 24 and
    the outermost; the text itself is read whole."""
    path, path_of, word, word_of, rows, first, k = [], [], [], [], [], [0], 0
    for made, paths in pages:
        bags: dict[int, list[int]] = {}
        n = len(made)
        for at, b in enumerate(made):
            if b.path not in bags:
                names, up = [f"^{x}" for x in paths[b.path][1]], b.path
                depth = 0
                while up > 0:
                    if depth < 24 or paths[up][0] <= 0:
                        names += paths[up][1]
                    up, depth = paths[up][0], depth + 1
                bags[b.path] = [PATH_BUCKETS[x] for x in dict.fromkeys(names)] or [0]
            bag = bags[b.path]
            path += bag
            path_of += [k] * len(bag)
            own = [WORD_BUCKETS[x] for x in _WORD.findall(b.text.lower())] or [0]
            word += own
            word_of += [k] * len(own)
            size = len(b.text)
            stops = sum(map(b.text.count, ".,;!?"))
            rows.append((np.log1p(size) / 6, np.log1p(len(own)) / 5, min(b.linked / size, 1), stops / len(own), at / n, np.log1p(n) / 5, size > 120, b.text[-1] in ".!?"))
            k += 1
        first.append(k)
    kinds = [np.array(x, np.int64) for x in (path, path_of, word, word_of)]
    return Leaves(*kinds, np.array(rows, np.float32).reshape(-1, MEASURES), np.array(first))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Labeller:
    """Embeddings, an LSTM to each side (input, recurrent, bias; gates in, forget, out, new) and the output."""

    weights: dict[str, np.ndarray]

    def inputs(self, x: Leaves) -> np.ndarray:
        w = self.weights
        return np.concatenate([_means(w["path"], x.path, x.path_of, len(x.measures)), _means(w["word"], x.word, x.word_of, len(x.measures)), x.measures], axis=1)

    def side(self, own: np.ndarray, places: np.ndarray, name: str, trace: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Time and hidden states of the pages whose blocks ``places`` (time, page) names; inputs are weighed some steps at a time."""
        w, u, b = (self.weights[name + k] for k in "wub")
        h = c = np.zeros((places.shape[1], HIDDEN), np.float32)
        for begin in range(0, len(places), 512):
            flow = own[places[begin : begin + 512]] @ w + b
            for t in range(len(flow)):
                g = flow[t] + h @ u
                s = _sigmoid(g[:, : 3 * HIDDEN])
                new = np.tanh(g[:, 3 * HIDDEN :])
                i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
                h_before, c_before = h, c
                c = f * c + i * new
                th = np.tanh(c)
                h = o * th
                if trace is not None:
                    trace.append((h_before, c_before, i, f, o, new, th))
                yield begin + t, h

    def logits(self, x: Leaves) -> np.ndarray:
        """A logit for each block. Pages of like length go side by side; a page's logits depend on the others by
        their last bits at most, so they count to four digits."""
        n = np.diff(x.first)
        own, out = self.inputs(x), np.zeros(int(x.first[-1]), np.float32)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * n[order[to]] <= STEP:
                to += 1
            for name, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
                places = _places(x.first[order[at:to]], n[order[at:to]], name)
                for t, h in self.side(own, places, name):
                    inside = t < n[order[at:to]]
                    out[places[t][inside]] += h[inside] @ self.weights["v"][half]
            at = to
        return np.round(out + self.weights["c"][0], 4)


def _means(table: np.ndarray, entries: np.ndarray, of: np.ndarray, n: int, step: int = 1 << 18) -> np.ndarray:
    """Mean embedding of each row's entries, which stand by row; a row of any length is summed in steps."""
    out = np.zeros((n, table.shape[1]), np.float32)
    for k in range(0, len(entries), step):
        rows = of[k : k + step]
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[at]] += np.add.reduceat(table[entries[k : k + step]], at, axis=0)
    return out / np.maximum(np.bincount(of, minlength=n), 1)[:, None].astype(np.float32)


def _places(first: np.ndarray, n: np.ndarray, name: str) -> np.ndarray:
    """The block that each page (column) shows at each time, from its begin or its end; behind a page's last, that one again."""
    t = np.minimum(np.arange(int(n.max()))[:, None], n - 1)
    return first + (t if name == "f" else n - 1 - t)


def fresh_weights(random: np.random.Generator) -> dict[str, np.ndarray]:
    wide = 2 * WIDTH + MEASURES
    out = {"path": random.normal(0, 0.3, (PATHS, WIDTH)), "word": random.normal(0, 0.05, (WORDS, WIDTH)), "v": random.normal(0, 0.2, 2 * HIDDEN), "c": np.zeros(1)}
    for name in "fb":
        out |= {f"{name}w": random.normal(0, wide**-0.5, (wide, 4 * HIDDEN)), f"{name}u": random.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"{name}b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    return {k: x.astype(np.float32) for k, x in out.items()}


def gradients(model: Labeller, x: Leaves, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log-loss of the blocks and its gradients, back through time on both sides."""
    w, n, own = model.weights, np.diff(x.first), model.inputs(x)
    total, hidden, traces = np.zeros(len(y), np.float32), {}, {}
    for name, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        places, trace = _places(x.first[:-1], n, name), []
        states = np.stack([h for _, h in model.side(own, places, name, trace)])
        inside = np.arange(len(places))[:, None] < n
        hidden[name], traces[name] = states, (places, inside, trace)
        total[places[inside]] += states[inside] @ w["v"][half]
    p = _sigmoid(total + w["c"][0])
    loss = float(-np.mean(np.where(y > 0.5, np.log(p + 1e-7), np.log(1 - p + 1e-7))))
    d = (p - y) / len(y)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["c"][0] = d.sum()
    back = np.zeros_like(own)
    for name, half in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        places, inside, trace = traces[name]
        d_out = np.where(inside, d[places], 0)
        grads["v"][half] = np.einsum("tp,tph->h", d_out, hidden[name])
        gates = np.zeros((*places.shape, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((places.shape[1], HIDDEN), np.float32)
        for t in range(len(places) - 1, -1, -1):
            before, c_before, i, f, o, new, th = trace[t]
            dh = dh + d_out[t][:, None] * w["v"][half]
            dc = dc + dh * o * (1 - th * th)
            g = np.concatenate([dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            gates[t] = g
            grads[f"{name}u"] += before.T @ g
            dh, dc = g @ w[f"{name}u"].T, dc * f
        flat, at = gates[inside], places[inside]
        grads[f"{name}w"], grads[f"{name}b"] = own[at].T @ flat, flat.sum(axis=0)
        back[at] += flat @ w[f"{name}w"].T
    for kind, entries, of, part in (("path", x.path, x.path_of, slice(0, WIDTH)), ("word", x.word, x.word_of, slice(WIDTH, 2 * WIDTH))):
        share = back[:, part] / np.bincount(of, minlength=len(y))[:, None]
        order = np.argsort(entries, kind="stable")
        at = np.flatnonzero(np.diff(entries[order], prepend=-1))
        grads[kind][entries[order[at]]] = np.add.reduceat(share[of[order]], at, axis=0)
    return loss, grads


#: Stands before main text in drawn pages.
MARK = "\ue000"


def labelled(pages: list[str]) -> tuple[Leaves, np.ndarray]:
    """Drawn pages as numbers, and whether each block is main text."""
    made = [blocks(p) for p in pages]
    y = np.array([MARK in b.text for own, _ in made for b in own], np.float32)
    for own, _ in made:
        for b in own:
            b.text = b.text.replace(MARK, "") or "."
    return numbered(made), y


def fit(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Adam over batches of drawn pages of like length."""
    random = np.random.default_rng(seed)
    drawn = [draw(random, MARK) for _ in range(pages)]
    drawn.sort(key=lambda p: p.count("<"))
    batches = [labelled(drawn[k : k + BATCH]) for k in range(0, pages, BATCH)]
    model = Labeller(fresh_weights(random))
    m, v, t = {k: 0.0 for k in model.weights}, {k: 0.0 for k in model.weights}, 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for k in random.permutation(len(batches)):
            _, grads = gradients(model, *batches[k])
            t += 1
            for key, g in grads.items():
                m[key], v[key] = 0.9 * m[key] + 0.1 * g, 0.99 * v[key] + 0.01 * g * g
                model.weights[key] -= (rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """The network of a seed, made once in a process."""
    return fit(pages, epochs, seed)


SCHEMA = "array<struct<text: string, path: string, score: double, main: boolean>>"


def label_blocks(pages: DataFrame, model: Labeller | None = None, threshold: float = 0.5, column: str = "blocks", step: int = 1 << 20) -> DataFrame:
    """All columns of ``pages`` and the leaf blocks of ``html``, in order: text, tag path, score and whether it is main text.

    Null and empty html have no blocks. Rows that repeat get equal blocks. A page is read whole, whatever its length; pages are
    read some MB at a time. ``column`` replaces a column of that name."""
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    rest = [c for c in pages.columns if c != column]
    kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("score", pa.float64()), ("main", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("html")
            sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
            at, ends = 0, np.concatenate([[0], np.cumsum(sizes)])
            while at < batch.num_rows:
                to = min(max(int(np.searchsorted(ends, ends[at] + step, side="right")) - 1, at + 1), batch.num_rows)
                read = [blocks(x or "") for x in texts.slice(at, to - at).to_pylist()]
                scores = 1 / (1 + np.exp(-sent.value.logits(numbered(read)).astype(np.float64)))
                flat = [b for own, _ in read for b in own]
                names = [x for own, paths in read for x in _paths(own, paths)]
                ends_of = np.concatenate([[0], np.cumsum([len(own) for own, _ in read])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array([b.text for b in flat], pa.string()), pa.array(names, pa.string()), pa.array(scores), pa.array(scores >= threshold)], fields=list(kind.value_type))
                made = pa.ListArray.from_arrays(ends_of, values)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], made], [*rest, column])
                at = to

    own = pages.select(*[F.col(f"`{c}`") for c in rest])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(work, f"{kinds}, `{column}` {SCHEMA}")


def _paths(own: list[Block], paths: list[tuple[int, tuple[str, ...]]]) -> list[str]:
    """Each block's elements from the outermost; of very deep ones the 8 nearest."""
    known: dict[int, str] = {}
    for b in own:
        if b.path not in known:
            out, at = [], b.path
            while at > 0 and len(out) < 8:
                out.append("".join(paths[at][1]))
                at = paths[at][0]
            known[b.path] = "/".join(out[::-1])
    return [known[b.path] for b in own]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row: the main blocks in page order, joined by one space. An empty table gives no rows."""
    made = label_blocks(pages.select("page_id", "url", "html"), model)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["main"]), lambda b: b["text"]), " ")
    return made.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), F.size(F.filter("blocks", lambda b: b["main"])).cast("long").alias("n_main"))
