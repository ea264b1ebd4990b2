"""Main-text extraction from HTML by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block
tags or line breaks, each with its tag path.  A bidirectional LSTM in numpy
reads per block a vector of hashed path tokens, hashed words and a few
measures, and labels every block with the whole page as context; the article's
blocks are joined.  Formulas, drawings and other embedded text stay part of
their block; scripts, styles, templates, frames and text fields do not.

The model is fitted on a sample of ``FIT_PAGES`` distinct pages of any length,
drawn by hash; of a page of more than ``FIT_BLOCKS`` blocks, on windows spread
from its first block to its last.  Blocks are labelled by the containers that
authors mark (article and main against navigation, headers, forms and the
like).  On a page that marks no article, blocks outside the other containers
are unlabelled: they are context and do not enter the loss.  Variants of the
pages, with menus, notices, comments and other containers around the same texts
(up to ``FIT_CHARS`` of each), teach containers that a site at hand may lack,
articles in containers of any name among them.  Built-in pages are always among
the sample, and training takes ``FIT_STEPS`` steps at least, so that small tables
get a fitted model too.

Defined cases: null or empty html, and pages without an article, give an empty
text; broken, unclosed and cut-off markup is read as far as it goes; long
pages are read whole; repeated rows give equal texts; an empty table gives an
empty result; extra columns are not touched.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds on the labelled sample: pages, blocks of a page (in so many windows if it has more), and characters of a
#: block's text in variants.
FIT_PAGES, FIT_BLOCKS, FIT_WINDOWS, FIT_CHARS = 240, 120, 4, 4_000
#: Built-in pages and training steps that every model is fitted with at least.
BUILT_IN, FIT_STEPS = 48, 160
PATH_DIM, WORD_DIM, HIDDEN = 96, 48, 16

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split())
REPEATING = frozenset("li dd dt td tr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = "script|style|template|textarea|iframe"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'"<>])*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>?""",
    re.S | re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What the teacher takes for containers of an article and of anything else.
MAIN = frozenset("article main post-body entry-content article-body".split())
OTHER = frozenset(
    "head nav header footer aside form menu dialog select button ad ads advert banner promo sponsored sidebar comment "
    "comments notice cookie cookies consent newsletter subscribe share social related breadcrumb navigation "
    "contentinfo complementary".split())


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path tokens, raw text, characters inside links) per leaf block."""
    out, stack, path = [], [], ()
    text: list[str] = []
    linked, in_link, last = 0, 0, 0
    page = page or ""

    def flush():
        nonlocal linked
        joined = "".join(text)
        text.clear()
        if joined and not joined.isspace():
            out.append((path, joined, linked))
        linked = 0

    def add(piece):
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if in_link else 0

    for m in TOKEN.finditer(page):
        add(page[last:m.start()])
        last = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing = m[2] or m[5]
        if name == "a":
            in_link = max(0, in_link - 1) if closing else 1
        if name == "br" or name == "hr":
            flush()
        if name not in BLOCK_TAGS or name in VOID:
            continue
        flush()
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is not None:
                path = stack[at][1]
                del stack[at:]
            in_link = 0
        else:
            if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in REPEATING):
                path = stack.pop()[1]            # block content ends an open paragraph, an item the one before
            stack.append((name, path))
            path += (name,)
            if m[4]:
                path += tuple("." + w.lower() for g in NAMED.findall(m[4]) for w in "".join(g).replace("_", " ").split())
    add(page[last:])
    flush()
    return out


def clean(raw: str) -> str:
    """References decoded, white space runs one space."""
    return " ".join(entities.unescape(raw).split())


def _bucket(token: str, dim: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % dim


def vectors(page_blocks, known: dict, first: int = 0, of: int | None = None) -> np.ndarray:
    """Block vectors: hashed path (its last element apart), hashed words, measures.
    A window of a page starts at block ``first`` of its ``of`` blocks."""
    n = len(page_blocks)
    of = of or n
    k = 2 * PATH_DIM + WORD_DIM
    x = np.zeros((n, k + 6), np.float32)
    paths = known["P"]
    for i, (path, raw, linked) in enumerate(page_blocks):
        at = paths.get(path)
        if at is None:
            if len(paths) > 50_000:
                paths.clear()
            at = paths[path] = [_bucket("P" + t, PATH_DIM) for t in path] + [
                PATH_DIM + _bucket("L" + t, PATH_DIM) for t in path[-1:]]
        x[i, at] = 1
        words = raw.split()
        if words:
            hashed = np.bincount(np.fromiter(map(known["W"].__getitem__, words), np.int64, len(words)),
                                 minlength=WORD_DIM)
            x[i, 2 * PATH_DIM:k] = hashed / len(words)
        marks = sum(map(raw.count, ".,;:!?"))
        x[i, k:] = (math.log1p(len(raw)) / 8, math.log1p(len(words)) / 6, linked / max(1, len(raw)),
                    marks / max(1, len(words)), (first + i) / of, 1)
    return x


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = k = _bucket("W" + word.lower(), WORD_DIM)
        return k


def memory() -> dict:
    """What a worker remembers of paths and words."""
    return {"P": {}, "W": _WordBuckets()}


def input_size() -> int:
    return 2 * PATH_DIM + WORD_DIM + 6


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM and a logistic output per block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 9):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = g(inputs, 4 * hidden), g(hidden, 4 * hidden)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden:2 * hidden] = 1                    # remember at first
        self.p["o"], self.p["q"] = g(2 * hidden, 1), np.zeros(1, np.float32)

    def _pass(self, x, mask, d, keep):
        """States of one direction; x (pages, blocks, inputs), mask 1 for real blocks."""
        b, t, _ = x.shape
        n, z = self.h, x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out, tape = np.zeros((b, t, n), np.float32), []
        for s in (range(t) if d == "f" else range(t - 1, -1, -1)):
            a = z[:, s] + h @ self.p["h" + d]
            i, f, o = _sigmoid(a[:, :n]), _sigmoid(a[:, n:2 * n]), _sigmoid(a[:, 2 * n:3 * n])
            u, m = np.tanh(a[:, 3 * n:]), mask[:, s, None]
            c2 = f * c + i * u
            tc = np.tanh(c2)
            if keep:
                tape.append((s, h, c, i, f, o, u, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, s] = h
        return out, tape

    def predict(self, x, mask):
        hf, hb = self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]
        return _sigmoid(np.concatenate([hf, hb], axis=2) @ self.p["o"] + self.p["q"])[..., 0]

    def gradients(self, x, mask, y, care=None):
        """``care``: weight of every block in the loss (all real blocks alike if not given)."""
        n, care = self.h, mask if care is None else care
        hf, tf = self._pass(x, mask, "f", True)
        hb, tb = self._pass(x, mask, "b", True)
        hh = np.concatenate([hf, hb], axis=2)
        err = ((_sigmoid(hh @ self.p["o"] + self.p["q"])[..., 0] - y) * care / max(1.0, care.sum()))[..., None]
        grad = {"o": np.einsum("bth,bto->ho", hh, err), "q": err.sum((0, 1))}
        up = err @ self.p["o"].T
        for d, tape, part in (("f", tf, up[..., :n]), ("b", tb, up[..., n:])):
            dz = np.zeros(x.shape[:2] + (4 * n,), np.float32)
            dh, dc, dw = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros_like(self.p["h" + d])
            for s, h, c, i, f, o, u, tc, m in reversed(tape):
                dh = dh + part[:, s]
                live = dh * m
                dct = dc * m + live * o * (1 - tc * tc)
                da = np.concatenate([dct * u * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o),
                                     dct * i * (1 - u * u)], axis=1)
                dz[:, s] = da
                dw += h.T @ da
                dh, dc = da @ self.p["h" + d].T + dh * (1 - m), dct * f + dc * (1 - m)
            grad["x" + d] = np.einsum("bti,btg->ig", x, dz)
            grad["c" + d], grad["h" + d] = dz.sum((0, 1)), dw
        return grad

    def fit(self, pages, rounds: int = 8, batch: int = 24, rate: float = 0.02, seed: int = 9, steps: int = FIT_STEPS):
        """Adam on (vectors, labels, weights) per page: ``rounds`` over all, and ``steps`` at least."""
        if not pages:
            raise ValueError("no pages to fit the block labeller on")
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        order = np.argsort([len(x) for x, _, _ in pages], kind="stable")
        groups = [order[k:k + batch] for k in range(0, len(order), batch)]
        for _ in range(max(rounds, -(-steps // len(groups)))):
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[k][0] for k in groups[g]])
                y, care = np.zeros(mask.shape, np.float32), np.zeros(mask.shape, np.float32)
                for r, k in enumerate(groups[g]):
                    y[r, :len(pages[k][1])], care[r, :len(pages[k][2])] = pages[k][1:]
                step += 1
                for k, d in self.gradients(x, mask, y, care).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self


def padded(xs):
    t = max(map(len, xs))
    x = np.zeros((len(xs), t, xs[0].shape[1]), np.float32)
    mask = np.zeros((len(xs), t), np.float32)
    for r, one in enumerate(xs):
        x[r, :len(one)] = one
        mask[r, :len(one)] = 1
    return x, mask


#: Class that marks the article of a variant; the model never sees it.
MARK = ".@article"


def _marked(path: tuple[str, ...]) -> tuple[bool, bool]:
    """(inside a marked article, inside any other container)."""
    bare = [re.split(r"-", t.lstrip(".")) + [t.lstrip(".")] for t in path]
    return (MARK in path or any(MAIN & set(ws) for ws in bare)), any(OTHER & set(ws) for ws in bare)


def teacher(path: tuple[str, ...]) -> int:
    """Label by marked containers: inside an article, and in nothing else within it."""
    main, other = _marked(path)
    return int(main and not other)


def lesson(paths: list[tuple[str, ...]], whole: list[tuple[str, ...]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, weights) of blocks.  Where the page (``whole``) marks no article,
    blocks outside all known containers weigh nothing."""
    marks = [_marked(p) for p in paths]
    has = any(main and not other for main, other in (marks if whole is None else map(_marked, whole)))
    return (np.array([main and not other for main, other in marks], np.float32),
            np.array([has or other for _, other in marks], np.float32))


#: Containers that variants of sample pages put other texts into.
AROUND = ("<header>{}</header>", "<aside class=\"sidebar\"><p>{}</p></aside>", "<form><p>{}</p></form>",
          "<div class=\"cookie-notice\"><p>{}</p></div>", "<div class=\"banner\">{}</div>", "<div id=\"menu\">{}</div>",
          "<div class=\"promo\"><p>{}</p></div>", "<div class=\"newsletter\">{}</div>", "<footer><p>{}</p></footer>")
INSIDE = ("<section class=\"comments\"><div class=\"comment\"><p>{}</p></div></section>",
          "<div class=\"comment\"><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div class=\"ad\">{}</div>",
          "<div class=\"share\">{}</div>", "<div class=\"related\"><ul><li>{}</li></ul></div>",
          "<div class=\"notice\"><p>{}</p></div>", "<form><p>{}</p></form>", "<nav><ul><li>{}</li></ul></nav>")
SHELLS = ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
          "<div class=\"post-body\">{}</div>", "<article><section>{}</section></article>")
#: Containers without a name that tells, for an article or for anything; ``@`` becomes made-up names.
PLAIN = ("<div id=\"@\" class=\"@article\">{}</div>", "<div class=\"@ @article\"><div class=\"@\">{}</div></div>",
         "<section class=\"@ @article\">{}</section>", "<table><tr><td class=\"@article\">{}</td></tr></table>",
         "<div id=\"content\" class=\"@article\">{}</div>", "<div class=\"@article\">{}</div>")


def variants(pages: list[str], rng) -> list[str]:
    """The same paragraphs in other layouts, with other containers about them."""
    return _variants([[(path, raw) for path, raw, _ in blocks(p)] for p in pages], rng)


def _variants(pages: list[list[tuple]], rng) -> list[str]:
    """``variants`` of pages given as (path, raw text) per block."""
    pool = [raw for p in pages for _, raw in p if len(raw) > 40] or ["Some text of a page."]
    pick = lambda some: some[rng.integers(len(some))]
    name = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 9)))
    out = []
    for p in pages:
        # a page that marks no article lends texts of any page
        body = [raw for path, raw in p if teacher(path)][:20] or [pick(pool) for _ in range(rng.integers(2, 12))]
        own = []
        for raw in body:
            own.append(f"<p>{raw}</p>" if rng.random() < 0.8 else pick(("<h2>{}</h2>", "<ul><li>{}</li></ul>",
                                                                        "<blockquote>{}</blockquote>")).format(raw))
            if rng.random() < 0.15:
                own.append(pick(INSIDE).replace("{}", pick(pool)))
        if rng.random() < 0.6:
            own.append(pick(INSIDE).replace("{}", pick(pool)))
        before = [pick(AROUND).replace("{}", pick(pool)) for _ in range(rng.integers(0, 3))]
        after = [pick(AROUND).replace("{}", pick(pool)) for _ in range(rng.integers(0, 3))]
        if rng.random() < 0.5:
            shell = re.sub(r"@(?!article)", lambda _: name(), pick(PLAIN))
            items = lambda: "".join(f"<li><a href=\"/{name()}\">{name()}</a></li>" for _ in range(rng.integers(2, 7)))
            before = before or [f"<nav><ul>{items()}</ul></nav>"]
            after = after or [f"<footer><p>{name()} {name()}</p></footer>"]
        else:
            shell = pick(SHELLS)
        out.append("<html><body>" + "".join(before) + shell.replace("{}", "".join(own)) + "".join(after))
    return out


def built_in(rng, n: int = BUILT_IN) -> list[list[tuple]]:
    """Articles of made-up sentences, as (path, raw text) per block."""
    said = ("the a this every some old new small city river house report market school winter people water letter year "
            "road music field garden was is had found made took gave near under after before with without of and but "
            "because while later again slowly often").split()
    sentence = lambda: " ".join(rng.choice(said, rng.integers(4, 18))).capitalize() + str(rng.choice(list("...?!")))
    text = lambda most: " ".join(sentence() for _ in range(rng.integers(1, most)))
    return [[(("article", "p"), text(7)) for _ in range(rng.integers(2, 14))] for _ in range(n)]


def windows(n: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of a page's ``n`` blocks that a model is fitted on."""
    if n <= FIT_BLOCKS:
        return [(0, n)]
    size = FIT_BLOCKS // FIT_WINDOWS
    return [(at, at + size) for at in (k * (n - size) // (FIT_WINDOWS - 1) for k in range(FIT_WINDOWS))]


def _samples(batches):
    """Per page and window: vectors and labels, and its blocks' texts for variants."""
    import pyarrow as pa
    known = memory()
    for batch in batches:
        for mix, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = blocks(page.as_py())
            for first, end in windows(len(found)) if found else ():
                some = found[first:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([mix]), pa.array([first], pa.int32()),
                     pa.array([vectors(some, known, first, len(found)).tobytes()], pa.binary()),
                     pa.array([[list(path) for path, _, _ in some]], pa.list_(pa.list_(pa.string()))),
                     pa.array([[raw[:FIT_CHARS] for _, raw, _ in some]], pa.list_(pa.string()))],
                    ["mix", "first", "x", "paths", "texts"])


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = FIT_PAGES,
        rounds: int = 8) -> BlockLabeller:
    src = pages.select(F.xxhash64(id_col, html_col).alias("mix"), F.col(html_col).alias("html"))
    drawn = [r["mix"] for r in src.where(F.length("html") > 0).select("mix").distinct().orderBy("mix")
             .limit(fit_pages).collect()]
    got = (src.where(F.col("mix").isin(drawn)).dropDuplicates(["mix"]).mapInArrow(
        _samples, "mix long, first int, x binary, paths array<array<string>>, texts array<string>").collect()
        if drawn else [])
    rng = np.random.default_rng(9)
    data, texts, read = [], {}, []
    for r in sorted(got, key=lambda r: (r["mix"], r["first"])):
        paths = [tuple(p) for p in r["paths"]]
        read.append((r["mix"], np.frombuffer(r["x"], np.float32).reshape(len(paths), -1), paths))
        texts.setdefault(r["mix"], []).extend(zip(paths, r["texts"]))
    for mix, x, paths in read:
        data.append((x, *lesson(paths, [path for path, _ in texts[mix]])))
    known = memory()
    for p in _variants(list(texts.values()), rng) + _variants(built_in(rng), rng):
        some = blocks(p)
        data.append((vectors([(tuple(t for t in path if t != MARK), *rest) for path, *rest in some], known),
                     *lesson([path for path, _, _ in some])))
    return BlockLabeller(input_size()).fit(data, rounds)


def extract(pages: DataFrame, model: BlockLabeller | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", batch_blocks: int = 8_000,
            slice_chars: int = 8_000_000) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    model = model or fit(pages, id_col, html_col)

    def label(pages_now, known):
        """Texts of pages (blocks each), labelled with pages of similar length."""
        got = [""] * len(pages_now)
        group: list[int] = []

        def run():
            x, mask = padded([vectors(pages_now[k], known) for k in group])
            for k, p in zip(group, model.predict(x, mask)):
                parts = (clean(raw) for (_, raw, _), q in zip(pages_now[k], p) if q >= 0.5)
                got[k] = " ".join(t for t in parts if t)
            group.clear()
        for k in sorted(range(len(pages_now)), key=lambda k: len(pages_now[k])):
            n = len(pages_now[k])
            if group and (n > 1.2 * len(pages_now[group[0]]) + 2 or n * (len(group) + 1) > batch_blocks):
                run()
            if n:
                group.append(k)
        if group:
            run()
        return got

    def run(batches):
        import pyarrow as pa
        known = memory()

        def done(ids, urls, held):
            texts = label(held, known)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        for batch in batches:
            ids, urls, held, chars = [], [], [], 0
            for at, url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = page.as_py() or ""
                ids.append(at)
                urls.append(url)
                held.append(blocks(page))
                chars += len(page)
                if chars > slice_chars:
                    yield done(ids, urls, held)
                    ids, urls, held, chars = [], [], [], 0
            if ids:
                yield done(ids, urls, held)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
