"""Main text of web pages: a recurrent labeller decides on every block from its tag path, its words and the whole page."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import stored
from mendwell.llm.lstm import Labeller

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*>?|<[!?/][^>]*>?",
    re.DOTALL | re.IGNORECASE,
)
# Elements that are left out with what they hold, and the ends of one: fixed values. A block element ends an open svg.
HELD = frozenset("noscript template svg iframe object canvas".split())
HELD_END = re.compile(r"</(noscript|template|svg|iframe|object|canvas)\s*>", re.IGNORECASE)
BLOCK_START = re.compile(r"<(?:p|div|section|article|main|h[1-6]|[uo]l|table|blockquote|pre|header|footer|nav|aside|form|body)\b", re.IGNORECASE)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]{2,}")
# Elements that stand on lines of their own: fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
# What a new element ends without an end tag, and what keeps it from ending more.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPE = frozenset("ul ol menu dl table select body html".split())

PATH, WORDS, UNITS = 512, 64, 24
INPUTS = PATH + WORDS + 5
SEED = 11
# Pages that the labeller learns from, at most, and variants of each.
MAX_TRAIN, VARIANTS, EPOCHS = 400, 5, 10
# Blocks of a run of a page that is learnt from, and runs of one page at most.
RUN, RUNS = 400, 4

# Names by which blocks are taught: parts of pages that aren't the text, and containers of the text.
OTHER = frozenset(
    "nav menu header footer sidebar side aside ad ads advert advertisement adverts sponsor sponsored promo banner notice cookie cookies consent "
    "popup modal newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager share social related recommended widget "
    "toolbar masthead copyright legal disclaimer comment comments reply replies discussion respond form navigation navbar complementary contentinfo alert toc tags meta".split()
)
OTHER_TAGS = frozenset("nav header footer aside form button select option textarea label legend fieldset head title dialog menu search".split())
MAIN = frozenset("content article post entry story main body text".split())
MAIN_TAGS = frozenset("article main".split())


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class HeldEnds:
    """Where elements that are left out end on a page, looked up in sorted places."""

    def __init__(self, page: str):
        self.page, self.ends, self.blocks = page, None, None

    def after(self, tag: str, at: int) -> int:
        """The end of an element whose start tag ends at ``at``: of the tag itself where the element isn't closed."""
        if self.ends is None:
            self.ends, self.blocks = {t: [] for t in HELD}, [m.start() for m in BLOCK_START.finditer(self.page)]
            for m in HELD_END.finditer(self.page):
                self.ends[m[1].lower()].append((m.start(), m.end()))
        k = bisect_left(self.ends[tag], (at, 0))
        if k == len(self.ends[tag]):
            return at
        start, end = self.ends[tag][k]
        if tag == "svg":
            b = bisect_left(self.blocks, at)
            if b < len(self.blocks) and self.blocks[b] < start:
                return at
        return end


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order: their open elements (tag and names), text with single spaces, and characters in links."""
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append(Block(tuple(stack), text, min(linked, len(text))))
        held, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            held.append(text)
            if in_link:
                linked += len(text.strip())

    page, at = page or "", 0
    ends = HeldEnds(page)
    for match in MARKUP.finditer(page):
        if match.start() < at:
            continue
        add(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or "").lower()
        if not tag:
            continue
        if tag in HELD:
            if not match["close"] and not match["rest"].endswith("/"):
                at = ends.after(tag, at)
            continue
        if tag == "a":
            in_link = not match["close"]
        elif tag == "br":
            held.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            open_tags = [t for t, _ in stack]
            if match["close"]:
                in_link = False
                if tag in open_tags:
                    del stack[len(stack) - 1 - open_tags[::-1].index(tag) :]
                continue
            if "p" in open_tags[-1:]:
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS.get(tag, ()):
                    del stack[k:]
                elif stack[k][0] in SCOPE:
                    break
            names = [a or b or c for _, a, b, c in NAMES.findall(match["rest"])] if "=" in match["rest"] else []
            stack.append((tag, tuple(TOKEN.findall(" ".join(names).lower()))))
    add(page[at:])
    flush()
    return found


def taught(path: tuple, text: str, linked: int, has_main: bool) -> bool:
    """What a block is taken for in training, from the names around it. Only the labeller decides on pages."""
    main = False
    for tag, names in path:
        if tag in MAIN_TAGS or (MAIN.intersection(names) and not OTHER.intersection(names)):
            main = True
        elif (tag in OTHER_TAGS and not (main and tag == "header")) or OTHER.intersection(names):
            return False
    return main if has_main else len(text.split()) >= 10 and 2 * linked < len(text)


def _bucket(name: str, size: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name) % size


class Inputs:
    """Vectors of blocks; a worker keeps those of up to ``max_known`` paths and words."""

    def __init__(self, max_known: int = 200_000):
        self.max_known, self.paths, self.words = max_known, {}, {}

    def path(self, path: tuple) -> np.ndarray:
        found = self.paths.get(path)
        if found is None:
            found = np.zeros(PATH, np.float32)
            for depth, (tag, names) in enumerate(path):
                last = depth == len(path) - 1
                for name in (f"tag:{tag}", *(f"name:{n}" for n in names), *([f"leaf:{tag}"] if last else [])):
                    found[_bucket(name, PATH)] += 1
            found = np.minimum(found, 2)
            if len(self.paths) < self.max_known:
                self.paths[path] = found
        return found

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = _bucket(word.lower(), WORDS)
            if len(self.words) < self.max_known:
                self.words[word] = found
        return found

    def of(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), INPUTS), np.float32)
        for k, block in enumerate(blocks):
            out[k, :PATH] = self.path(block.path)
            found = block.text.split()
            counts = np.bincount(np.fromiter(map(self.word, found), np.int64, len(found)), minlength=WORDS)
            out[k, PATH : PATH + WORDS] = counts / np.sqrt((counts**2).sum())
            size = len(block.text)
            out[k, PATH + WORDS :] = np.log1p(size) / 8, np.log1p(len(found)) / 6, block.linked / size, 1 / (1 + k), 1 / (len(blocks) - k)
        return out


def variants(pages: list[list[Block]], seed: int = SEED, each: int = VARIANTS) -> Iterator[tuple[list[Block], list[bool]]]:
    """Pages to learn from: as they are, and laid out anew with other containers, neutral names, and parts of pages that aren't text."""
    rng = np.random.default_rng(seed)
    pick = lambda values: values[int(rng.integers(len(values)))]
    spoken = [b.text for blocks in pages for b in blocks] or ["text"]
    other, wraps = sorted(OTHER), [(), ("container",), ("wrapper", "page"), ("site",), ("row",), ("col",), ("inner",)]
    other_tags, neutral = sorted(OTHER_TAGS - {"head", "title", "option"}), ["box", "item", "block", "panel", "left", "right", "top", "card", "list", "grid"]
    # What looks most like text.
    hard = ["comment", "comments", "reply", "notice", "sidebar", "disclaimer"]
    containers = [("article", ()), ("main", ()), ("section", ("article",)), ("div", ("content",)), ("div", ("post",)), ("div", ("entry", "content")), ("div", ("main", "content")), ("div", ("article", "body")), ("div", ("story",))]

    def names() -> tuple:
        return tuple(pick(neutral) if rng.random() < 0.6 else "".join(map(chr, rng.integers(97, 123, 6))) for _ in range(int(rng.integers(0, 3))))

    def aside_part(root: tuple) -> list[Block]:
        head = (pick(other_tags), names()) if rng.random() < 0.5 else (pick(["div", "section", "ul", "ol"]), (pick(hard if rng.random() < 0.4 else other), *names()))
        leaf, n = pick([(), (("ul", ()), ("li", ())), (("p", ()),), (("div", names()), ("p", ())), (("div", (pick(hard), *names())), ("p", ())), (("p", ()),), (("h3", ()),), (("div", names()),)]), int(rng.integers(1, 6))
        made = []
        for _ in range(n):
            text = " ".join(pick(spoken).split()[: int(rng.integers(1, 60))])
            made.append(Block((*root, head, *leaf), text, len(text) if rng.random() < 0.4 else 0))
        return made

    for blocks in pages:
        mains = any(tag in MAIN_TAGS or MAIN.intersection(n) for b in blocks for tag, n in b.path if tag != "body")
        labels = [taught(b.path, b.text, b.linked, mains) for b in blocks]
        yield blocks, labels
        core = [b for b, yes in zip(blocks, labels, strict=True) if yes]
        for _ in range(each - 1):
            root = (("html", ()), ("body", names() if rng.random() < 0.3 else ()))
            root += tuple(("div", pick(wraps)) for _ in range(int(rng.integers(0, 3))))
            inner = (*root, pick(containers), *((("div", names()),) if rng.random() < 0.3 else ()))
            if rng.random() < 0.15:
                inner = (*root, ("div", names()))
            made = [(x, False) for _ in range(int(rng.integers(1, 5))) for x in aside_part(root)]
            for k, b in enumerate(core):
                leaf = b.path[-1] if b.path and b.path[-1][0] not in MAIN_TAGS else ("p", ())
                extra = (pick([("ul", ()), ("ol", ())]), ("li", ())) if rng.random() < 0.15 else (pick([("blockquote", ()), ("pre", ()), ("h2", ()), ("td", ())]),) if rng.random() < 0.08 else (leaf,)
                text = b.text if rng.random() < 0.6 else " ".join(b.text.split()[: int(rng.integers(1, 6))])
                made.append((Block((*inner, *((("header", ()),) if k == 0 and leaf[0] == "h1" and rng.random() < 0.1 else ()), *extra), text, 0), True))
                if rng.random() < 0.12:
                    made += [(x, False) for x in aside_part(inner)]
            made += [(x, False) for _ in range(int(rng.integers(1, 5))) for x in aside_part(root if rng.random() < 0.6 else inner)]
            yield [b for b, _ in made], [yes for _, yes in made]


def fit(pages: list[str]) -> Labeller:
    """A labeller taught on the pages and variants of them. Of a page over ``RUN`` blocks up to ``RUNS`` runs of so many are used, the first, the last and some between."""
    inputs, rows = Inputs(), []
    for blocks, labels in variants([b for b in map(blocks_of, pages) if b]):
        if blocks:
            whole, known = inputs.of(blocks), np.array(labels, np.float32)
            starts = np.unique(np.linspace(0, max(0, len(blocks) - RUN), min(RUNS, -(-len(blocks) // RUN))).astype(int))
            rows += [(whole[k : k + RUN], known[k : k + RUN]) for k in starts]
    rows.sort(key=lambda r: len(r[1]))
    batches = []
    for at in range(0, len(rows), 24):
        part = rows[at : at + 24]
        lengths = np.array([len(y) for _, y in part])
        x, y = np.zeros((lengths.max(), len(part), INPUTS), np.float32), np.zeros((lengths.max(), len(part)), np.float32)
        for k, (a, b) in enumerate(part):
            x[: len(b), k], y[: len(b), k] = a, b
        batches.append((x, y, lengths))
    labeller = Labeller.fresh(INPUTS, UNITS, SEED)
    labeller.train(batches, EPOCHS, 0.004, SEED)
    return labeller


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_train: int = MAX_TRAIN) -> Labeller:
    """A labeller learnt in one task from up to ``max_train`` pages, chosen by a hash of their ids and contents; the result is the same for the same rows. Without pages it is one that has learnt nothing."""
    chosen = pages.select(F.col(html_col).alias("html"), F.xxhash64(id_col, html_col).alias("_h")).filter("html IS NOT NULL").orderBy("_h", "html").limit(max_train)

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([pd.DataFrame({"html": [], "_h": []}), *frames]).sort_values(["_h", "html"])
        weights = fit(frame["html"].tolist()).weights
        yield pd.DataFrame({"name": list(weights), "shape": [list(w.shape) for w in weights.values()], "held": [w.astype("<f4").tobytes() for w in weights.values()]})

    rows = stored(chosen.repartition(1).mapInPandas(learn, "name string, shape array<int>, held binary"), "labeller").collect()
    if not rows:
        return Labeller.fresh(INPUTS, UNITS, SEED)
    return Labeller({r.name: np.frombuffer(bytes(r.held), "<f4").reshape(r.shape) for r in rows})


class Extractor:
    """Main texts of pages. It reaches the workers as a broadcast variable."""

    def __init__(self, weights: dict):
        self.weights, self.labeller, self.inputs = weights, Labeller(weights), Inputs()

    def __reduce__(self):
        return type(self), (self.weights,)

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Log-odds of each block. Pages of like lengths are read side by side."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            # As many pages as make up some 4,000 steps, at least one.
            side = 1
            while side < len(order) and (side + 1) * len(pages[order[side]]) <= 4000:
                side += 1
            part, order = order[:side], order[side:]
            lengths = np.array([len(pages[k]) for k in part])
            x = np.zeros((lengths.max(), side, INPUTS), np.float32)
            for n, k in enumerate(part):
                x[: lengths[n], n] = self.inputs.of(pages[k])
            z = self.labeller.forward(x, lengths)
            for n, k in enumerate(part):
                out[k] = z[: lengths[n], n]
        return out

    def texts(self, pages: list[str | None]) -> list[tuple[str, int, int]]:
        """Text, blocks, and blocks of the text of each page."""
        cut = [blocks_of(page) for page in pages]
        made = []
        for blocks, z in zip(cut, self.scores(cut), strict=True):
            kept = [b.text for b, score in zip(blocks, z, strict=True) if score > 0]
            made.append(("\n".join(kept), len(blocks), len(kept)))
        return made


def extractor(spark, labeller: Labeller, html_col: str) -> Column:
    held = spark.sparkContext.broadcast(Extractor({k: np.array(v) for k, v in labeller.weights.items()}))

    @F.pandas_udf("text string, n_blocks int, n_content int")
    def extract(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for at in range(0, len(pages), 200):
            rows += held.value.texts(pages.iloc[at : at + 200].tolist())
        return pd.DataFrame(rows, columns=["text", "n_blocks", "n_content"])

    return extract(F.col(html_col))


def extracted(pages: DataFrame, labeller: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text, n_chars, n_blocks, n_content``: the blocks labelled as main text, one a line, and how many blocks there are.

    Character references are decoded, white space within a block becomes one space, ``br`` counts as white space.
    Null, empty and textless pages give an empty text. Every row comes back, repeated ones with the same text; columns named like the results are
    replaced. Pages are read whole; nothing is shuffled.
    """
    found = pages.drop("text", "n_chars", "n_blocks", "n_content").withColumn("_found", extractor(pages.sparkSession, labeller, html_col))
    return found.select("*", F.col("_found.text").alias("text"), F.length("_found.text").cast("long").alias("n_chars"), F.col("_found.n_blocks").alias("n_blocks"), F.col("_found.n_content").alias("n_content")).drop("_found")
