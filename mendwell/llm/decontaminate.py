"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders. Windows of the templates, and of the plain
words, are joined by hash between items and documents. Where a placeholder stands, the
values on both sides are kept: within one alignment a value of the item must stand for one
value of the document. A capitalised word that opens a sentence may be a name or not, so its windows
are listed with it as a name and as a word. A document that holds most windows of an item, as it is or with other
numbers, names or units, is contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwell.llm.common import slices, stored
from mendwell.session import is_small

WINDOW = 5
CONTAINED = 0.8
CLOSERS = "\"')]}»”’"
EDGES = ".,;:!?\"'()[]{}«»“”‘’"
# Units that stand alone or behind a number: fixed values.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros usd eur gbp mph kph km/h m/s w kw kwh v hz khz mhz ghz".split()
)
NUMBER = re.compile(r"([$€£¥]?)[+-]?\d+(?:[.,:/]\d+)*(%?)([^\W\d_]*)")
NAME = re.compile(r"[A-Z][a-zà-öø-ÿ]+(?:['’-][A-Za-zà-öø-ÿ]+)*")
# Bits of the filter for each window of the items, and how many windows, of 8 bytes, are sent to every task at most.
BITS, MOST_SENT = 32, 1_000_000
HITS = "doc_id long, _row long, at int, hash long, slots array<string>, opens array<boolean>"
# Bytes of texts whose words are hashed at a time.
SLICE = 500_000
# Windows at a time for which the readings of their openers are hashed.
READ_AT_ONCE = 100_000
NO_READINGS = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]


class Words:
    """What words are in a template. A worker keeps what it knows of up to ``max_known`` words in tables."""

    def __init__(self, max_known: int = 200_000):
        self.max_known, self.known, self.factors = max_known, {}, {}
        self.plain, self.shape = np.zeros(max_known, np.uint64), np.zeros(max_known, np.uint64)
        self.kind, self.ends = np.zeros(max_known, np.int8), np.zeros(max_known, bool)

    def __reduce__(self):
        return type(self), (self.max_known,)

    @staticmethod
    def of(raw: str) -> tuple[int, int, int, bool]:
        """Hash of the word, hash of its placeholder or of the word, kind (0 word, 1 placeholder, 2 name unless a sentence begins), whether a sentence ends."""
        import xxhash

        core = raw.strip(EDGES)
        plain, first = core.lower(), core[:1]
        own, kind, shape = xxhash.xxh3_64_intdigest(plain), 0, None
        if first.isupper() and NAME.fullmatch(core):
            kind, shape = 2, "\0name"
        elif plain in UNITS and len(plain) > 1:
            kind, shape = 1, "\0unit"
        elif first and not first.isalpha() and (number := NUMBER.fullmatch(core)) and (not number[3] or number[3].lower() in UNITS):
            kind, shape = 1, "\0number" + ("\0unit" if number[1] or number[2] or number[3] else "")
        ends = raw[-1] in ".!?" or (raw[-1] in CLOSERS and raw.rstrip(CLOSERS)[-1:] in (".", "!", "?"))
        return own, own if shape is None else xxhash.xxh3_64_intdigest(shape), kind, ends

    def tables(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four values of each word."""
        at, others = list(map(self.known.get, raw)), {}
        if None in at:
            for k in [k for k, n in enumerate(at) if n is None]:
                n, found = self.known.get(raw[k]), None
                if n is None:
                    n, found = len(self.known), self.of(raw[k])
                    if n < self.max_known:
                        self.known[raw[k]] = n
                        self.plain[n], self.shape[n], self.kind[n], self.ends[n] = found
                    else:
                        n, others[k] = 0, found
                at[k] = n
        places = np.array(at, np.int64)
        out = self.plain[places], self.shape[places], self.kind[places], self.ends[places]
        for k, found in others.items():
            for values, value in zip(out, found, strict=True):
                values[k] = value
        return out

    def windows(self, raw: list[str], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """Hashes of the template and plain windows of ``width`` words, the places of slots and of openers, and the readings of openers.

        ``raw`` has the words of several texts, which begin at ``starts``; windows over their ends are listed too. In the
        templates openers, capitalised words that begin a sentence, are words; ``_readings`` has the windows with openers as names.
        """
        plain, shape, kind, ends = self.tables(raw)
        begins = np.concatenate([[True], ends[:-1]])
        begins[starts] = True
        opens = (kind == 2) & begins
        slot = (kind == 1) | ((kind == 2) & ~begins)
        named, shape = shape, np.where(slot, shape, plain)
        if width not in self.factors:
            drawn = np.random.default_rng(1000 + width).integers(0, 2**63, width, np.uint64)
            self.factors[width] = drawn * np.uint64(2) + np.uint64(1)
        hashed = _rolled(shape, self.factors[width])
        readings = _readings(shape, named, opens, self.factors[width]) if opens.any() else NO_READINGS
        # Most texts have no slots, and their plain windows are their templates.
        return hashed, _rolled(plain, self.factors[width]) if slot.any() else hashed, slot, opens, readings


def _rolled(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hashes of the windows of as many values as there are factors."""
    n = len(values) - len(factors) + 1
    held = np.zeros(n, np.uint64)
    for k, odd in enumerate(factors):
        held ^= values[k : k + n]
        held *= odd
        held ^= held >> np.uint64(31)
    return held


def _readings(shape: np.ndarray, named: np.ndarray, opens: np.ndarray, factors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``at, hash, chosen`` of the windows with openers, for every choice of openers that are names: bit k is the window's k-th opener.

    ``named`` has the words with all openers as names. Few windows have more than one opener.
    """
    size = len(factors)
    before = np.concatenate([[0], np.cumsum(opens)])
    n_opens = before[size:] - before[:-size]
    at = np.flatnonzero(n_opens)
    yield at, _rolled(np.where(opens, named, shape), factors)[at], (1 << n_opens[at]) - 1
    for n in range(2, n_opens.max() + 1):
        several, some = np.flatnonzero(n_opens == n), np.arange(1, (1 << n) - 1)
        step = max(1, READ_AT_ONCE // len(some))
        for k in range(0, len(several), step):
            at, chosen = np.repeat(several[k : k + step], len(some)), np.tile(some, len(several[k : k + step]))
            places = at + np.arange(size)[:, None]
            names = opens[places] & ((chosen >> (before[places] - before[at])) & 1).astype(bool)
            held = np.zeros(len(at), np.uint64)
            for values, odd in zip(np.where(names, named[places], shape[places]), factors, strict=True):
                held ^= values
                held *= odd
                held ^= held >> np.uint64(31)
            yield at, held, chosen


def _slots(slot: np.ndarray, raw: list[str], at: int, size: int) -> list[str | None]:
    """For each place of a window the value of its slot."""
    return [raw[k].strip(EDGES).lower() if slot[k] else None for k in range(at, at + size)]


def _rows(words: Words, text: str | None, width: int, wanted=None) -> Iterator[tuple[int, int, list[str | None], list[bool]]]:
    """``at, hash, slots, opens`` of the windows of one text, see ``_rows_of``."""
    for _, *row in _rows_of(words, [text], width, wanted):
        yield tuple(row)


def _rows_of(words: Words, texts: list[str | None], width: int, wanted=None) -> Iterator[tuple[int, int, int, list[str | None], list[bool]]]:
    """``text, at, hash, slots, opens`` of the template windows, with every reading of openers, and of plain windows that differ
    from them (whose slots are words and so empty). ``opens`` tells which slots are openers, ``text`` is the place in ``texts``.

    The texts are hashed as one sequence of words; a text shorter than a window is one window, and
    all of one length go together.
    """
    split = [(text or "").split() for text in texts]
    by_size: dict[int, list[int]] = {}
    for k, raw in enumerate(split):
        if raw:
            by_size.setdefault(min(width, len(raw)), []).append(k)
    for size, numbers in by_size.items():
        raw = list(chain.from_iterable(split[k] for k in numbers))
        lengths = np.array([len(split[k]) for k in numbers])
        starts = np.cumsum(lengths) - lengths
        # The text of each window, and whether it ends within it.
        of = np.repeat(np.arange(len(numbers)), lengths)[: len(raw) - size + 1]
        whole = np.arange(len(of)) + size <= (starts + lengths)[of]
        shape, plain, slot, opens, readings = words.windows(raw, starts, size)

        def placed(at: int) -> tuple[int, int]:
            return numbers[of[at]], at - int(starts[of[at]])

        for hashes, templates in ((shape, True), (plain, False)):
            # A plain window equal to its template is listed once.
            if not templates and plain is shape:
                continue
            mask = whole if templates else whole & (plain != shape)
            if wanted is not None:
                mask = mask & wanted(hashes)
            for at in np.flatnonzero(mask).tolist():
                yield *placed(at), int(hashes[at].view(np.int64)), _slots(slot, raw, at, size) if templates else [None] * size, [False] * size
        for places, hashes, chosen in readings:
            mask = whole[places]
            if wanted is not None:
                mask = mask & wanted(hashes)
            for k in np.flatnonzero(mask).tolist():
                at = int(places[k])
                names = np.flatnonzero(opens[at : at + size])
                opened = np.zeros(size, bool)
                opened[names[(int(chosen[k]) >> np.arange(len(names))) & 1 == 1]] = True
                taken = slot[at : at + size] | opened
                yield *placed(at), int(hashes[k].view(np.int64)), _slots(taken, raw[at : at + size], 0, size), opened.tolist()


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``item_id, item_at, hash, item_slots, item_opens, n_windows`` of the benchmark; null and blank items have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(20_000)
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(_rows(words, text, width))
                n = len({at for at, *_ in found})
                rows = [{"item_id": item, "item_at": at, "hash": h, "item_slots": slots, "item_opens": opens, "n_windows": n} for at, h, slots, opens in found]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [("item_id", pa.int64()), ("item_at", pa.int32()), ("hash", pa.int64()), ("item_slots", pa.list_(pa.string())), ("item_opens", pa.list_(pa.bool_())), ("n_windows", pa.int32())]
    )
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropDuplicates()
    return rows.mapInArrow(cut, "item_id long, item_at int, hash long, item_slots array<string>, item_opens array<boolean>, n_windows int")


class Wanted:
    """Tells which hashes are among those of the items: leading bits first, then the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.shift = np.uint64(64 - max(10, int(np.ceil(np.log2(max(1, len(hashes)) * BITS)))))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.hashes >> self.shift] = True

    def __reduce__(self):
        return type(self), (self.hashes,)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        mask = self.bits[hashes >> self.shift]
        some = np.flatnonzero(mask)
        if len(some):
            at = np.searchsorted(self.hashes, hashes[some])
            mask[some] = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[some]
        return mask


def window_filter(windows: DataFrame, most: int = MOST_SENT) -> Wanted | None:
    """What tells the items' hashes where documents are read; None if they are more than ``most``.

    Without it all windows of the documents take part in the join, with the same result.
    """
    hashes = windows.select("hash").distinct()
    if hashes.count() > most:
        return None
    return Wanted(hashes.toArrow().column("hash").to_numpy().view(np.uint64))


def document_windows(docs: DataFrame, width: int, wanted: Wanted | None) -> DataFrame:
    """Windows of documents that an item has: ``doc_id, _row, at, hash, slots, opens``. Nothing else of a text is passed on."""
    spark = docs.sparkSession
    held, shared = spark.sparkContext.broadcast(wanted), spark.sparkContext.broadcast(Words())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_of, rows_of, column = batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), batch.column("text")
            sizes, start = pc.binary_length(column.fill_null("")).to_pylist(), 0
            # Only a slice of the texts becomes words at a time.
            for run in slices(sizes, lambda n: n + 1, SLICE):
                texts = column.slice(start, len(run)).to_pylist()
                hits = ((start + k, *row) for k, *row in _rows_of(shared.value, texts, width, held.value))
                for some in slices(({"doc_id": docs_of[k], "_row": rows_of[k], "at": at, "hash": h, "slots": slots, "opens": opens} for k, at, h, slots, opens in hits), lambda _: 1, 10_000):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)
                start += len(run)

    schema = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("at", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("opens", pa.list_(pa.bool_()))])
    return docs.mapInArrow(cut, HITS)


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    contained: float = CONTAINED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, contained, n_changed`` of every document that holds an item.

    Words are compared without case and the punctuation around them. ``contained`` is the share
    of the item's ``width``-word windows found, at least the parameter of that name; ``n_changed`` counts
    slots whose values differ. A window counts unless, in its alignment, a
    value of one of its slots stands for several values of the document. A word that opens a sentence on both sides
    may be no name: it decides what a value stands for only where no other slot does. A text shorter than a window is one
    window, so a short item is found only in a document that is nothing else. Null and blank texts hold
    and are nothing. Rows that share an id are told apart while they are matched and reported once, with their
    best match. Documents without id are reported with null; other columns are ignored.
    """
    full = _held(docs, items, width, contained, id_col, text_col, item_col, item_text_col)
    best = full.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", (-F.col("n_changed")).alias("_less"), "n_windows")).alias("_best"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("_best.n_windows").cast("long").alias("n_windows"),
        F.col("_best.n_matched").alias("n_matched"),
        (F.col("_best.n_matched") / F.col("_best.n_windows")).alias("contained"),
        (-F.col("_best._less")).alias("n_changed"),
    )


def _held(docs: DataFrame, items: DataFrame, width: int, contained: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """``doc_id, _row, item_id, n_windows, n_matched, n_changed`` of every row that holds an item; ``_row`` is the hash of its text."""
    windows = stored(item_windows(items, item_col, item_text_col, width), "item-windows")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("text"))
    found = document_windows(rows, width, window_filter(windows))
    met = found.join(F.broadcast(windows) if is_small(windows) else windows, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    loose = F.zip_with("item_opens", "opens", lambda a, b: a & b).alias("loose")
    met = stored(met.select("doc_id", "_row", "item_id", "shift", "item_at", "n_windows", "item_slots", "slots", loose).distinct(), "met-windows", batch=1000)

    key = ["doc_id", "_row", "item_id", "shift"]
    filled = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"].isNotNull() & p["slots"].isNotNull())
    pairs = met.select(*key, "item_at", F.posexplode(F.arrays_zip("item_slots", "slots", "loose")).alias("_k", "_pair"))
    pairs = pairs.select(
        *key, (F.col("item_at") + F.col("_k")).alias("place"), F.col("_pair.item_slots").alias("value"), F.col("_pair.slots").alias("stands_for"), F.col("_pair.loose").alias("loose")
    ).filter("value IS NOT NULL AND stands_for IS NOT NULL")
    firm = F.when(~F.col("loose"), F.col("stands_for"))
    images = pairs.groupBy(*key, "value").agg(
        F.min(firm).alias("_a"), F.max(firm).alias("_b"), F.min("stands_for").alias("_c"), F.max("stands_for").alias("_d"), F.collect_set("stands_for").alias("_all")
    )
    images = images.filter("_c <> _d").withColumn("_one", F.expr("CASE WHEN _a = _b THEN _a END"))
    torn = images.select(*key, "value", F.explode("_all").alias("stands_for"), "_one").filter("_one IS NULL OR stands_for <> _one")
    changed = pairs.filter("value <> stands_for").groupBy("doc_id", "_row", "item_id").agg(F.count_distinct("place").alias("n_changed"))

    def same(columns: list[str]):
        on = F.lit(True)
        for c in columns:
            on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return on

    torn = torn.groupBy(*key).agg(F.collect_set(F.struct(F.col("value").alias("item_slots"), F.col("stands_for").alias("slots"))).alias("_torn"))
    sound = met.alias("a").join(torn.alias("b"), same(key), "left").filter(~F.coalesce(F.arrays_overlap(filled, "_torn"), F.lit(False)))
    counted = sound.select("a.doc_id", "a._row", "a.item_id", "item_at", "n_windows").distinct().groupBy("doc_id", "_row", "item_id").agg(F.count(F.lit(1)).alias("n_matched"), F.max("n_windows").alias("n_windows"))
    held = counted.filter(F.col("n_matched") >= contained * F.col("n_windows"))
    return held.alias("a").join(changed.alias("b"), same(["doc_id", "_row", "item_id"]), "left").select(
        "a.doc_id", "a._row", "a.item_id", "n_windows", "n_matched", F.coalesce("n_changed", F.lit(0)).alias("n_changed")
    )


def clean(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    contained: float = CONTAINED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold an item; other rows of the same id, or without one, stay."""
    bad = _held(docs, items, width, contained, id_col, text_col, item_col, item_text_col)
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("_row").alias("_bad_row")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col]) == bad["_bad_row"])
    return docs.join(bad, same, "left_anti")
