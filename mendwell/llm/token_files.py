"""Flat token-id files with 64-bit document offsets, and the encoder that fills them.

A part of the corpus is two files: ``*.bin`` holds the ids of its documents one after
another as little-endian unsigned integers, ``*.idx`` the document ids followed by the
offsets of the documents within the part and the part's length, all as little-endian
64-bit integers. A manifest names the parts in order. It gives each the number of ids
before it, a prefix sum over the parts, so that a document's place in the whole corpus
is its part's base plus its offset.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendwell.llm.common import as_uri, slices, stored
from mendwell.session import work_dir

# Id after the last one of each document.
END_ID = 0
# The last letter of Latin scripts that a word may have to take the short way.
LATIN = "\u024f"
# Characters of text encoded, or ids read, at a time.
SLICE = 1_000_000
MANIFEST = "part int, path string, width int, n_docs long, n_null long, n_tokens long, first_id long, last_id long"
# How a byte-level vocabulary spells the bytes 0 to 255: fixed values. Printable bytes stand for themselves, the others
# for the code points from 256 on, in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELT = {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}
# Latin letters beyond ASCII as the vocabulary spells them, and what may stand at a word's end as one piece: no letters, digits or apostrophes.
LATIN_SPELT = {c: "".join(SPELT.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x80, ord(LATIN) + 1)}
MARKS = ".,;:!?#*$%&<>()[]{}=+/|~^@\"-_"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

    The vocabulary's pattern always starts a new piece at a space that follows a
    character other than white space, so a text may be cut there and equal cuts share
    their ids. Up to ``max_known`` cuts are remembered in a worker, the others are
    encoded each time. An encoder reaches the workers as a broadcast variable: it
    carries the vocabulary's path only, and what it learns stays in the worker.
    The ids of a word come from the vocabulary's merges, all other cuts take its whole way.
    """

    def __init__(self, path: str, max_known: int = 300_000):
        self.path, self.max_known = path, max_known
        self.tokenizer = None
        self.known, self.heads, self.ends = {}, {}, {}

    def __reduce__(self):
        return type(self), (self.path, self.max_known)

    def _open(self):
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.model = self.tokenizer.model
        return self.tokenizer

    @property
    def width(self) -> int:
        """Bytes an id takes: two where the vocabulary allows, else four."""
        return 2 if self._open().get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def _whole(self, text: str) -> bytes:
        return array("I", self._open().encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, cut: str, space: str = " ") -> bytes:
        """The ids of a cut behind a space, or at the start of a line. A Latin word is one piece, and so are the marks at its end."""
        word = cut.rstrip(MARKS)
        ascii_word = word.isascii()
        if not word.isalpha() or (not ascii_word and max(word) > LATIN):
            return self._whole(space + cut)
        # A word that was met without the marks is known.
        found = self.known.get(word) if space and len(word) < len(cut) else None
        if found is None:
            spelt = word if ascii_word else word.translate(LATIN_SPELT)
            found = array("I", [piece.id for piece in self.model.tokenize(SPELT[32] + spelt if space else spelt)]).tobytes()
        if len(word) < len(cut):
            end = cut[len(word) :]
            if end not in self.ends:
                if len(self.ends) >= self.max_known // 4:
                    return found + self._whole(end)
                self.ends[end] = self._whole(end)
            found += self.ends[end]
        return found

    def _head(self, cut: str) -> bytes:
        found = self.heads.get(cut)
        if found is None:
            found = self._cut(cut, "") if cut else b""
            if len(self.heads) < self.max_known // 4:
                self.heads[cut] = found
        return found

    def _line(self, text: str) -> bytes:
        cuts = text.split(" ")
        found = list(map(self.known.get, cuts))
        found[0] = self._head(cuts[0])
        if None in found or cuts[0][-1:].isspace():
            missing = [k for k, ids in enumerate(found) if ids is None]
            if any(not cuts[k] or cuts[k][-1].isspace() for k in missing) or cuts[0][-1:].isspace():
                # A space after white space doesn't always start a piece. Cuts that end so are never remembered.
                cuts = re.split(r"(?<=\S) ", text)
                found = list(map(self.known.get, cuts))
                found[0] = self._whole(cuts[0])
                missing = [k for k, ids in enumerate(found) if ids is None]
            for k in missing:
                cut = cuts[k]
                if not cut or cut[-1].isspace():
                    found[k] = self._whole(" " + cut)
                    continue
                found[k] = self.known.get(cut) or self._cut(cut)
                if len(self.known) < self.max_known:
                    self.known[cut] = found[k]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without an end id."""
        if not text:
            return b""
        if self.tokenizer is None:
            self._open()
            self.newline = self._whole("\n")
        lines = text.split("\n")
        # A newline between characters other than white space is a piece of its own.
        if len(lines) == 1 or not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
            return self._line(text)
        return self.newline.join(map(self._line, lines))


def shared_encoder(spark, path: str):
    """An encoder that each worker opens once."""
    return spark.sparkContext.broadcast(Encoder(path))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` in ascending id order into files in ``folder``; the manifest of the parts with their bases.

    Null texts are empty documents: they take their end id only. Null ids come first.
    Rows that share an id are all kept, ordered by their texts. An empty table gives no
    parts. Other columns are ignored. Documents are dealt by id, hash of the text and row, so that
    many rows of one id spread over parts. A task holds about a million characters of
    text and 16 bytes for each document of its part. Each attempt of a task writes files
    of its own; the manifest names those of the attempt that counted.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    encoder = shared_encoder(spark, tokenizer)
    folder = as_uri(folder or work_dir(spark, "token-files"))
    width = encoder.value.width
    order = ["doc_id", "_hash", "_row"]
    dealt = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        part = task.partitionId()
        ids, ends, n_tokens, sink = [], [], 0, None
        system, root = fs.FileSystem.from_uri(folder)
        name = f"part-{part:05d}-{task.taskAttemptId()}"
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            if sink is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(f"{root}/{name}.bin")
            # Only a slice of the texts becomes Python strings at a time.
            lengths = batch.column("text").fill_null("")
            sizes = pc.binary_length(lengths).to_pylist()
            at = 0
            for run in slices(sizes, lambda n: n + 1, SLICE):
                for text in batch.column("text").slice(at, len(run)).to_pylist():
                    coded = encoder.value.encode(text) + end
                    sink.write(coded if width == 4 else np.frombuffer(coded, "<u4").astype("<u2").tobytes())
                    n_tokens += len(coded) // 4
                    ends.append(n_tokens)
                at += len(run)
            ids += batch.column("doc_id").to_pylist()
        if sink is None:
            return
        sink.close()
        known = [i for i in ids if i is not None]
        index = np.asarray([0] * (len(ids) - len(known)) + known + [0] + ends, "<i8")
        with system.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(index.tobytes())
        row = {"part": part, "path": f"{folder}/{name}", "width": width, "n_docs": len(ids), "n_null": len(ids) - len(known)}
        row |= {"n_tokens": n_tokens, "first_id": min(known, default=None), "last_id": max(known, default=None)}
        yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int32() if c == "width" else pa.int64()) for c in ("width", "n_docs", "n_null", "n_tokens", "first_id", "last_id"))])
    parts = stored(dealt.mapInArrow(write, MANIFEST), "manifest", batch=1000)
    # One row for each part: the sum runs over parts, not documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_ids(system, path: str):
    """A token file, memory-mapped where the store allows it."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers. A task maps the files of
    a part and reads about a million ids at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for row in (row for batch in batches for row in batch.to_pylist()):
            system, path = fs.FileSystem.from_uri(row["path"])
            with system.open_input_file(f"{path}.idx") as file:
                index = np.frombuffer(file.read(), "<i8")
            ids, offsets = index[: row["n_docs"]], index[row["n_docs"] :]
            with open_ids(system, f"{path}.bin") as file:
                for run in slices(range(row["n_docs"]), lambda k: int(offsets[k + 1] - offsets[k]), SLICE):
                    low = int(offsets[run[0]])
                    count = int(offsets[run[-1] + 1]) - low
                    held = np.frombuffer(file.read_at(count * row["width"], low * row["width"]), f"<u{row['width']}")
                    held = memoryview(held.astype("<u4", copy=False)).cast("B")
                    sums = [zlib.crc32(held[4 * (int(offsets[k]) - low) : 4 * (int(offsets[k + 1]) - low)]) for k in run]
                    span = slice(run[0], run[-1] + 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[span], mask=np.asarray(run) < row["n_null"]),
                            pa.array(offsets[:-1][span] + row["base"]),
                            pa.array(np.diff(offsets[run[0] : run[-1] + 2])),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # Rows are few and small, so that only a fixed number of partitions keeps them apart.
    n_parts = max(1, manifest.count())
    return manifest.repartition(n_parts, "part").mapInArrow(read, READ)
