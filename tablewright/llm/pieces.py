"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into chunks at spaces; the chunks a worker has not met yet are encoded
together; a task forgets its chunks when it ends, so that an idle worker holds the model
only. Their symbols lie in one flat array, cut further wherever no piece of the
vocabulary holds the two characters side by side. A round looks up the rank of every
neighbouring pair, takes the smallest rank of each segment, merges all its leftmost
non-overlapping places at once and compacts the array; segments without a pair left
are done. Where a merge would make a new pair that ranks no later than the merged one,
the segment merges only its leftmost place in that round (a long segment is finished
pair by pair), so the order of merges is always the library's: best rank first,
leftmost first.

Supported are BPE models with byte fallback, the identity normaliser and a space put
before the text, which is checked against the library when a model is loaded.

A null or empty text has no ids and decodes to the empty text. The whole text is
encoded, whatever its length. Other columns are carried along unchanged; the new ones
take the place of columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.llm.common import give_back, per_worker, portions

MARK = "▁"  # stands for a space inside pieces
NEVER = np.int64(1 << 40)
CACHED_CHUNKS = 300_000
ROWS = 500  # of a batch worked on at once
LONG_SEGMENT = 64
PROBES = ("", " ", "  two  spaces ", "a\tb\nc", "é́ ﬁ \U0001f600͸", "Hello hello, world!!", MARK + "x")


class PieceModel:
    """Vocabulary of a SentencePiece model, its pair table, and a cache of encoded chunks."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(size)]
        special = [
            library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)
            for i in range(size)
        ]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if library.is_byte(i)}
        if len(byte_ids) != 256:
            raise PrepareError("only models with byte fallback are supported")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.raw = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(pieces, special)]
        for b, i in byte_ids.items():
            self.raw[i] = bytes([b])
        self.raw[library.unk_id()] = " ⁇ ".encode()
        self.led = np.array([not s and p.startswith(MARK) for p, s in zip(pieces, special)])

        # Symbols: piece ids, then a code point each for characters that are no piece.
        self.size = size
        normal = {p: i for i, (p, s) in enumerate(zip(pieces, special)) if not s}
        self.of_char = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        scores = sorted({library.get_score(i) for i in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        pairs = {}
        beside = set()
        for p, i in normal.items():
            beside.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                left, right = self._symbol(normal, p[:cut]), self._symbol(normal, p[cut:])
                if left is not None and right is not None:
                    pairs[left * self._span() + right] = (i, place[library.get_score(i)])
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k][0] for k in self.pairs.tolist()], np.int64)
        self.ranks = np.array([pairs[k][1] for k in self.pairs.tolist()], np.int64)
        self.beside = np.array(sorted(ord(a) << 21 | ord(b) for a, b in beside), np.int64)
        # Chunks end before a space or at a line break, which no piece goes across.
        inside = any(MARK in p.lstrip(MARK) or "\n" in p for p in normal)
        self.chunks = re.compile(r"(?s).+" if inside else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.cache: dict[str, bytes] = {}
        self.by_pair: dict[int, tuple[int, int]] = {}
        for probe in PROBES:
            ids = self.encode(probe)
            if ids.tolist() != library.encode(probe) or self.decode(ids) != library.decode(ids.tolist()):
                raise PrepareError("the model's normaliser or type is not supported", {"probe": probe})

    def _span(self) -> int:
        return self.size + 0x110000

    def _symbol(self, normal: dict, part: str):
        found = normal.get(part)
        return self.size + ord(part) if found is None and len(part) == 1 else found

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of neighbouring symbols; NEVER where no piece joins them."""
        keys = left * self._span() + right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        there = self.pairs[at] == keys if len(self.pairs) else np.zeros(len(keys), bool)
        return np.where(there, self.ranks[at], NEVER), np.where(there, self.merged[at], -1)

    def _merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run merge rounds until no segment has a pair left; ``segment`` ascends."""
        place = np.arange(len(symbols), dtype=np.int64)
        rank = np.full(len(symbols), NEVER)  # of the pair that starts at a symbol
        new = np.full(len(symbols), -1, np.int64)
        stale = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            last = np.r_[segment[1:] != segment[:-1], True]
            rank[stale], new[stale] = NEVER, -1
            stale = stale[~last[stale]]
            rank[stale], new[stale] = self._pairs(symbols[stale], symbols[stale + 1])
            ends = np.flatnonzero(last)
            starts = np.r_[0, ends[:-1] + 1]
            best = np.repeat(np.minimum.reduceat(rank, starts), ends - starts + 1)
            kept = best < NEVER
            if not kept.all():
                done.append((place[~kept], symbols[~kept]))
                place, symbols, segment = place[kept], symbols[kept], segment[kept]
                rank, new, best = rank[kept], new[kept], best[kept]
                if not len(symbols):
                    break
            # Of touching places, every second one from the left.
            where = np.flatnonzero(rank == best)
            fresh = np.r_[True, np.diff(where) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            kept = np.ones(len(symbols), bool)
            overtaken = self._overtaken(symbols, segment, new, best, where)
            if len(overtaken):
                own = segment[where]
                first = np.r_[True, own[1:] != own[:-1]]
                where = where[first | ~np.isin(own, overtaken)]
                low = np.searchsorted(segment, overtaken)
                high = np.searchsorted(segment, overtaken, "right")
                long = high - low > LONG_SEGMENT
                for a, b in zip(low[long].tolist(), high[long].tolist()):
                    kept[a:b] = False
                    at, left = self._merge_in_order(symbols[a:b].tolist())
                    done.append((place[a:b][at], left))
                where = where[kept[where]]
            symbols[where] = new[where]
            kept[where + 1] = False
            moved = (np.cumsum(kept) - 1)[where]
            place, symbols, segment = place[kept], symbols[kept], segment[kept]
            rank, new = rank[kept], new[kept]
            stale = np.r_[moved, moved[moved > 0] - 1]
        if not done:
            return place, symbols
        place, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return place[order], symbols[order]

    def _overtaken(self, symbols, segment, new, best, where) -> np.ndarray:
        """Segments in which a merge makes a pair that ranks no later than the merged one."""
        made = new[where]
        last = len(symbols) - 1
        left_at, right_at = where - 1, np.minimum(where + 2, last)
        has_left = (left_at >= 0) & (segment[left_at] == segment[where])
        has_right = (where + 2 <= last) & (segment[right_at] == segment[where])
        left = symbols[left_at].copy()
        touching = np.r_[False, np.diff(where) == 2]  # the left neighbour has just been merged
        left[touching] = made[np.flatnonzero(touching) - 1]
        overtakes = has_left & (self._pairs(left, made)[0] <= best[where])
        overtakes |= has_right & (self._pairs(made, symbols[right_at])[0] <= best[where])
        return np.unique(segment[where[overtakes]])

    def _merge_in_order(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """One long segment merged pair by pair, for runs in which new pairs overtake old ones."""
        span, known = self._span(), self._known()
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] < len(symbols):
                found = known.get(symbols[at] * span + symbols[after[at]])
                if found is not None:
                    heapq.heappush(queue, (found[0], at, symbols[at], symbols[after[at]]))

        for at in range(len(symbols)):
            offer(at)
        while queue:
            _, at, left, right = heapq.heappop(queue)
            behind = after[at]
            if symbols[at] != left or behind >= len(symbols) or symbols[behind] != right:
                continue
            symbols[at] = known[left * span + right][1]
            symbols[behind] = -1
            after[at] = after[behind]
            if after[at] < len(symbols):
                before[after[at]] = at
            offer(before[at])
            offer(at)
        left_over = np.array(symbols)
        at = np.flatnonzero(left_over >= 0)
        return at, left_over[at]

    def _known(self) -> dict[int, tuple[int, int]]:
        if not self.by_pair:
            self.by_pair = dict(
                zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist()))
            )
        return self.by_pair

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit integers."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        keys = points[:-1] << 21 | points[1:]
        at = np.searchsorted(self.beside, keys)
        at[at == len(self.beside)] = 0
        cut = (self.beside[at] != keys) | (owner[1:] != owner[:-1])
        place, symbols = self._merge(self.of_char[points], np.r_[0, np.cumsum(cut)])
        owner = owner[place]
        odd = np.flatnonzero(symbols >= self.size)  # characters that are no piece: their bytes
        if len(odd):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[odd] - self.size).tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = [len(b) for b in spelled]
            starts = np.cumsum(times) - times
            symbols, owner = np.repeat(symbols, times), np.repeat(owner, times)
            spans = np.repeat(starts[odd] - np.r_[0, np.cumsum(times[odd])[:-1]], times[odd])
            flat = np.frombuffer(b"".join(spelled), np.uint8)
            symbols[spans + np.arange(len(flat))] = self.byte_ids[flat]
        ends = np.searchsorted(owner, np.arange(len(chunks) + 1)) * 4
        raw = symbols.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for part in portions(texts):
            cut = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in part]
            chunks = list(chain.from_iterable(cut))
            ends = np.cumsum([len(c) for c in cut]).tolist()
            ids = list(map(self.cache.get, chunks))
            missing = [i for i, x in enumerate(ids) if x is None]
            if missing:
                new = list({chunks[i]: None for i in missing})
                found = dict(zip(new, self._encode_chunks(new)))
                for i in missing:
                    ids[i] = found[chunks[i]]
                if len(self.cache) + len(found) > CACHED_CHUNKS:
                    self.cache = {}
                self.cache.update(found)
            out += [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], "<i4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return text[1:] if len(ids) and self.led[ids[0]] else text

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _model(path: str) -> PieceModel:
    return per_worker(f"pieces:{path}", lambda: PieceModel(path))


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns)) | new
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    kinds = {f.name: f.dataType for f in df.schema.fields} | new
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows, which keeps a worker small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode(
    docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``ids``, an array of the text's piece ids. ``model`` is a path on every machine.

    With ``decoded`` a column of that name gets what the ids decode to, in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        try:
            for batch in _parts(batches):
                column = batch.column(batch.schema.get_field_index(text))
                raw = pieces.encode_batch([t or "" for t in column.to_pylist()])
                ends = np.r_[0, np.cumsum([len(r) // 4 for r in raw])].astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
                new = {ids: pa.ListArray.from_arrays(pa.array(ends), values)}
                if decoded is not None:
                    new[decoded] = pa.array([pieces.decode(np.frombuffer(r, "<i4")) for r in raw], pa.string())
                yield _with(batch, new)
        finally:
            pieces.cache = {}
            give_back()

    new = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded is not None else {})
    return docs.mapInArrow(run, _schema(docs, new))


def decode(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with ``text``, decoded from ``ids``; a null list decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(model)
        for batch in _parts(batches):
            lists = batch.column(batch.schema.get_field_index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            spans = zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())
            yield _with(batch, {text: pa.array([pieces.decode(flat[a:b]) for a, b in spans], pa.string())})

    return docs.mapInArrow(run, _schema(docs, {text: T.StringType()}))


def digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256."""
    listed = F.concat_ws(",", ref(ids).cast("array<string>"))
    return encoded.withColumns(
        {
            "n_tokens": F.size(ref(ids)).cast("long"),
            "ids_sha256": F.sha2(listed.cast("binary"), 256),
            "decoded_sha256": F.sha2(ref(decoded).cast("binary"), 256),
        }
    )
