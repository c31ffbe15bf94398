"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a SentencePiece BPE model file (a path that every executor has; nothing is trained). A text is cut into chunks, a run
of blanks and what follows it; no piece reaches over a chunk's end. In a chunk the agenda holds the candidate merges of neighbouring
symbols by score, then from the left. A candidate that comes up is skipped, for good, if the keyed hash of (seed, variant, chunk, its
start, middle and end) falls below the dropout; else it is applied and its new neighbours become candidates. The variant is
taken from the hash of the whole text and the chunk's place in it, so that every occurrence of a word draws its own
segmentation; as the hash depends on nothing else, the result is the same on every executor and on every retry. Another
seed (an epoch) gives others. With dropout 0 the pieces are those of the library.

Chunks of up to WIDE symbols are merged together in numpy, one merge for each of them a step; longer ones go through a heap. Of a
chunk a worker remembers the pieces and merges without dropout: they are those of an occurrence unless its draw skips one of these
merges, and only then it is merged anew. A worker remembers at most REMEMBER chunks and works on blocks of about BLOCK characters, so memory is bounded whatever the text.

Characters that the vocabulary lacks become byte pieces, and so does a literal U+2581, which stands for the blank inside pieces; hence
decode(encode(text)) is text for every text. A null text has null pieces, an empty one none; repeated rows give equal results;
extra columns are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPOUT, SEED = 0.1, 17
WIDE, BLOCK, REMEMBER, ANEW = 48, 1 << 21, 300_000, 1 << 15
BLANK = "▁"
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    """The public vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a model file, and which neighbours merge into which piece."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        name = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in name.items()}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.rank = np.full(n, _NONE, np.int32)
        self.rank[sorted(plain, key=lambda i: (-sp.get_score(i), i))] = np.arange(len(plain), dtype=np.int32)
        self.by_rank = np.zeros(len(plain), np.int32)
        self.by_rank[self.rank[plain]] = plain
        self.raw = [b""] * n
        for i, p in name.items():
            self.raw[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        pairs = {}
        for p, i in self.ids.items():
            for c in range(1, len(p)):
                if (a := self.ids.get(p[:c])) is not None and (b := self.ids.get(p[c:])) is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        self.bits = max(10, (16 * len(pairs)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        self.probes = 1
        for (a, b), i in pairs.items():
            key = a << 32 | b
            at, tries = (key * _M1 & _MASK) >> 64 - self.bits, 1
            while self.slot_key[at] >= 0:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.slot_key[at], self.slot_rank[at], self.probes = key, self.rank[i], max(self.probes, tries)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair of ids makes; _NONE if none. Ids below 0 make none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        with np.errstate(over="ignore"):
            at = ((key.astype(np.uint64) * np.uint64(_M1)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.slot_key[at] == key, self.slot_rank[at], _NONE)
        for _ in range(1, self.probes):
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.slot_key[at] == key
            out[hit] = self.slot_rank[at[hit]]
        return out


def skipped(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    """The keyed hash's decision on one candidate."""
    h = key ^ (start * _M1 + middle * _M2 + end * _M3 & _MASK)
    h = (h ^ h >> 30) * _M2 & _MASK
    h = (h ^ h >> 27) * _M3 & _MASK
    return h >> 32 < limit


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    u = np.uint64
    with np.errstate(over="ignore"):
        h = key ^ (start.astype(u) * u(_M1) + middle.astype(u) * u(_M2) + end.astype(u) * u(_M3))
        h = (h ^ (h >> u(30))) * u(_M2)
        h = (h ^ (h >> u(27))) * u(_M3)
    return (h >> u(32)) < u(limit)


def agenda(symbols: list[int], key: int, limit: int, vocab: Vocabulary) -> list[tuple[int, int]]:
    """(start, id) of the pieces of one chunk; symbols: ids of its characters, below 0 if unknown."""
    n = len(symbols)
    ids, nxt, prv, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []

    def put(i: int) -> None:
        if i >= 0 and (j := nxt[i]) < n and (p := vocab.pairs.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (int(vocab.rank[p]), i, j, nxt[j], p))

    for i in range(n - 1):
        put(i)
    while heap:
        _, i, j, end, p = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j]) or nxt[i] != j or nxt[j] != end or vocab.pairs.get((ids[i], ids[j])) != p:
            continue
        if skipped(key, i, j, end, limit):
            continue
        ids[i], nxt[i], alive[j] = p, end, False
        if end < n:
            prv[end] = i
        put(prv[i])
        put(i)
    return [(i, ids[i]) for i in range(n) if alive[i]]


class _Index(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: str, dropout: float = DROPOUT, seed: int = SEED):
        self.vocab, self.seed = Vocabulary(model), seed
        self.limit = min(1 << 32, max(0, round(dropout * (1 << 32))))
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.vocab.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.blank = int(self.char[ord(BLANK)])
        self.char[ord(BLANK)] = -1
        self.forget()

    def forget(self) -> None:
        self.index, self.names = _Index(), []
        self.hashes, self.wide = np.zeros(0, np.uint64), np.zeros(0, bool)
        # pieces and merges of the chunks in a row, and where each chunk's begin
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.steps, self.first = np.zeros((0, 3), np.int16), np.zeros(1, np.int64)

    def _pieces(self, chunks: list[str], variant: int) -> list[np.ndarray]:
        """Piece ids of each chunk, drawn by a hash of the chunk and the variant."""
        seed = self.seed * 1_000_003 + variant
        keys = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), seed) for c in chunks), np.uint64, len(chunks))
        return self._cut(chunks, keys, self.limit)

    def _cut(self, chunks: list[str], keys: np.ndarray, limit: int, log: list | None = None) -> list[np.ndarray]:
        """Piece ids of each chunk by its key; a chunk starts with its blanks as ' '. log: takes the merges (row, start, middle, end)."""
        # a chunk: blanks, then no more blanks; a literal U+2581 is an unknown character
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char[codes]
        symbols[codes == 32] = self.blank
        starts = np.cumsum(lens) - lens
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(chunks)
        for wide in (8, 12, 18, 28, WIDE):
            low = {8: 0, 12: 8, 18: 12, 28: 18, WIDE: 28}[wide]
            rows = np.flatnonzero((lens > low) & (lens <= wide))
            if len(rows):
                self._merge(rows, symbols, codes, starts, lens, keys, wide, out, limit, log)
        for r in np.flatnonzero(lens > WIDE):
            s, n = int(starts[r]), int(lens[r])
            got = agenda(symbols[s : s + n].tolist(), int(keys[r]), limit, self.vocab)
            out[r] = self._fallback(np.array([i for _, i in got], np.int32), codes[s + np.array([a for a, _ in got])])
        return out

    def _fallback(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """ids with unknown characters as byte pieces."""
        if (ids >= 0).all():
            return ids
        flat: list[int] = []
        for i, c in zip(ids.tolist(), codes.tolist(), strict=True):
            flat += [i] if i >= 0 else [self.vocab.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]
        return np.array(flat, np.int32)

    def _merge(self, rows: np.ndarray, symbols: np.ndarray, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, keys: np.ndarray, wide: int, out: list[np.ndarray], limit: int, log: list | None) -> None:
        """The agenda of many chunks at once: each step applies or skips the best candidate of every chunk."""
        v, k = self.vocab, np.arange(len(rows))
        n, key = lens[rows], keys[rows]
        at = starts[rows][:, None] + np.arange(wide)
        inside = np.arange(wide) < n[:, None]
        sym = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1).astype(np.int32)
        nxt = np.tile(np.arange(1, wide + 1, dtype=np.int16), (len(rows), 1))
        prv = np.tile(np.arange(-1, wide - 1, dtype=np.int16), (len(rows), 1))
        alive = inside.copy()
        rank = np.full((len(rows), wide), _NONE, np.int32)
        rank[:, :-1] = v.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(rows), wide - 1)
        if limit:
            a, j = np.nonzero(rank < _NONE)
            rank[a, j] = np.where(_skipped(key[a], j, j + 1, j + 2, limit), _NONE, rank[a, j])
        live = k
        while len(live):
            j = rank[live].argmin(axis=1)
            best = rank[live, j]
            ok = best < _NONE
            live, j, best = live[ok], j[ok], best[ok]
            if not len(live):
                break
            mid = nxt[live, j].astype(np.int64)
            end = nxt[live, mid].astype(np.int64)
            if log is not None:
                log.append(np.stack([rows[live], j, mid, end], axis=1))
            sym[live, j] = v.by_rank[best]
            alive[live, mid] = False
            rank[live, mid] = _NONE
            nxt[live, j] = end
            has = end < n[live]
            prv[live[has], end[has]] = j[has]
            rank[live, j] = _NONE
            self._candidate(live[has], j[has], end[has], sym, nxt, rank, key, limit)
            left = prv[live, j].astype(np.int64)
            has = left >= 0
            self._candidate(live[has], left[has], j[has], sym, nxt, rank, key, limit)
        r, c = np.nonzero(alive)
        ids, cut = sym[r, c], np.searchsorted(r, k)
        where = starts[rows][r] + c
        strange = np.zeros(len(rows), bool)
        strange[r[ids < 0]] = True
        cut = np.append(cut, len(r))
        for x, row in enumerate(rows.tolist()):
            got = ids[cut[x] : cut[x + 1]]
            out[row] = self._fallback(got, codes[where[cut[x] : cut[x + 1]]]) if strange[x] else got

    def _candidate(self, live: np.ndarray, i: np.ndarray, j: np.ndarray, sym: np.ndarray, nxt: np.ndarray, rank: np.ndarray, key: np.ndarray, limit: int) -> None:
        r = self.vocab.merged(sym[live, i], sym[live, j])
        if limit and len(live):
            r = np.where(_skipped(key[live], i, j, nxt[live, j].astype(np.int64), limit), _NONE, r)
        rank[live, i] = r

    def _chunks(self, text: str) -> list[str]:
        """The chunks of the text after the blank that is put before every text."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return re.findall(" +[^ ]*|[^ ]+", " " + text)
        return [" " + w for w in text.split(" ")]

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list array of piece ids."""
        out: list[pa.Array] = []
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size >= BLOCK:
                out.append(self._block(part))
                part, size = [], 0
        if part or not out:
            out.append(self._block(part))
        return pa.concat_arrays(out)

    def _learn(self) -> None:
        """Pieces and merges without dropout of the chunks that the index has and the tables lack."""
        new = list(self.index)[len(self.names) :]
        if not new:
            return
        hashes = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), self.seed) for c in new), np.uint64, len(new))
        # with dropout, chunks that go through a heap are cut anew at every occurrence
        wide = np.fromiter((len(c) > WIDE for c in new), bool, len(new)) & (self.limit > 0)
        log: list[np.ndarray] = []
        got = self._cut(["" if w else c for c, w in zip(new, wide.tolist(), strict=True)], hashes, 0, log)
        steps = np.concatenate(log) if log else np.zeros((0, 4), np.int64)
        steps = steps[np.argsort(steps[:, 0], kind="stable")]
        grow = lambda start, n: np.concatenate([start, start[-1] + np.cumsum(n)])
        self.start = grow(self.start, np.fromiter(map(len, got), np.int64, len(got)))
        self.first = grow(self.first, np.bincount(steps[:, 0], minlength=len(new)))
        self.flat, self.steps = np.concatenate([self.flat, *got]), np.concatenate([self.steps, steps[:, 1:].astype(np.int16)])
        self.hashes, self.wide = np.concatenate([self.hashes, hashes]), np.concatenate([self.wide, wide])
        self.names += new

    def _drawn(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences (chunk, key) skip a merge that the chunk has without dropout."""
        n = self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        step = self.steps[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + n, n)].astype(np.int64)
        hit = np.flatnonzero(_skipped(np.repeat(keys, n), step[:, 0], step[:, 1], step[:, 2], self.limit))
        anew = self.wide[at]
        anew[np.searchsorted(ends, hit, "right")] = True
        return np.flatnonzero(anew)

    def _block(self, texts: list[str | None]) -> pa.Array:
        if len(self.index) > REMEMBER:
            self.forget()
        words, keys = [], []
        for t in texts:
            chunks = self._chunks(t) if t else []
            words.append(np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks)))
            own = xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), self.seed)
            with np.errstate(over="ignore"):
                keys.append((np.arange(len(chunks), dtype=np.uint64) + np.uint64(own)) * np.uint64(_M1))
        self._learn()
        at = np.concatenate(words) if words else np.zeros(0, np.int64)
        b, n, flat = self.start[at], self.start[at + 1] - self.start[at], [self.flat]
        if self.limit:
            key = self.hashes[at] ^ np.concatenate([np.zeros(0, np.uint64), *keys])
            base = len(self.flat)
            for lo in range(0, len(at), ANEW):
                rows = lo + self._drawn(at[lo : lo + ANEW], key[lo : lo + ANEW])
                got = self._cut([self.names[i] for i in at[rows].tolist()], key[rows], self.limit)
                n[rows] = np.fromiter(map(len, got), np.int64, len(got))
                b[rows] = base + np.cumsum(n[rows]) - n[rows]
                base += int(n[rows].sum())
                flat += got
        flat, ends = np.concatenate(flat), np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(b - ends + n, n)]
        offsets = np.append(0, ends)[np.cumsum([0] + [len(w) for w in words])].astype(np.int32)
        nulls = pa.array([t is None for t in texts], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=nulls) if texts else pa.array([], pa.list_(pa.int32()))

    def decode(self, ids) -> str:
        return b"".join(map(self.vocab.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_CODECS: dict[tuple, Codec] = {}


def codec(model: str, dropout: float = DROPOUT, seed: int = SEED) -> Codec:
    key = (model, dropout, seed)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, text_col: str = "text", out: str = "encoded") -> DataFrame:
    """docs with a struct column of `ids` (array<int>) and `lossless` (decoding gives the text again)."""
    if out in docs.columns:
        raise ValueError(f"docs has a column {out}; name another")
    args = (model or default_model(), dropout, seed)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(*args)
        for a in batches:
            texts = a.to_pylist()
            ids = c.encode(texts)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            same = [t is None or c.decode(flat[ends[i] : ends[i + 1]].tolist()) == t for i, t in enumerate(texts)]
            yield pa.StructArray.from_arrays([ids, pa.array(same, pa.bool_())], ["ids", "lossless"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(run, "struct<ids: array<int>, lossless: boolean>")(F.col(text_col)))


def decode(encoded: DataFrame, ids_col: str, model: str | None = None, out: str = "decoded") -> DataFrame:
    """encoded with a column of the texts that its ids stand for; null ids: null."""
    path = model or default_model()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for a in batches:
            yield pa.array([None if x is None else c.decode(x) for x in a.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return encoded.withColumn(out, F.arrow_udf(run, "string")(F.col(ids_col)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, the piece ids, their number, and whether they decode to the text."""
    got = encode(docs.select("doc_id", "text"))
    return got.select("doc_id", F.coalesce(F.size("encoded.ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("encoded.lossless").alias("lossless"), F.col("encoded.ids").alias("ids"))
