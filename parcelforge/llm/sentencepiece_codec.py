"""SentencePiece encoding and decoding in batched numpy.

Words of equal length advance together: substring hashes probe the sorted hashes of the pieces, and each step is a
vectorised maximum over all words of that length.

* Unigram models: Viterbi.  At each position the best of all pieces that end there is kept with a backpointer.
* BPE models: a Viterbi path over piece scores is not what such a model defines (its scores are merge priorities),
  so for these the same probes find the best adjacent pair of each word at each step, and the pair is merged.
  :func:`encode` takes the way that the model's type asks for; ``algorithm`` forces one of them.

Ids equal those of the sentencepiece library with the same model.  A word is a run of the space mark followed by
other characters; no piece of such a model joins a character with a space mark behind it (checked when a model is
loaded; otherwise whole texts are words).  Words longer than ``LONG`` go one by one through a heap (BPE) or in
windows (Viterbi), which needs memory in proportion to their length.

Defined results: a null or empty text has no ids and decodes to an empty text; characters without a piece become
bytes where the model has byte pieces, and the unknown id otherwise; repeated rows are encoded one by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.llm.common import quoted

SPACE = "▁"
LONG = 256
#: Words that a worker remembers with their ids.
MAX_KNOWN = 300_000
#: Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4096, _BASE)], dtype=np.uint64)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """What encoding needs of a model file: pieces with scores and kinds, and the normaliser's switches."""

    def __init__(self, data: bytes) -> None:
        # Fixed values, from the public message definition: ModelProto, SentencePiece, TrainerSpec, NormalizerSpec.
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: 1} | dict(fields(value))
                pieces.append((piece[1].decode(), float(np.frombuffer(piece[2], "<f4")[0]), piece[3]))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.pieces = pieces
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1), "other")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next(k for k, p in enumerate(pieces) if p[2] == 2)
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))
        if normalizer.get(2) or self.squeeze or not self.escape or self.kind == "other" or any(p[2] == 4 for p in pieces):
            raise ValueError("models with normalisation rules or user-defined pieces are not supported")
        own = [(k, p, s) for k, (p, s, t) in enumerate(pieces) if t == 1]  # normal pieces
        self.by_word = not any(SPACE in p.lstrip(SPACE) for _, p, _ in own)
        self.bytes_ = np.zeros(256, np.int64)
        for k, (p, _, t) in enumerate(pieces):
            if t == 6:
                self.bytes_[int(p[3:5], 16)] = k
        # Pieces by the hash of their characters, sorted.
        h = np.array([_hash(p) for _, p, _ in own], np.uint64)
        order = np.argsort(h)
        if len(h) and (np.diff(h[order]) == 0).any():
            raise ValueError("two pieces of one hash")
        self.keys = h[order]
        self.ids = np.array([own[k][0] for k in order], np.int64)
        self.scores = np.array([own[k][2] for k in order], np.float32).astype(np.float64)
        self.lengths = np.array([len(own[k][1]) for k in order], np.int64)
        self.longest = int(self.lengths.max()) if len(h) else 1
        self.worst = float(self.scores.min()) if len(h) else 0.0
        self.exact = {p: (k, s) for k, p, s in own}
        self.text = [p for p, _, _ in pieces]
        self.types = [t for _, _, t in pieces]
        # What each id stands for in UTF-8.  A piece begins with a whole character, so bytes before it end there.
        self.raw = [bytes([int(p[3:5], 16)]) if t == 6 else " ⁇ ".encode() if t == 2 else p.encode() for p, _, t in pieces]

    def probe(self, h: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Places of the pieces of these hashes and lengths, -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[at] == h) & (self.lengths[at] == length), at, -1)


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, n).astype(np.uint64)


def _hash(word: str) -> np.uint64:
    codes = _codes([word], len(word))[0]
    mixed = (codes + np.uint64(1)) * (codes + np.uint64(0x632BE59BD9B4E019))
    return (mixed * _POWERS[len(word) - 1 :: -1][: len(word)]).sum(dtype=np.uint64) if len(word) else np.uint64(0)


class Sums:
    """Prefix hashes of words of equal length; a substring's hash is a difference of two."""

    def __init__(self, words: list[str]) -> None:
        n = len(words[0])
        codes = _codes(words, n)
        mixed = (codes + np.uint64(1)) * (codes + np.uint64(0x632BE59BD9B4E019))
        self.h = np.zeros((len(words), n + 1), np.uint64)
        for k in range(n):
            self.h[:, k + 1] = self.h[:, k] * _BASE + mixed[:, k]

    def of(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.h[rows, end] - self.h[rows, start] * _POWERS[end - start]


# ------------------------------------------------------------------ words of equal length


def viterbi(model: Model, words: list[str]) -> list[list[tuple[int, int]]]:
    """The best segmentation of each word: (start, end) pairs.  A single character without a piece costs ten below
    the lowest score; of equal sums the longest last piece wins.  Both as in the library."""
    n, many = len(words[0]), len(words)
    sums, rows = Sums(words), np.arange(many)
    best = np.full((many, n + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((many, n + 1), np.int32)
    for end in range(1, n + 1):
        reach = min(end, model.longest)
        starts = np.arange(end - reach, end)
        h = sums.h[:, end, None] - sums.h[:, starts] * _POWERS[end - starts]
        at = model.probe(h, end - starts)
        score = np.where(at >= 0, model.scores[at], np.where(starts == end - 1, model.worst - 10.0, -np.inf)) + best[:, starts]
        k = np.argmax(score, axis=1)  # of equal ones the first, that is, the longest piece
        best[:, end], back[:, end] = score[rows, k], starts[k]
    out = []
    for row in back.tolist():
        spans, end = [], n
        while end:
            spans.append((row[end], end))
            end = row[end]
        out.append(spans[::-1])
    return out


def merge(model: Model, words: list[str]) -> list[list[tuple[int, int]]]:
    """BPE: at each step the adjacent pair of the best score (of equal ones the first) of every word is merged."""
    return [[(s, e) for s, e in enumerate(row) if e] for row in merged(model, words)[1].tolist()]


def merged(model: Model, words: list[str]) -> tuple[Sums, np.ndarray]:
    """The words' hashes, and where the symbol that starts at each place ends; 0: none starts there."""
    n, many = len(words[0]), len(words)
    sums = Sums(words)
    if n == 1:
        return sums, np.ones((many, 1), np.int64)
    ends = np.tile(np.arange(1, n + 1), (many, 1))
    before = np.tile(np.arange(-1, n - 1), (many, 1))  # where the symbol before it starts
    value = np.full((many, n), -np.inf)  # of the pair that starts at a place
    h = sums.h[:, 2:] - sums.h[:, :-2] * _POWERS[2]
    at = model.probe(h, 2)
    value[:, : n - 1] = np.where(at >= 0, model.scores[at], -np.inf)
    live = np.arange(many)
    while len(live):
        k = np.argmax(value[live], axis=1)
        found = value[live, k] > -np.inf
        live, k = live[found], k[found]
        if not len(live):
            break
        middle = ends[live, k]
        end = ends[live, middle]
        ends[live, k], ends[live, middle] = end, 0
        value[live, middle] = -np.inf
        more = end < n
        before[live[more], end[more]] = k[more]
        for rows, start in ((live, k), (live[k > 0], before[live, k][k > 0])):
            mid = ends[rows, start]
            value[rows, start] = -np.inf
            inside = mid < n
            r, s, m = rows[inside], start[inside], mid[inside]
            e = ends[r, m]
            got = model.probe(sums.of(r, s, e), e - s)
            value[r, s] = np.where(got >= 0, model.scores[got], -np.inf)
    return sums, ends


# ------------------------------------------------------------------ long words


def merge_long(model: Model, word: str) -> list[tuple[int, int]]:
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int]] = []

    def offer(s: int) -> None:
        m = after[s]
        if m < n and (found := model.exact.get(word[s : end[m]])):
            heapq.heappush(heap, (-found[1], s, end[m]))

    for s in range(n - 1):
        offer(s)
    gone = [False] * (n + 1)
    while heap:
        _, s, e = heapq.heappop(heap)
        m = after[s]
        if gone[s] or m >= n or end[m] != e:
            continue
        gone[m] = True
        end[s], after[s] = e, after[m]
        if after[s] < n:
            before[after[s]] = s
        offer(s)
        if before[s] >= 0:
            offer(before[s])
    return [(s, end[s]) for s in range(n) if not gone[s]]


def viterbi_long(model: Model, word: str) -> list[tuple[int, int]]:
    n = len(word)
    best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - model.longest), e):
            found = model.exact.get(word[s:e])
            score = best[s] + (found[1] if found else model.worst - 10.0 if s == e - 1 else -np.inf)
            if score > best[e]:
                best[e], back[e] = score, s
    spans, e = [], n
    while e:
        spans.append((back[e], e))
        e = back[e]
    return spans[::-1]


# ------------------------------------------------------------------ texts


class Codec:
    def __init__(self, data: bytes, algorithm: str | None = None) -> None:
        self.model = Model(data)
        self.algorithm = algorithm or {"unigram": "viterbi", "bpe": "merge"}[self.model.kind]
        self.equal, self.long = (viterbi, viterbi_long) if self.algorithm == "viterbi" else (merge, merge_long)
        self.known: dict[str, bytes] = {}

    def _ids(self, word: str, spans: list[tuple[int, int]]) -> bytes:
        m, out, unknown = self.model, [], False
        for s, e in spans:
            found = m.exact.get(word[s:e])
            if found:
                out.append(found[0])
                unknown = False
            elif m.byte_fallback:
                out += m.bytes_[list(word[s:e].encode())].tolist()
            elif not unknown:  # the library joins unknown neighbours
                out.append(m.unk)
                unknown = True
        return np.array(out, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known, equal lengths together."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for n, some in by.items():
            if n > LONG:
                self.known.update((w, self._ids(w, self.long(self.model, w))) for w in some)
                continue
            step = max(1, (1 << 21) // (n * (n if self.algorithm == "merge" else self.model.longest)))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                if self.algorithm == "merge":
                    self._remember(part)
                else:
                    self.known.update((w, self._ids(w, spans)) for w, spans in zip(part, self.equal(self.model, part)))

    def _remember(self, words: list[str]) -> None:
        """The ids of merged words of equal length, found together; words with a character that is no piece one by one."""
        m = self.model
        sums, ends = merged(m, words)
        rows, start = np.nonzero(ends)
        end = ends[rows, start]
        at = m.probe(sums.of(rows, start, end), end - start)
        data, cuts = m.ids[at].astype("<u4").tobytes(), (4 * np.searchsorted(rows, np.arange(len(words) + 1))).tolist()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))
        for k in np.unique(rows[at < 0]).tolist():
            self.known[words[k]] = self._ids(words[k], [(s, e) for s, e in enumerate(ends[k].tolist()) if e])

    def normal(self, text: str) -> str:
        marked = text.replace(" ", SPACE)
        return SPACE + marked if self.model.prefix and text else marked

    def words(self, text: str) -> list[str]:
        """A run of space marks with what follows it, each."""
        if not text:
            return []
        if not self.model.by_word:
            return [self.normal(text)]
        first, *rest = self.normal(text).split(SPACE)
        if all(rest):
            return [first] * bool(first) + [SPACE + x for x in rest]
        out, marks = [first] if first else [], 0
        for x in rest:
            marks += 1
            if x:
                out.append(SPACE * marks + x)
                marks = 0
        return out + [SPACE * marks] if marks else out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        every: dict[str, None] = {}
        for ws in split:
            every.update(dict.fromkeys(ws))
        if len(self.known) > MAX_KNOWN:
            # Words that are met again are likely to be met later on.
            self.known = {w: self.known[w] for w in every.keys() & self.known.keys()}
        known = self.known
        self.learn([w for w in every if w not in known])
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<u4") for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bytes put together, the mark turned into a space, the leading one dropped."""
        m = self.model
        text = b"".join(map(m.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if m.prefix and text.startswith(" ") else text


def with_ids(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", algorithm: str | None = None, ids: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip) of every row; round_trip: decoding gives the text again.

    also: columns of ``docs`` that are returned as well; one that has the name of a result gets underscores before it.
    A null text is empty, a document without id has ids as well, and repeated rows are encoded one by one.
    """
    own = ["doc_id", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if ids else [])]
    shown: list[str] = []
    for name in also:
        while name.lower() in {n.lower() for n in (*own, *shown)}:
            name = "_" + name
        shown.append(name)
    narrow = docs.select(quoted(key).cast("bigint").alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"), *(quoted(c).alias(f"more{j}") for j, c in enumerate(also)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the model file: as large as its vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value, algorithm)
        for batch in batches:
            docs_, texts, size, low = batch.column(0), batch.column(1), 0, 0
            for k in range(len(batch)):
                size += len(texts[k].as_buffer() or b"")
                if size >= GROUP_BYTES or k == len(batch) - 1:
                    some = texts.slice(low, k + 1 - low).to_pylist()
                    coded = codec.encode(some)
                    same = [codec.decode(x) == t for x, t in zip(coded, some)]
                    columns = [docs_.slice(low, k + 1 - low), pa.array([len(x) for x in coded], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in coded], pa.int64()), pa.array(same, pa.bool_())]
                    names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
                    if ids:
                        ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded).astype(np.int32))))
                        names.append("ids")
                    columns += [batch.column(2 + j).slice(low, k + 1 - low) for j in range(len(also))]
                    names += shown
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    size, low = 0, k + 1

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    fields += [T.StructField(n, f.dataType) for n, f in zip(shown, narrow.schema.fields[2:])]
    return narrow.mapInArrow(run, T.StructType(fields))


def decoded(coded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of rows with ``ids``."""
    shipped = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def _model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def query(spark, sf_dir: str) -> DataFrame:
    return with_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), _model())


def stage(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, round_trip and the columns ``also`` of the pipeline's documents."""
    return with_ids(docs, _model(), also=also)
