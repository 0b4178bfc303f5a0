"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Text is marked as the model asks (a dummy space in front; a space stands for the model's U+2581) and cut into words
between neighbouring bytes that no piece has side by side, such as before a run of spaces or a stop. The distinct words
of a batch are sorted, which is the depth-first order of their trie; the forward states of the characters that a word
shares with the one before it are kept, and only the rest is worked out. A character's candidates are the pieces that
end there, as the states of an Aho-Corasick automaton list them.

* Unigram models: the state of a prefix is its best sum of piece scores and the last piece of that best way.
* BPE models: adding up scores does not give the ids that merging gives. But merging a text leaves every
  prefix made of its pieces as it would be alone, and a sequence of pieces is the merged form exactly
  if each adjacent pair survives merging on its own. So a step is allowed (score 0) if the pair survives, and
  forbidden otherwise; each prefix has one allowed way. Pairs are merged once and remembered.

Characters outside the vocabulary become byte pieces if the model has them, else the unknown piece. Pieces for
control, unknown and bytes never match text. The model file is read on the driver and its contents travel with the
tasks, so executors need no file. Nothing is trained.

Defined cases. Null text has null ids; empty text has none. A literal U+2581 decodes to a space. Ids may be null,
repeat, and be of any type. Very long words are one path of the trie. Other columns are not read, or with `add_ids` come back
untouched beside the ids.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.chunks import gather, ragged

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Distinct words remembered by a worker, at most, beside those of one batch.
MEMO_WORDS = 400_000
#: Pairs of pieces remembered by a worker, at most, beside those of one batch.
MEMO_PAIRS = 200_000
#: Bytes of text that are encoded together.
BATCH_CHARS = 4 << 20


class Model:
    """The pieces of a SentencePiece model file, and its Viterbi states."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or norm.name != "identity" or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation and kept white space are supported")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.dummy = norm.add_dummy_prefix
        self.ids = {p.piece.replace(MARK, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL and " " not in p.piece}
        self.score = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = [self.unknown] * 256 if not proto.trainer_spec.byte_fallback else [next(i for i, p in enumerate(proto.pieces) if p.type == BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.low = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        surface = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"" for p in proto.pieces]
        self.lens = np.array([len(s) for s in surface], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.size = len(proto.pieces)  # from here on, numbers stand for characters outside the vocabulary
        self.text = {i: p for p, i in self.ids.items()}
        # Whether a pair survives merging, by left * size + right: of late, and before that.
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        # Pieces that merging can make of their own characters.
        self.units = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]} if self.kind == BPE else set(self.ids)
        self.next, self.fail, self.ends = self._automaton()
        self.cuts = self._cuts()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self) -> np.ndarray:
        """By 256 * byte + next byte: whether texts are cut there, as no piece has the two side by side."""
        cut = np.ones((256, 256), bool)
        cut[:, 0x80:0xC0] = False  # inside of a character
        for a, b in {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}:
            cut[a.encode()[-1], b.encode()[0]] = False
        if self.bytes[0] == self.unknown:  # neighbouring unknown characters are one piece
            maybe = np.array([chr(b) not in self.ids if b < 0x80 else True for b in range(256)])
            cut &= ~(maybe[:, None] & maybe)
        return cut.ravel()

    def _automaton(self) -> tuple[list[dict[str, int]], list[int], list[tuple]]:
        """Of each state, a start of a unit: the next states, the state of its longest proper suffix, and (id, length) of the units that end it, longest first."""
        steps, ends = [{}], [()]
        for piece in self.units:
            at = 0
            for c in piece:
                if c not in steps[at]:
                    steps[at][c] = len(steps)
                    steps.append({})
                    ends.append(())
                at = steps[at][c]
            ends[at] = ((self.ids[piece], len(piece)),)
        fail, order = [0] * len(steps), list(steps[0].values())
        for at in order:  # it grows
            ends[at] += ends[fail[at]]
            for c, child in steps[at].items():
                up = fail[at]
                while up and c not in steps[up]:
                    up = fail[up]
                fail[child] = steps[up].get(c, 0)
                order.append(child)
        return steps, fail, ends

    # -- merging, for pairs only --------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: best score first, then leftmost."""
        parts = list(text)
        while True:
            found = [(-self.score[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def survives(self, left: int, right: int) -> bool:
        key = left * self.size + right
        if (known := self.older_pairs.get(key)) is None:
            one, two = self.text[left] if left < self.size else chr(left - self.size), self.text[right]
            known = self.merged(one + two) == [one, two]
        self.pairs[key] = known
        return known

    # -- the shared-prefix Viterbi ----------------------------------------------------------------------

    def encode_words(self, distinct: list[str]) -> dict[str, bytes]:
        out, before = {}, ""
        run = self._merge_run if self.kind == BPE else self._score_run
        states, last, best = [0], [0], [0.0]  # of each prefix of the current path: its state, its last piece, its score
        for word in sorted(distinct):
            shared = 0
            if word.startswith(before):
                shared = len(before)
            else:
                while word[shared] == before[shared]:  # sorted, so they differ before either ends
                    shared += 1
            del states[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            run(word[shared:], shared, states, last, best)
            out[word] = self._ids(len(word), last)
            before = word
        return out

    def _merge_run(self, rest: str, end: int, states: list[int], last: list[int], best: list[float]) -> None:
        steps, fail, ends, known, size, at = self.next, self.fail, self.ends, self.pairs.get, self.size, states[-1]
        for c in rest:
            while (to := steps[at].get(c)) is None and at:
                at = fail[at]
            at = to or 0
            end += 1
            for i, n in ends[at]:
                if n == end:
                    break
                ok = known(last[end - n] * size + i)
                if ok or (ok is None and self.survives(last[end - n], i)):
                    break
            else:
                i = self.ids.get(c, size + ord(c))
            states.append(at)
            last.append(i)

    def _score_run(self, rest: str, end: int, states: list[int], last: list[int], best: list[float]) -> None:
        at = states[-1]
        for c in rest:
            while (to := self.next[at].get(c)) is None and at:
                at = self.fail[at]
            at = to or 0
            end += 1
            top, piece = best[-1] + self.low, self.ids.get(c, self.size + ord(c))
            for i, n in self.ends[at]:
                if (score := best[end - n] + self.score[i]) > top:
                    top, piece = score, i
            states.append(at)
            last.append(piece)
            best.append(top)

    def _ids(self, end: int, last: list[int]) -> bytes:
        back, size, text = [], self.size, self.text
        while end:
            i = last[end]
            if i < size:
                back.append(i)
                end -= len(text[i])
                continue
            if self.bytes[0] != self.unknown:
                back.extend(self.bytes[b] for b in reversed((MARK if i == size + ord(" ") else chr(i - size)).encode()))
            elif not back or back[-1] != self.unknown:  # neighbouring unknown characters are one piece
                back.append(self.unknown)
            end -= 1
        back.reverse()
        return array("i", back).tobytes()

    # -- texts ---------------------------------------------------------------------------------------------

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of texts without nulls, end to end, and how many come before each text and after the last."""
        marked = pc.replace_substring(texts.cast(pa.large_binary()), MARK.encode(), b" ")
        if self.dummy:
            none, space = pa.scalar(b"", marked.type), pa.scalar(b" ", marked.type)
            marked = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(marked), 0), none, space), marked, none)
        _, offsets, data = marked.buffers()
        offsets = np.frombuffer(offsets, np.int64)[marked.offset : marked.offset + len(marked) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[: offsets[-1]]
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = self.cuts[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        begins[offsets] = True
        begins[: offsets[0]] = False
        starts = np.flatnonzero(begins)
        words = pa.Array.from_buffers(pa.large_utf8(), len(starts) - 1, [None, pa.py_buffer(starts), data])
        return words.dictionary_encode(), np.searchsorted(starts, offsets)

    def recalled(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct words. If the memory is full, only words that were not met since it was half full are forgotten."""
        fresh = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO_WORDS // 2:
            self.memo, self.older, fresh = {}, self.memo, distinct
        if len(self.pairs) > MEMO_PAIRS // 2:
            self.pairs, self.older_pairs = {}, self.pairs
        older = self.older.get
        self.memo |= {w: ids for w in fresh if (ids := older(w)) is not None}
        self.memo |= self.encode_words([w for w in fresh if w not in self.memo])
        return [self.memo[w] for w in distinct]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as little-endian int32, end to end, and where each text's begin and the last one's end."""
        words, before = self.words(pc.fill_null(texts, ""))
        blobs = self.recalled(words.dictionary.to_pylist())
        which = words.indices.to_numpy()
        lens = np.array([len(b) // 4 for b in blobs], np.int64)
        ends = np.cumsum(lens)
        each = lens[which]
        ids = gather(np.frombuffer(b"".join(blobs), "<i4"), (ends - lens)[which], each)
        return ids, np.concatenate([[0], np.cumsum(each)])[before]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as little-endian int32."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, at, at[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of a text."""
        which = np.frombuffer(ids, "<i4")
        out = self.surface[ragged(self.starts[which], self.lens[which])].tobytes()
        return out[1:] if self.dummy and out[:1] == b" " else out


_MODELS: dict[str, Model] = {}


def model_of(blob: bytes) -> Model:
    """One model per worker and file."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(blob)
    return _MODELS[key]


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of at most BATCH_CHARS bytes, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_CHARS, "right")))
        yield at, column.slice(at, end - at)
        at = end


def _list_array(texts: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    offsets = pa.array(at, pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids))


def _encoder(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob)
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                ids, at = model.encode_column(texts)
                same, sha = [], []
                for text, a, b in zip(texts.cast(pa.binary()).to_pylist(), at, at[1:], strict=False):
                    back = None if text is None else model.decode(ids[a:b])
                    same.append(None if back is None else back == text)
                    sha.append(None if back is None else hashlib.sha256(back).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), _list_array(texts, ids, at), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["id", "ids", "decoded_sha256", "round_trip"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids, and the decoded text's digest and whether it is the text."""
    with open(model_path, "rb") as file:
        blob = file.read()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encoder(blob), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded_sha256 string, round_trip boolean")
    return out.select(F.col("id").alias(id_col), F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids", "decoded_sha256", "round_trip")


def _appender(blob: bytes, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob)
        for batch in batches:
            for start, texts in _slices(batch.column(at)):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, _list_array(texts, *model.encode_column(texts))], names=[*batch.schema.names, "ids"])

    return run


def add_ids(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The documents with a column of ids at the end."""
    with open(model_path, "rb") as file:
        blob = file.read()
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)) + ", ids array<int>"
    return named.mapInArrow(_appender(blob, docs.columns.index(text_col)), schema).toDF(*docs.columns, ids_col)


def _decoder(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob)
        for batch in batches:
            texts = [None if x is None else model.decode(np.array(x, "<i4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts (id, text) of ids; bytes that are no UTF-8 become U+FFFD."""
    with open(model_path, "rb") as file:
        blob = file.read()
    named = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = named.mapInArrow(_decoder(blob), f"id {named.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_col)
