"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is cut at its spaces into marked words ("▁" before each). The encoding of
a word is the sequence of vocabulary pieces with the largest sum of scores;
characters outside the vocabulary cost their UTF-8 bytes. The best score of a
prefix depends on the prefix alone. So the distinct words of a block are sorted,
which is the depth-first order of their trie, and each word takes over the
scores up to the branch where it leaves the word before. Words that the worker still
knows from an earlier block are not walked again. The ids of texts are then gathered by word
number. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.base import Known, gathered, spans, worker_cache

MARK = "▁"
#: Bytes of text whose distinct words are encoded together; a longer text is a block alone.
BATCH_BYTES = 8 << 20
#: Words or ids that are put together at a time.
GATHERED = 1 << 18
#: A byte costs this much more than the worst piece.
BYTE_COST = 10.0


class Vocabulary:
    """Pieces and scores of a model file; control symbols are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids, pieces = {}, {}
        for i in range(size):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = (model.get_score(i), i)
        if len(byte_ids) < 256:
            raise ValueError(f"{path} has no byte pieces")
        floor = min((s for s, _ in pieces.values() if s > -1e8), default=0.0)
        self.setup(pieces, byte_ids, floor - BYTE_COST)

    def setup(self, pieces: dict[str, tuple[float, int]], byte_ids: dict[int, int], byte_score: float) -> "Vocabulary":
        self.pieces, self.bytes, self.byte_score = pieces, byte_ids, byte_score
        # longest piece by its last character, so that few slices are looked up
        self.longest: dict[str, int] = {}
        for piece in pieces:
            self.longest[piece[-1]] = max(self.longest.get(piece[-1], 0), len(piece))
        self.text = {i: p.replace(MARK, " ").encode() for p, (_, i) in pieces.items()}
        self.text.update({i: bytes([b]) for b, i in byte_ids.items()})
        return self

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))


class Viterbi:
    """Forward scores of the current trie path; `walk` moves to the next word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.word, self.best, self.back, self.steps = "", [0.0], [0], 0

    def walk(self, word: str) -> list[int]:
        """Ids of `word`. Of equal scores the longest last piece wins."""
        v, best, back = self.vocabulary, self.best, self.back
        shared, last = 0, self.word
        most = min(len(word), len(last))
        if word[:most] == last[:most]:
            shared = most
        else:
            low, high = 0, most
            while low < high:
                mid = (low + high + 1) // 2
                if word[:mid] == last[:mid]:
                    low = mid
                else:
                    high = mid - 1
            shared = low
        del best[shared + 1 :], back[shared + 1 :]
        pieces, longest = v.pieces, v.longest
        inner = MARK in word[1:]
        for end in range(shared + 1, len(word) + 1):
            char = word[end - 1]
            most = min(end, longest.get(char, 0))
            if inner:
                # a mark inside a word is no space: it is spelled, and no piece reaches over it
                most = min(most, end - 1 - max(word.rfind(MARK, 1, end), -1))
            top, size = None, 0
            for n in range(most, 0, -1):
                found = pieces.get(word[end - n : end])
                if found is not None and (top is None or best[end - n] + found[0] > top):
                    top, size = best[end - n] + found[0], n
            if top is None:
                top = best[end - 1] + v.byte_score * len(char.encode("utf-8", "surrogatepass"))
            best.append(top)
            back.append(size)
        self.steps += len(word) - shared
        self.word = word
        ids: list[int] = []
        end = len(word)
        while end:
            size = back[end]
            if size:
                ids.append(pieces[word[end - size : end]][1])
            else:
                ids.extend(reversed(v.spelled(word[end - 1])))
            end -= size or 1
        return ids[::-1]


def encode_words(vocabulary: Vocabulary, words) -> dict[str, list[int]]:
    """Ids of all distinct `words` (with their mark), depth first through their trie."""
    viterbi = Viterbi(vocabulary)
    return {w: viterbi.walk(w) for w in sorted(set(words))}


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text of `ids`: pieces joined, marks as spaces, the first space dropped."""
    joined = b"".join(map(vocabulary.text.__getitem__, ids))
    return joined[1:].decode("utf-8", "surrogatepass") if joined[:1] == b" " else joined.decode("utf-8", "surrogatepass")


class _Coder:
    """Encodes and decodes batches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, Known("<i4")
        # the bytes of all pieces in a row, by id
        spelled = [vocabulary.text.get(i, b"") for i in range(max(vocabulary.text) + 1)]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of blocks of texts (an Arrow array without nulls) in a row, and how many each text has."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, starts, sizes = self.known.ids(coded.dictionary, self._words, len(coded.dictionary) or 1)
        cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        empty = pc.binary_length(texts).to_numpy() == 0
        for low, high in spans(cuts, GATHERED):
            chosen = codes[cuts[low] : cuts[high]]
            own = sizes[chosen]
            each = np.add.reduceat(own, cuts[low:high] - cuts[low])
            # an empty text has one empty word, but no ids
            own[(cuts[low:high] - cuts[low])[empty[low:high]]] = 0
            each[empty[low:high]] = 0
            yield gathered(flat, starts[chosen], own), each

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [MARK + w for w in words]
        found = encode_words(self.vocabulary, marked)
        sizes = np.fromiter((len(found[w]) for w in marked), np.int64, len(marked))
        return np.fromiter(chain.from_iterable(map(found.__getitem__, marked)), np.int32, int(sizes.sum())), sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts in a row, and how many each has; a leading space is the mark of the first word."""
        sizes = self.sizes[ids]
        out = gathered(self.bytes, self.starts[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.diff(ends)
        marked = np.flatnonzero(lengths)
        marked = marked[out[ends[marked]] == 32]
        lengths[marked] -= 1
        return np.delete(out, ends[marked]), lengths


def _coder(path: str) -> _Coder:
    held = worker_cache("coders")
    if path not in held:
        held[path] = _Coder(Vocabulary(path))
    return held[path]


def _ends(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids`, the piece ids of `text`, and `n_ids`.

    A null text has null ids, an empty one none; columns of these names are replaced.
    """
    kept = docs.drop("ids", "n_ids")
    schema = f"{_ddl(kept)}ids array<int>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        coder = _coder(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for low, high in spans(np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]), BATCH_BYTES):
                for flat, counts in coder.encode(texts.slice(low, high - low)):
                    part = batch.slice(low, len(counts))
                    low += len(counts)
                    missing = part.column("text").is_null()
                    lists = pa.ListArray.from_arrays(pa.array(_ends(counts)), pa.array(flat), mask=missing)
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, "ids"])
                pa.default_memory_pool().release_unused()
            if not batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([], pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return kept.mapInArrow(run, schema).withColumn("n_ids", F.size("ids"))


def decode(rows: DataFrame, path: str, into: str = "decoded") -> DataFrame:
    """`rows` with the text of their `ids`; null ids give null. Exact inverse of `encode`."""
    kept = rows.drop(into)
    schema = f"{_ddl(kept)}`{into}` string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = _coder(path)
        for batch in batches:
            counts = batch.column("ids").value_lengths().fill_null(0).to_numpy()
            for low, high in spans(np.concatenate([[0], np.cumsum(counts)]), GATHERED):
                part = batch.slice(low, high - low)
                column = part.column("ids")
                # flatten() leaves out what null rows hold
                data, sizes = coder.decode(column.flatten().to_numpy(), counts[low:high])
                blank = pa.array(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
                texts = pa.StringArray.from_buffers(
                    len(sizes), pa.py_buffer(_ends(sizes)), pa.py_buffer(data), blank.buffers()[1]
                )
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*batch.schema.names, into])
            if not batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([], pa.string())], [*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
