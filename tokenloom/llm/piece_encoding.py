"""SentencePiece BPE encoding and decoding by backtracking.

A text is cut where no merge can cross: before a space, at a line feed and at
characters that are no piece of the model. Each cut is encoded exactly as the
merge procedure would: take the longest piece an Aho-Corasick automaton finds
at a place, check it against the piece before it by re-merging the two alone,
and go back to a shorter piece when they do not hold, with a bitfield of
places from which no way leads on. Runs of spaces, whose pieces share one score,
are merged from the left as the library does.

Cases: a null or empty text has no ids and decodes to the empty text; any
valid text, of any length, has an encoding since unknown characters fall back
to bytes; null ids, repeated rows and other columns have no influence.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.hashing import let_go, text_or_empty

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_CUTS = re.compile(r" +[^ \n]*|\n[^ \n]*")


_IDS, _NUMBER, _PLAIN = itemgetter(0), itemgetter(1), itemgetter(2)


class Memo(dict):
    """What is known of recent cuts. A full memo becomes the old one, whose entries come back
    when they are asked for, so two times ``size`` entries are held at most."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, cut: str):
        entry = self.old.get(cut) or self.make(cut)
        if len(cut) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[cut] = entry
        return entry


class PieceEncoder:
    """Encoder of one model; ``encode`` equals the library's for every text."""

    def __init__(self, model_file: str, memo: int = 60_000):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.memo, self.pairs = Memo(self._entry, memo), {}
        self.pieces, self.ids, self.scores, self.bytes_of = [], {}, [], {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.pieces.append(piece)
            self.scores.append(library.get_score(i))
            if library.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.characters = {p for p in self.ids if len(p) == 1}
        crossing = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces that cross a space cannot be cut before it: {crossing[:3]}")
        order = {score: n for n, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks, self.no_rank = {p: order[self.scores[i]] for p, i in self.ids.items()}, len(order)
        self.valid = {p: i for p, i in self.ids.items() if self._merge(p) == [i]}
        self.names, self.plain = [str(i) for i in range(len(self.pieces))], [p.replace(SPACE, " ") for p in self.pieces]
        self.sizes, self.widest = [len(p) for p in self.pieces], max(map(len, self.valid))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for piece in self.valid:
            self.automaton.add_word(piece)
        self.automaton.make_automaton()
        # The next shorter piece that a piece begins with, or -1.
        self.shorter = [-1] * len(self.pieces)
        for piece, i in self.valid.items():
            self.shorter[i] = next((self.valid[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.valid), -1)

    def _merge(self, text: str) -> list[int]:
        """The merge procedure itself: best rank first, then leftmost."""
        parts, rank, none = list(text), self.ranks.get, self.no_rank
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            merged = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + merged, none)
            if i < len(ranks):
                ranks[i] = rank(merged + parts[i + 1], none)
        return [self.ids[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text alone gives the two pieces."""
        if len(self.pairs) > 200_000:
            self.pairs.clear()
        found = self.pairs[left << 20 | right] = self._merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Encode a cut whose characters are all pieces."""
        sizes, pairs, shorter, valid, prefix = self.sizes, self.pairs, self.shorter, self.valid, self.automaton.longest_prefix
        failed, ids, last, at, n, widest = 0, [], -1, 0, len(text), self.widest
        i = -2
        while True:
            if i == -2:  # the longest piece that begins here
                rest = text[at : at + widest]
                size = prefix(rest)
                while (i := valid.get(rest[:size])) is None:
                    size -= 1
            end = at + sizes[i]
            if not failed >> end & 1:
                fit = last < 0 or pairs.get(last << 20 | i)
                if fit or fit is None and self._fits(last, i):
                    ids.append(i)
                    if end == n:
                        return ids
                    last, at, i = i, end, -2
                    continue
            i = shorter[i]
            while i < 0:
                failed |= 1 << at
                i = ids.pop()
                last = ids[-1] if ids else -1
                at -= sizes[i]
                i = shorter[i]

    def _known(self, text: str) -> list[int]:
        """Encode a cut, with bytes for characters that are no piece."""
        if self.characters.issuperset(text):
            return self._backtrack(text)
        ids, begin = [], 0
        for i, c in enumerate(text):
            if c not in self.characters:
                if i > begin:
                    ids += self._backtrack(text[begin:i])
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                begin = i + 1
        return ids + (self._backtrack(text[begin:]) if begin < len(text) else [])

    def cut_ids(self, cut: str) -> list[int]:
        """Ids of one cut: spaces first, or a line feed, or characters without a space before them."""
        word = cut.lstrip(" ")
        spaces = len(cut) - len(word)
        if spaces < 2:
            return self._known(SPACE * spaces + word)
        ids = self._known(SPACE + word)
        if ids[0] != self.ids[SPACE]:
            return self._spaces(spaces - 1) + ids
        return self._spaces(spaces) + ids[1:]

    def _spaces(self, n: int) -> list[int]:
        """Runs of spaces: their pieces tie, so the left one grows as long as there is a piece."""
        longest = 1
        while SPACE * (longest + 1) in self.ids:
            longest += 1
        if n <= longest:
            return [self.ids[SPACE * n]]
        return self._merge(SPACE * n) if n < 5_000 else self._merge_run(n)

    def _merge_run(self, n: int) -> list[int]:
        period = self._merge(SPACE * 4_000)
        full = len(self.pieces[period[0]])
        head = (n - 2_000) // full
        return [period[0]] * head + self._merge(SPACE * (n - head * full))

    def _entry(self, cut: str) -> tuple[str, int, str]:
        """Joined ids, their number and the decoded text of a cut that the memo lacks.

        The key of a cut that begins with one space lacks that space.
        """
        ids = self.cut_ids(cut if cut[0] in " \n" else " " + cut)
        return ",".join([self.names[i] for i in ids]), len(ids), self.decode_ids(ids)

    def _entries(self, text: str) -> list[tuple[str, int, str]]:
        cuts: list[str] = []
        for line in (" " + text.replace(SPACE, " ")).split("\n"):
            words = line.split(" ")
            words[0] = "\n" + words[0]
            cuts += words if "" not in words else _CUTS.findall("\n" + line)
        if cuts[0] == "\n":
            del cuts[0]
        else:
            cuts[0] = cuts[0][1:]
        return list(map(self.memo.__getitem__, cuts))

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, without the treatment of the first space."""
        if self.bytes_of.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def encode(self, text: str | None) -> list[int]:
        """All ids of a whole text."""
        return [int(i) for e in self._entries(text) for i in e[0].split(",")] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space the encoder puts first is taken off."""
        return self.decode_ids(ids).removeprefix(" ")

    def round_trip(self, text: str | None) -> tuple[str, int, str]:
        """Comma-joined ids, their number, and the decoded text."""
        if not text:
            return "", 0, ""
        found = self._entries(text)
        return ",".join(map(_IDS, found)), sum(map(_NUMBER, found)), "".join(map(_PLAIN, found)).removeprefix(" ")


@lru_cache(1)
def encoder(model: str = MODEL) -> PieceEncoder:
    """The worker's encoder of a model file, or of one among the public tokenizers."""
    import os

    import public_tokenizers

    return PieceEncoder(model if os.path.isabs(model) else public_tokenizers.path(model))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` of every document."""

    def run(batches):
        own = encoder(model)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = pa.array([own.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])
        let_go()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of rows with ``ids``; null ids give the empty text."""

    def run(batches):
        own = encoder(model)
        for batch in batches:
            texts = pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and decoded in its task."""

    def run(batches):
        own, sha = encoder(model), hashlib.sha256
        for batch in batches:
            numbers, ids_sha, text_sha = [], [], []
            for i in range(batch.num_rows):
                ids, n, text = own.round_trip(batch.column(1)[i].as_py())
                numbers.append(n)
                ids_sha.append(sha(ids.encode()).hexdigest())
                text_sha.append(sha(text.encode("utf-8", "surrogatepass")).hexdigest())
            arrays = [batch.column(0), pa.array(numbers, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
