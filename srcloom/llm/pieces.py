"""Exact merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

A sequence of pieces is the encoding of a text exactly if each two neighbours
are the encoding of their own concatenation. So instead of merging, the encoder
takes the longest piece at each place (all pieces come from an Aho-Corasick
automaton), accepts it if it goes with the piece before it, else tries the next
shorter one, else takes the piece before it back. A bitfield of places from
which no encoding can go on keeps the work linear. Whether two pieces go
together is found by merging again: the last merges of both are undone, the
later one first, and at no time may the pieces at the border have been merged
with one another. Verdicts are kept.

Stretches: if no piece of the vocabulary holds a space mark after another
character, merges never cross such a boundary, so each word is encoded by
itself; otherwise the whole text is one stretch. The new words of a slice of
texts are encoded together: each step of the backtracking is taken by all words
that are not done. Words of more than LONGEST code points are encoded one by
one. Ids of words are kept in two generations of bounded size. Characters
without a piece are single symbols that never merge and become byte pieces.

The model must be a BPE model with identity normalisation, byte fallback and no
user-defined pieces, which is checked when it is loaded.

Defined cases: null and empty texts have no ids and decode to the empty text;
columns of the documents that bear a name of an added column are replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Recent, appended, table, tables_of
from .matching import LONGEST, Automaton, Nodes, blocks

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Words that a worker process keeps in each of two generations, pairs of pieces that it keeps, and places for verdicts (a power of two).
KEPT, PAIRS, VERDICTS = 50_000, 100_000, 1 << 20
#: Ids that are written as decimal text at one time.
JOINED_IDS = 100_000_000


def model_path() -> str:
    from public_tokenizers import path

    return path(MODEL)


def loaded(model_file: str) -> Pieces:
    """The vocabulary of this worker process, with what earlier tasks have kept."""
    return tables_of("pieces", model_file, lambda: Pieces(model_file))


class Pieces:
    """A vocabulary: encode() and decode() of single texts."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        self.text: list[str] = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        if any(k in (kinds.USER_DEFINED, kinds.UNUSED) for k in self.kind):
            raise ValueError("user-defined and unused pieces are not handled")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, k in enumerate(self.kind) if k == kinds.CONTROL}
        self.unknown = {i for i, k in enumerate(self.kind) if k == kinds.UNKNOWN}
        self.unknown_text = proto.trainer_spec.unk_surface
        self.alone = {c for p in self.ids for c in p if c not in self.ids}  # characters that only longer pieces have
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # so is one between a letter and another character, if no piece holds both; a line end without a piece is no letter
        letters = re.escape("".join(sorted(p for p in self.ids if len(p) == 1 and p.isalpha())))
        mixed = not letters or any(re.search(f"[{letters}][^{letters}]|[^{letters}{SPACE}][{letters}]", p) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        fine = rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n+" if mixed else rf"{SPACE}*(?:[{letters}]+|[^{SPACE}{line}{letters}]+)|{SPACE}+|\n+"
        self.stretch = re.compile("(?s).+" if inner else fine)
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Recent(self._words, KEPT)  # word: its ids as bytes
        normal = [i for i, k in enumerate(self.kind) if k == kinds.NORMAL]
        often = Counter(self.score[i] for i in normal if len(self.text[i]) > 1)
        tied = [self.text[i] for i in normal if len(self.text[i]) > 1 and often[self.score[i]] > 1]
        self.tied = re.compile("|".join(map(re.escape, tied)) or "(?!)")  # merges of equal score
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.odd = re.compile("[^" + "".join(map(re.escape, sorted(p for p in self.ids if len(p) == 1))) + "]")
        self.listed = np.array(normal)
        self.sizes = np.array([len(t) for t in self.text])
        self.verdict_keys = np.full(VERDICTS, -1, np.int64)
        self.verdicts = np.zeros(VERDICTS, bool)

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            found.add_word(p, (len(p), i))
        found.make_automaton()
        return found

    def merged(self, text: str, merges: list[tuple[str, str]] | None = None) -> list[str]:
        """The plain merge procedure: the best-scored neighbours first, the leftmost of equals; merges gets what was merged."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < n and (i := self.ids.get(both := symbols[a] + symbols[after[a]])) is not None:
                heapq.heappush(heap, (-self.score[i], a, both))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, both = heapq.heappop(heap)
            if symbols[a] is None or after[a] >= n or symbols[a] + symbols[after[a]] != both:
                continue
            b = after[a]
            if merges is not None:
                merges.append((symbols[a], symbols[b]))
            symbols[a], symbols[b] = both, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [s for s in symbols if s is not None]

    def _parts(self, piece: int) -> tuple[int, int] | None:
        """The two pieces of a piece's last merge; (-1, -1) for a single character, None if merging does not build the piece."""
        if piece not in self.parts:
            text = self.text[piece]
            if len(text) == 1:
                self.parts[piece] = (-1, -1)
            else:
                last: list[tuple[str, str]] = []
                whole = self.merged(text, last)
                self.parts[piece] = (self.ids[last[-1][0]], self.ids[last[-1][1]]) if len(whole) == 1 else None
        return self.parts[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both gives the two pieces again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        if self._parts(left) is None or self._parts(right) is None:
            return False
        a, b = self.text[left], self.text[right]
        if self.tied.search(a + b):
            return self.merged(a + b) == [a, b]
        # merges come by falling score; a single character is older than every merge
        age = lambda i: -self.score[i] if len(self.text[i]) > 1 else -np.inf
        until, until_equal = np.inf, False  # merges across the border that come before this undo the two pieces
        while True:
            both = self.ids.get(self.text[left] + self.text[right])
            if both is not None and (age(both) < until or (until_equal and age(both) == until)):
                return False
            if age(left) > age(right):
                until, until_equal = age(left), False  # of equal merges the leftmost comes first: the left piece's own
                left = self._parts(left)[1]
            elif age(right) > -np.inf:
                until, until_equal = age(right), True
                right = self._parts(right)[0]
            else:
                return True

    def _run(self, text: str) -> list[int]:
        """Ids of a stretch of which every character has a piece."""
        whole = self.ids.get(text)
        if whole is not None and self._stable(whole):
            return [whole]
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # pieces from each place, shortest first
        for end, (size, i) in self.automaton.iter(text):
            at[end - size + 1].append((size, i))
        for found in at:
            found.sort()
        open_ = bytearray(b"\x01") * (n + 1)  # the bitfield: 0 where no encoding goes on
        taken: list[tuple[int, int, int]] = []  # (id, start, rank among the pieces from there)
        pos, rank = 0, len(at[0]) - 1
        while pos < n:
            found, last = at[pos], taken[-1][0] if taken else -1
            while rank >= 0:
                size, i = found[rank]
                if open_[pos + size] and (self.compatible(last, i) if last >= 0 else self._stable(i)):
                    break
                rank -= 1
            if rank >= 0:
                taken.append((i, pos, rank))
                pos += size
                rank = len(at[pos]) - 1 if pos < n else -1
            else:
                open_[pos] = 0
                if not taken:
                    raise ValueError("no encoding: the vocabulary lacks a character")
                _, pos, rank = taken.pop()  # its end is closed now, so a shorter one is tried
        return [i for i, _, _ in taken]

    def _stable(self, piece: int) -> bool:
        """Whether merging builds the piece from its own characters."""
        return self._parts(piece) is not None

    @cached_property
    def together(self) -> Automaton:
        return Automaton([self.text[i] for i in self.listed])

    def _judged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of many pairs (left -1: the right one alone), by way of a table of verdicts of fixed size."""
        keys = (left + 1) * len(self.text) + right
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (VERDICTS - 1)
        out = self.verdicts[slots]
        new = np.flatnonzero(self.verdict_keys[slots] != keys)
        if len(new):
            distinct, back = np.unique(keys[new], return_inverse=True)
            found = [self._apart(k // len(self.text) - 1, k % len(self.text)) if k >= len(self.text) else self._stable(k) for k in distinct.tolist()]
            out[new] = np.array(found)[back]
            self.verdict_keys[slots[new]], self.verdicts[slots[new]] = keys[new], out[new]
        return out

    def _run_all(self, words: list[str]) -> list[bytes]:
        """_run(), as bytes, of sorted distinct words, step by step for all of them."""
        trie = Nodes(words)
        word, end, piece = self.together.matches(trie)
        piece = self.listed[piece]
        size = self.sizes[piece]
        begin = np.cumsum(trie.lengths + 1) - trie.lengths - 1  # places: one more for each word, behind its end
        place = begin[word] + end - size
        order = np.argsort(place * 128 + (127 - np.minimum(size, 127)), kind="stable")  # by place, the longest first
        place, size, piece = place[order], size[order], piece[order]
        row = np.searchsorted(place, np.arange(begin[-1] + trie.lengths[-1] + 2))
        final = begin + trie.lengths
        open_ = np.ones(len(row), bool)  # the bitfield
        taken = np.full((len(words), int(trie.lengths.max(initial=1)) + 1), -1, np.int64)  # matches, behind a column for "none before"
        depth = np.zeros(len(words), np.int64)
        at, now = begin.copy(), row[begin]
        live = np.flatnonzero(trie.lengths)
        while len(live):
            a, m = at[live], now[live]
            left = m < row[a + 1]
            w, m = live[left], m[left]
            before = taken[w, depth[w]]
            fits = open_[place[m] + size[m]]
            some = np.flatnonzero(fits)
            last = before[some]
            fits[some] = self._judged(np.where(last >= 0, piece[last], -1), piece[m[some]])
            now[w[~fits]] += 1
            w, m = w[fits], m[fits]
            depth[w] += 1
            taken[w, depth[w]] = m
            at[w] = place[m] + size[m]
            now[w] = row[at[w]]
            back = live[~left]  # no piece is left here: the one before is taken back
            if len(back):
                open_[at[back]] = False
                if not depth[back].all():
                    raise ValueError("no encoding: the vocabulary lacks a character")
                m = taken[back, depth[back]]
                depth[back] -= 1
                at[back], now[back] = place[m], m + 1
            live = live[at[live] < final[live]]
        ids = piece[taken[:, 1:][np.arange(taken.shape[1] - 1) < depth[:, None]]].astype("<i4").tobytes()
        ends = (4 * np.cumsum(depth)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _stretch_ids(self, text: str) -> array:
        """Ids of a stretch; characters without a piece become bytes."""
        if not self.alone.isdisjoint(text):  # a character that only merges could bring in: merge plainly
            out = array("i")
            for s in self.merged(text):
                out.extend([self.ids[s]] if s in self.ids else [self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")])
            return out
        out, run = array("i"), []
        for c in text:
            if c in self.ids:
                run.append(c)
                continue
            if run:
                out.extend(self._run("".join(run)))
                run = []
            out.extend(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))
        if run:
            out.extend(self._run("".join(run)))
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct stretches, as little-endian 32-bit numbers."""
        plain = [w for w in words if len(w) <= LONGEST and not self.odd.search(w)]
        ids = {w: i for block in blocks(plain) for w, i in zip(block, self._run_all(block), strict=True)}
        return ids | {w: self._stretch_ids(w).tobytes() for w in words if w not in ids}

    def encode_all(self, texts: list[str | None]) -> list[array]:
        found = self.words.of([self.stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts])
        return [array("i", b"".join(ids)) for ids in found]

    def encode(self, text: str | None) -> array:
        return self.encode_all([text])[0]

    @cached_property
    def surfaces(self) -> list[str]:
        """The text of each piece; of a byte piece below 128 its character."""
        return [chr(b) if (b := self.bytes.get(i, 128)) < 128 else p.replace(SPACE, " ") for i, p in enumerate(self.text)]

    @cached_property
    def intricate(self) -> set[int]:
        """Pieces whose text depends on their neighbours, or that have none."""
        return self.control | self.unknown | {i for i, b in self.bytes.items() if b >= 128}

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD each."""
        if self.intricate.isdisjoint(ids):
            whole = "".join(map(self.surfaces.__getitem__, ids))
            return whole[1:] if whole.startswith(" ") and ids[0] not in self.bytes else whole
        out: list[str] = []
        pending = bytearray()
        surfaces, as_byte, special = self.surfaces, self.bytes, self.control | self.unknown

        def flush() -> None:
            out.append(_utf8(bytes(pending)))
            pending.clear()

        first = True
        for i in ids:
            if i in as_byte:
                pending.append(as_byte[i])
                first = False
                continue
            if pending:
                flush()
            if i in special:
                if i in self.unknown:
                    out.append(self.unknown_text)
                    first = False
                continue
            s = surfaces[i]
            out.append(s[1:] if first and s.startswith(" ") else s)
            first = False
        if pending:
            flush()
        return "".join(out)


def _utf8(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def decimal_lists(found: list[array]) -> list[bytes]:
    """The ids of each text as decimal numbers joined by commas."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum([0, *map(len, found)])
    if ends[-1] > JOINED_IDS:  # more than fits one Arrow array of strings
        return [",".join(map(str, ids)).encode() for ids in found]
    flat = pa.array(np.frombuffer(b"".join(found), "<i4")).cast(pa.utf8())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return [x.encode() for x in pc.binary_join(lists, ",").to_pylist()]


def encode(docs: DataFrame, text_col: str = "text", model_file: str | None = None, name: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as an array."""
    file = model_file or model_path()

    def make():
        pieces = loaded(file)
        return lambda texts: [[ids.tolist() for ids in pieces.encode_all(texts)]]

    return appended(docs, text_col, T.StructType([T.StructField(name, T.ArrayType(T.IntegerType()))]), make)


def decode(docs: DataFrame, ids_col: str = "ids", model_file: str | None = None, name: str = "decoded") -> DataFrame:
    """docs with the text of an array of ids."""
    file = model_file or model_path()

    def make():
        pieces = loaded(file)
        return lambda rows: [[pieces.decode(ids or []) for ids in rows]]

    return appended(docs, ids_col, T.StructType([T.StructField(name, T.StringType())]), make)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(docs: DataFrame, text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: each text is encoded and its ids decoded again, in one pass."""
    file = model_file or model_path()

    def make():
        from hashlib import sha256

        pieces = loaded(file)

        def work(texts: list) -> list[list]:
            found = pieces.encode_all(texts)
            return [list(map(len, found)), [sha256(x).hexdigest() for x in decimal_lists(found)], [sha256(pieces.decode(ids).encode("utf-8", "surrogatepass")).hexdigest() for ids in found]]

        return work

    return appended(docs, text_col, DIGESTS, make)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *DIGESTS.names)
