"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is what merging gives exactly if every two neighbours, merged anew from their
characters, come out as those two again. So the encoder needs no merge queue: an Aho-Corasick automaton
gives the longest piece that starts at each place; the longest piece that is compatible with the one before
is taken, shorter prefixes are tried next, and a place from which nothing fits is marked in a bitfield, so
that no place fails twice. Compatibility is found by re-merging the pair and remembered.

No piece of such a vocabulary holds a space mark after another character, so words are encoded one by one and
remembered, and so are the marks behind them where no piece holds a letter and that mark side by side. This is checked
when the model is loaded; otherwise whole texts are encoded at once.
Characters outside the vocabulary are single symbols that fall back to bytes.

Null counts as empty; empty texts have no ids. Very long words are encoded but not remembered. Rows are
independent, so repeated rows give repeated results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import prepare, table

SPACE = "▁"
#: Words that a Python worker remembers, the longest of them, and pairs of pieces.
CACHED, LONGEST, PAIRS = 500_000, 64, 1_000_000
#: Marks that often follow a word.
MARKS = ".,;:!?)(\"'|*%"
_loaded: dict[str, "PieceModel"] = {}


def default_path() -> str:
    """The vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A merge-type vocabulary with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = library.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(count):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i)):
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = "" if any("\n" in p for p in self.ids) else "\n"
        # no merge crosses a place whose two characters no piece holds side by side: marks behind a letter begin anew
        beside = {p[k + 1] for p in self.ids for k in range(len(p) - 1) if p[k].isascii() and p[k].isalpha()}
        marks = re.escape("".join(c for c in MARKS if c not in beside))
        early = f"{SPACE}*+[A-Za-z]++(?=[{marks}])|" if marks else ""
        self.words = re.compile(f"{early}{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+" + ("|\n" if lines else ""))
        self.compatible: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.cache: dict[str, tuple[int, str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge neighbours whose union is a piece, best score first, then leftmost."""
        symbols = list(text)
        scores = self.scores
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: str, right: str) -> bool:
        """Does merging the two pieces anew give the same two?"""
        pair = left, right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self.merge(left + right) == [left, right]
        return known

    def whole(self, piece: str) -> bool:
        """Does the piece come out of its own characters?"""
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.merge(piece) == [piece]
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marks already."""
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        ids = self.ids
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, size = 0, longest[0] if n else 0
        while at < n:
            last = out[-1] if out else None
            while size:
                end = at + size
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    if (size == 1 or piece in ids) and (self.fits(last, piece) if last is not None else end < n or self.whole(piece)):
                        break
                size -= 1
            if size:
                out.append(piece)
                at = end
                size = longest[at] if at < n else 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("no encoding")
                size = len(out.pop())
                at -= size
                size -= 1
        return out

    def word(self, text: str) -> tuple[int, str, str]:
        """Count of ids, the ids in decimal joined by commas, and the decoded text (with its leading space)."""
        ids: list[int] = []
        for piece in self.pieces(text):
            known = self.ids.get(piece)
            if known is None:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(known)
        return len(ids), ",".join(map(str, ids)), self.decoded(ids)

    def decoded(self, ids: list[int]) -> str:
        """Pieces and bytes put together, space marks as spaces."""
        if not hasattr(self, "names"):
            self.names = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")

    def encode(self, text: str) -> tuple[int, str, str]:
        """Count of ids, ids in decimal joined by commas, and the text decoded from them."""
        if not text:
            return 0, "", ""
        text = SPACE + text.replace(" ", SPACE)
        words = self.words.findall(text) if self.by_words else [text]
        cache = self.cache
        missing = set(words).difference(cache)
        long: dict[str, tuple[int, str, str]] = {}
        if missing:
            if len(cache) > CACHED:
                cache.clear()
                missing = set(words)
            for w in missing:
                if len(w) > LONGEST:
                    long[w] = self.word(w)
                else:
                    cache[w] = self.word(w)
        found = [long.get(w) or cache[w] for w in words] if long else list(map(cache.__getitem__, words))
        counts, ids, parts = zip(*found)
        return sum(counts), ",".join(ids), "".join(parts)[1:]  # the mark put in front goes again


def model(path: str) -> PieceModel:
    """The model of this Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded of every text."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encode = model(path).encode
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
