"""BPE encoding and decoding by forced boundaries.

Two neighbouring bytes that never stand side by side inside a vocabulary token can never be merged,
so a cut between them is certain. White space is in no token at all, hence a text falls apart at
each run of it, and at the tokenizer's own pre-token ends; inside a piece the pair table of the
vocabulary marks further cuts. The fragments are encoded on their own, most of them from a bounded
cache, and joined in order.

Results equal the tokenizers library's `encode(text, add_special_tokens=False)` (truncation and
padding unused) and `decode(ids, skip_special_tokens=False)`. A null text is the empty text: no
ids, empty decoded text. Very long texts are walked fragment by fragment; a very long fragment is
merged with a heap, in n log n. Extra columns are not touched.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space, the class that the tokenizer's normaliser turns into blanks.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers up to U+017F, where NFC changes nothing; U+0130 lower-cases to two characters.
LETTER = "a-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u017f"
NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PLAIN = re.compile("[\\t-\\r -~\\x85\\xa0-\\u012f\\u0131-\\u017f]*")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
CACHE = 400_000


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file with an end-of-word suffix (or none)."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps memory of its own
        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.chars = _byte_chars()
        self.inside = {pair for body in map(self._body, self.vocab) for pair in zip(body, body[1:], strict=False)}
        self.any_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.limit = cache
        self.ids: dict[str, str] = {}  # of a piece, joined by blanks
        self.decoded: dict[str, str] = {}
        self.parts: dict[str, list[int]] = {}

    def _body(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def _merge(self, symbols: list[str]) -> list[str]:
        """Applies the merges of lowest rank first, leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = a + b, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]

    def _part(self, chars: str) -> list[int]:
        """Ids of a fragment that does not end its piece: the library would take its end for a word's."""
        got = self.parts.get(chars)
        if got is None:
            got = [self.vocab[s] for s in self._merge(list(chars))]
            if len(self.parts) >= self.limit:
                self.parts.clear()
            if len(chars) < 64:
                self.parts[chars] = got
        return got

    def _last(self, chars: str) -> list[int]:
        symbols = list(chars)
        symbols[-1] += self.suffix
        return [self.vocab[s] for s in self._merge(symbols)]

    def _cut(self, chars: str) -> list[int]:
        """A pre-token in byte-level characters: cut at forced boundaries, encode, join."""
        out, start, inside = [], 0, self.inside
        for i, pair in enumerate(zip(chars, chars[1:], strict=False), 1):
            if pair not in inside:
                out += self._part(chars[start:i])
                start = i
        return out + self._last(chars[start:])

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special token is a piece of its own, in NUL marks."""
        out, at = [], 0
        if self.any_special and "<" in text:
            for m in self.any_special.finditer(text):
                out += self._between(text[at : m.start()])
                out.append(f"\0{m[0]}\0")
                at = m.end()
        return out + self._between(text[at:])

    def _between(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special token."""
        if PLAIN.fullmatch(text):
            return PIECES.findall(text.lower())
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return ["\0" + p for p, _ in pieces]

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces that the cache lacks; those without a forced boundary in one call."""
        made: dict[str, list[int]] = {}
        uncut = []
        for p in pieces:
            if p[0] == "\0" and p[-1] == "\0" and len(p) > 1:
                made[p] = [self.special[p[1:-1]]]
            elif p[0] == "\0":
                made[p] = self._cut(p[1:])
            elif len(p) < 64:
                chars = p if p.isascii() else "".join(map(self.chars.__getitem__, p.encode()))
                if self.inside.issuperset(zip(chars, chars[1:], strict=False)):
                    uncut.append(p)
                else:
                    made[p] = self._cut(chars)
            else:
                made[p] = self._cut("".join(map(self.chars.__getitem__, p.encode())))
        for at in range(0, len(uncut), 4096):
            part = uncut[at : at + 4096]
            made.update(zip(part, (e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        token = self.by_id.__getitem__
        for p, ids in made.items():
            self.ids[p] = " ".join(map(str, ids))
            self.decoded[p] = " ".join(map(token, ids))

    def batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of each text."""
        found = [self._pieces(t or "") for t in texts]
        need = set().union(*found)
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.decoded.clear()
        self._learn(need - self.ids.keys())
        out = []
        for pieces in found:
            ids = " ".join(map(self.ids.__getitem__, pieces))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(self.decoded.__getitem__, pieces))))
        return out

    def forget(self) -> None:
        """Empties the caches, so that an idle worker does not hold them."""
        for cache in (self.ids, self.decoded, self.parts):
            cache.clear()

    def both(self, text: str | None) -> tuple[int, str, str]:
        return self.batch([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.both(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.by_id[i] for i in ids)


_loaded: dict[str, ForcedBoundaryBPE] = {}


def encoder(path: str) -> ForcedBoundaryBPE:
    """One for each Python worker; its caches live from batch to batch and end with the task."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


Emit = Callable[[int, str, str], tuple]


def encoded(docs: DataFrame, path: str, emit: Emit | None = None, schema: str = "ids array<int>, decoded string", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, for each row, what emit makes of (number of ids, ids joined by blanks, decoded text);
    without emit the ids themselves and the decoded text. path must exist on every executor."""
    emit = emit or (lambda n, ids, decoded: ([int(i) for i in ids.split()], decoded))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    extra = T.StructType.fromDDL(schema)
    out = T.StructType([rows.schema[0], *extra.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        coder = encoder(path)
        gc.freeze()  # the vocabulary and the caches hold no cycles
        gc.disable()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    made = [emit(*r) for r in coder.batch(part.column(1).to_pylist())]
                    columns = zip(*made, strict=True)
                    arrays = [part.column(0).cast(shape[0].type), *(pa.array(list(c), f.type) for c, f in zip(columns, list(shape)[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, schema=shape)
        finally:  # the worker goes on to other tasks
            coder.forget()
            gc.unfreeze()
            gc.enable()
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, out)
