"""BPE encoding by speculation and verification, and decoding.

Words are encoded once per worker and remembered. For new words, the longest token at each place is proposed
(greedy). A proposal is what merging would give exactly if every two neighbours are compatible: undoing merges
from the boundary outwards never meets a merge across it that would have come first. That check runs for all
distinct neighbours of a batch at once, in numpy. Words that fail it are merged exactly.

The vocabulary is a file of the public tokenizers format (BPE with word ends over byte characters; NFC, white
space and lower case normalised); its path is a parameter, and only names that resolve on every executor may be
given. The file is bounded and read once per worker.

Defined results: null and empty texts have no tokens and decode to the empty string; null ids decode to the
empty string; special tokens that occur in a text are read as such, as the library does; very long texts and words are
encoded whole (merging takes n log n steps); repeated rows each get a row; an empty table gives no rows; other columns
are kept, apart from one named like the result, which is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import pieces, released, table

#: The white space that the normaliser knows, and the pattern that splits words.
SPACES = r"\t\n\x0b\f\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACES + r"\p{L}\p{N}]+"
#: The same for texts below U+0250, with the letters and numbers of that range spelled out.
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\x0b\f\r \x85\xa0A-Za-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
#: Words remembered by a worker.
REMEMBERED = 700_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [(a, b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        made = {a + b: r for r, (a, b) in enumerate(merges)}
        basic = [s for s in vocab if s not in made]
        # Order of making: what is no merge first, then the merges by rank.
        self.order = {s: i for i, s in enumerate([*basic, *(a + b for a, b in merges)])}
        n = len(self.order)
        self.ids = np.zeros(n, np.int64)
        for s, o in self.order.items():
            self.ids[o] = vocab[s]
        self.ids_list = self.ids.tolist()
        self.left, self.right = np.arange(n), np.arange(n)
        keys = np.empty(len(merges), np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            o, x, y = len(basic) + r, self.order[a], self.order[b]
            self.left[o], self.right[o], keys[r], self.rank[x, y] = x, y, x * n + y, o
        self.sorted = np.argsort(keys, kind="stable")
        self.keys, self.n = keys[self.sorted], n
        self.first_merge = len(basic)
        self.chars = byte_characters()
        # For matching, a word's end is one more character.
        self.match = {s.removesuffix(self.end) + "\0" if s.endswith(self.end) and s != self.end else s: o for s, o in self.order.items()}
        # How long the tokens with the same first four characters are at most.
        self.longest: dict[str, int] = {}
        for t in self.match:
            if len(t) > 3:
                self.longest[t[:4]] = max(self.longest.get(t[:4], 0), len(t))
        self.stable: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.words, self.latin, self.beyond = regex.compile(WORDS), re.compile(LATIN), re.compile("[^\\x00-\\u024f]")
        self.spaces = re.compile(f"[{SPACES}]+")
        self.proposed = self.merged = 0

    # -- words

    def symbols(self, word: str) -> list[int]:
        """A word's single tokens; characters that the vocabulary lacks vanish."""
        chars = [self.chars[b] for b in word.encode("utf-8", "replace")]
        chars[-1] += self.end
        return [self.order[c] for c in chars if c in self.order]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: always the earliest pair, leftmost first. Pairs wait in a heap, neighbours are links."""
        parts, n, rank = list(parts), len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(pairwise(parts)) if (r := rank.get(p)) is not None]
        heapify(heap)
        while heap:
            made, i = heappop(heap)
            j = after[i]
            # What was found at a place may have been merged with something else since.
            if parts[i] < 0 or j >= n or rank.get((parts[i], parts[j])) != made:
                continue
            parts[i], parts[j], k, h = made, -1, after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank.get((made, parts[k]))) is not None:
                    heappush(heap, (r, i))
            if h >= 0 and (r := rank.get((parts[h], made))) is not None:
                heappush(heap, (r, h))
        return [x for x in parts if x >= 0]

    def merge_all(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of many words: a merge of each in turn, in numpy. Words of like length go together."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(words[order[at]]) * 3 // 2)
            to = at
            while to < len(order) and to - at < 20_000 and len(words[order[to]]) <= longest:
                to += 1
            to = max(to, at + 1)
            rows = order[at:to]
            if len(words[rows[-1]]) > 64:
                for i in rows:
                    out[i] = self.merge(words[i])
            else:
                for i, merged in zip(rows, self._merge_rows([words[i] for i in rows]), strict=True):
                    out[i] = merged
            at = to
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What two tokens merge into; ``n`` or more if they don't. Negative tokens are none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.n + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.first_merge + self.sorted[at], self.n)

    def _merge_rows(self, words: list[list[int]]) -> list[list[int]]:
        width = max(2, max(map(len, words)))
        grid = np.full((len(words), width), -1, np.int64)
        lengths = np.array([len(w) for w in words])
        grid[np.arange(width) < lengths[:, None]] = [t for w in words for t in w]
        ranks = self._ranks(grid[:, :-1], grid[:, 1:])
        live = np.arange(len(words))
        while len(live):
            best = ranks[live].argmin(axis=1)  # the leftmost of the earliest
            made = ranks[live, best]
            go = made < self.n
            live, best, made = live[go], best[go], made[go]
            if not len(live):
                break
            # Close the gap that the merge leaves, in tokens and in ranks.
            part, old = grid[live], ranks[live]
            col = np.arange(width)
            part = np.where(col > best[:, None], np.concatenate([part[:, 1:], np.full((len(live), 1), -1)], axis=1), part)
            old = np.where(col[:-1] > best[:, None], np.concatenate([old[:, 1:], np.full((len(live), 1), self.n)], axis=1), old)
            each = np.arange(len(live))
            part[each, best] = made
            after = np.where(best + 1 < width, part[each, np.minimum(best + 1, width - 1)], -1)
            inside = best < width - 1
            old[each[inside], best[inside]] = self._ranks(made, after)[inside]
            left = best > 0
            old[each[left], best[left] - 1] = self._ranks(part[each, np.maximum(best - 1, 0)], made)[left]
            grid[live], ranks[live] = part, old
        return [[t for t in row if t >= 0] for row in grid.tolist()]

    def greedy(self, word: str) -> list[int] | None:
        """The longest token at each place, or nothing if that leads nowhere."""
        plain = word.isascii() and word.isprintable()  # these characters stand for themselves
        text = (word if plain else "".join([self.chars[b] for b in word.encode("utf-8", "replace")])) + "\0"
        at, out, match, longest, n = 0, [], self.match, self.longest, len(text)
        while at < n:
            for to in range(min(n, at + longest.get(text[at : at + 4], 3)), at, -1):
                if (o := match.get(text[at:to])) is not None:
                    out.append(o)
                    at = to
                    break
            else:
                return None
        return out

    def is_stable(self, token: int) -> bool:
        """Whether merging the token's characters gives the token."""
        if token not in self.stable:
            flat = [token]
            while any(self.left[t] != t for t in flat):
                flat = [x for t in flat for x in ([t] if self.left[t] == t else [int(self.left[t]), int(self.right[t])])]
            self.stable[token] = self.merge(flat) == [token]
        return self.stable[token]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging would keep the boundary between them."""
        good = np.zeros(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), self.n + 1)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = np.where(self.keys[at] == key, self.first_merge + self.sorted[at], self.n + 2)
            go = across >= limit
            live, a, b, limit = live[go], a[go], b[go], limit[go]
            # Undo what was made last; if that is a single character, the other side.
            by_a = a > b
            single_a, single_b = self.left[a] == a, self.left[b] == b
            use_a = np.where(by_a, ~single_a, single_b)
            over = single_a & single_b
            good[live[over]] = True
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, self.right[a], a), np.where(use_a, b, self.left[b])
            go = ~over
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return good

    def learn(self, words: list[str]) -> None:
        """Encodes and remembers words."""
        tries = [self.greedy(w) for w in words]
        a = np.array([x for t in tries if t for x in t[:-1]], np.int64)
        b = np.array([x for t in tries if t for x in t[1:]], np.int64)
        pairs, back = np.unique(a * self.n + b, return_inverse=True)
        fits = self.compatible(pairs // self.n, pairs % self.n)[back] if len(pairs) else np.zeros(0, bool)
        bad = np.concatenate(([0], np.cumsum(~fits))).tolist()
        at, failing, ids = 0, [], self.ids_list
        for word, t in zip(words, tries, strict=True):
            ok = t is not None
            if ok:
                to = at + len(t) - 1
                ok = bad[at] == bad[to] and all(map(self.is_stable, t))
                at = to
            if ok:
                self.known[word] = [ids[x] for x in t]
            else:
                failing.append(word)
        self.proposed += len(words) - len(failing)
        self.merged += len(failing)
        for word, t in zip(failing, self.merge_all([self.symbols(w) for w in failing]), strict=True):
            self.known[word] = [ids[x] for x in t]

    # -- texts

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = self.spaces.sub(" ", text)
            return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        return (self.words if self.beyond.search(text) else self.latin).findall(text)

    def split(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens, of a text."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.pieces(self.normal(text))
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.pieces(self.normal(part))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        met = set().union(*split)
        special = {w for w in met if isinstance(w, int)} if any(s in t for t in texts for s in self.special) else set()
        met -= special
        if len(self.known) + len(met) > REMEMBERED:
            self.known.clear()
        self.learn(list(met.difference(self.known)))
        known = self.known if not special else self.known | {i: [i] for i in special}
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


@lru_cache(maxsize=2)
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def _with(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])


def _ids(model: WordBpe, texts: pa.Array) -> pa.Array:
    found = model.encode([t or "" for t in texts.to_pylist()])
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1]))))


def _said(names: pa.Array, ids: pa.Array) -> pa.Array:
    lengths = np.nan_to_num(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(ids.flatten())), " ")


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array; a column of that name is replaced.

    ``decoded`` names a further column for the text that the ids decode to, made in the same workers, so that only
    one a task holds the vocabulary.
    """
    path = path or default_vocabulary()
    kinds = {ids: T.ArrayType(T.IntegerType()), **({decoded: T.StringType()} if decoded else {})}
    cols = [c for c in docs.columns if c not in kinds]
    at = cols.index(text)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        names = pa.array(model.names, pa.string())
        for batch in batches:
            for part in pieces(batch, at, 4 << 20):
                made = [_ids(model, part.column(at))]
                if decoded:
                    made.append(_said(names, made[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*cols, *kinds])

    kept = docs.select(cols)
    return kept.mapInArrow(run, _with(kept, **kinds))


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the array ``ids``: the tokens, special ones too, joined by spaces."""
    path = path or default_vocabulary()
    cols = [c for c in docs.columns if c != text]
    at = cols.index(ids)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(_model(path).names, pa.string())
        for batch in batches:
            for part in pieces(batch, at, 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, _said(names, part.column(at))], [*cols, text])

    kept = docs.select(cols)
    return kept.mapInArrow(run, _with(kept, **{text: T.StringType()}))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
